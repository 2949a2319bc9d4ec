"""Items of varying length laid into containers of fixed capacity.

What decides the plan is how many items have each length, a table that is no longer than the capacity however
many items there are. The plan is made from it on the driver: a container is begun with the longest lengths left, and its gap
is closed by an index of exact complements (one length, a pair or a triple that sums to the gap, as
far as counts allow); where there is none, the longest length that fits is added. Each such filling is used as
often as the counts allow. The items then look up their container by length and running number.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from scrivane.session import materialize

#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ComplementIndex:
    """The lengths that are left, with their counts; bit sets of them answer which lengths complete a gap exactly."""

    def __init__(self, counts: np.ndarray):
        self.count = counts.tolist()
        self.top = len(self.count) - 1
        self.bits = sum(1 << i for i, n in enumerate(self.count) if n and i)
        self.mirror = sum(1 << (self.top - i) for i, n in enumerate(self.count) if n and i)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.bits &= ~(1 << length)
            self.mirror &= ~(1 << (self.top - length))

    def longest(self, most: int, used: dict[int, int]) -> int:
        """The greatest length up to most that is left beside those used; 0 if there is none."""
        b = self.bits & ((1 << (most + 1)) - 1)
        while b:
            i = b.bit_length() - 1
            if self.count[i] > used.get(i, 0):
                return i
            b ^= 1 << i
        return 0

    def _left(self, i: int, used: dict[int, int], more: int = 0) -> bool:
        return self.count[i] - used.get(i, 0) > more

    def single(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        return (gap,) if gap <= self.top and self.count[gap] and self._left(gap, used) else None

    def pair(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        shift = self.top - gap
        both = self.bits & (self.mirror >> shift if shift >= 0 else self.mirror << -shift) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            if a * 2 < gap:
                return None
            if self._left(a, used) and self._left(gap - a, used, int(a * 2 == gap)):
                return a, gap - a
            both ^= 1 << a
        return None

    def triple(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        b = self.bits & ((1 << max(gap - 1, 0)) - 1)
        while b:
            a = b.bit_length() - 1
            if a * 3 < gap:
                return None
            if self._left(a, used) and (rest := self.pair(gap - a, used | {a: used.get(a, 0) + 1})):
                return a, *rest
            b ^= 1 << a
        return None


def plan_containers(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Lays counts[length] items of each length, 1 to capacity, into containers.

    Returns (length, first running number, items, items per container, first container) for each use
    of a length in a filling, and the number of containers.
    """
    index = ComplementIndex(counts)
    given: dict[int, int] = {}
    plan, bins = [], 0
    while index.bits:
        used: dict[int, int] = {}
        gap, held = capacity, index.bits.bit_length() - 1
        while gap:
            done = None
            if gap < capacity and gap <= 3 * held:
                done = index.single(gap, used) or index.pair(gap, used) or index.triple(gap, used)
            if not done:
                best = index.longest(gap, used)
                if not best:
                    break
                done = (best,)
            for x in done:
                used[x] = used.get(x, 0) + 1
                gap -= x
        times = min(index.count[x] // n for x, n in used.items())
        for x, n in used.items():
            plan.append((x, given.get(x, 0), n * times, n, bins))
            given[x] = given.get(x, 0) + n * times
            index.take(x, n * times)
        bins += times
    return plan, bins


_SIZES = "doc bigint, n_tokens bigint, part int, ranks array<int>"


def _measure(vocabulary: bytes, capacities: Sequence[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(vocabulary).encode_ordinary
        part, seen = TaskContext.get().partitionId(), [np.zeros(c + 1, np.int64) for c in capacities]
        for b in batches:
            sizes = [len(count(t)) if t else 0 for t in b.column(1).to_pylist()]
            ranks = []
            for n in sizes:
                own = []
                for c, s in zip(capacities, seen):
                    rest = n if n <= c else n % c
                    own.append(int(s[rest]))
                    s[rest] += 1
                ranks.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array([part] * len(sizes), pa.int32()), pa.array(ranks, schema.field(3).type)], schema=schema)

    return run


def _assign(plans: dict[int, dict[int, tuple[np.ndarray, ...]]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cap, rest, rank = (b.column(i).to_numpy() for i in range(3))
            bins = np.empty(len(cap), np.int64)
            for c in np.unique(cap):
                for r in np.unique(rest[cap == c]):
                    at = np.flatnonzero((cap == c) & (rest == r))
                    first, each, start = plans[int(c)][int(r)]
                    k = np.searchsorted(first, rank[at], "right") - 1
                    bins[at] = start[k] + (rank[at] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), b.column(1), pa.array(bins)], schema=schema)

    return run


def pack_texts(docs: DataFrame, doc: str, text: str, capacities: dict[str, int], vocabulary: str) -> DataFrame:
    """(container, bin, doc, piece, n_tokens): for each kind of container, where every text or piece of one lies.

    ``vocabulary``: path of a byte-level rank file, read by the driver. A text of more tokens than the capacity is cut
    into pieces of exactly the capacity, each a full bin ``d<doc>-<piece>``, and a rest that is laid like other texts (bin ``b<number>``).
    A NULL or empty text has no tokens: one row with bin NULL. doc must be a unique whole number; rows without one are left out.
    Ties don't matter: texts of one length may be exchanged. Empty tables and no capacities give no rows. Capacities below 1 are refused.
    """
    caps = dict(sorted(capacities.items()))
    if any(c < 1 for c in caps.values()):
        raise ValueError("a capacity must be at least 1")
    names, sizes_of = list(caps), sorted(set(caps.values()))
    with open(vocabulary, "rb") as f:
        content = f.read()
    schema = _parse_datatype_string(_SIZES)
    src = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null")
    sizes = materialize(src.mapInArrow(_measure(content, sizes_of, to_arrow_schema(schema)), schema), "sizes")

    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("cap"), F.when(F.col("n_tokens") <= c, F.col("n_tokens")).otherwise(F.col("n_tokens") % c).cast("int").alias("rest"), F.col("ranks")[i].alias("rank")) for i, c in enumerate(sizes_of)))) if caps else None
    if kinds is None:
        return docs.sparkSession.createDataFrame([], "container string, bin string, doc bigint, piece int, n_tokens int")
    items = sizes.select("doc", "n_tokens", "part", kinds.alias("k")).select("doc", "n_tokens", "part", "k.*")
    per_part = items.groupBy("cap", "rest", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cap", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # No more rows than the capacities' sum, whatever the number of texts.
    histogram = items.groupBy("cap", "rest").agg(F.count(F.lit(1)).alias("n")).collect()
    plans: dict[int, dict[int, tuple[np.ndarray, ...]]] = {}
    for c in set(sizes_of):
        counts = np.zeros(c + 1, np.int64)
        for r in histogram:
            if r["cap"] == c:
                counts[r["rest"]] = r["n"]
        uses: dict[int, list] = {}
        for length, first, _, each, start in plan_containers(counts, c)[0]:
            uses.setdefault(length, []).append((first, each, start))
        plans[c] = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in uses.items()}

    placed = items.filter("rest > 0").join(shifts.drop("n"), ["cap", "rest", "part"]).select("cap", "rest", (F.col("rank") + F.col("shift")).alias("rank"), "doc", "n_tokens")
    out = _parse_datatype_string("cap int, doc bigint, n_tokens bigint, rest int, bin bigint")
    placed = placed.mapInArrow(_assign(plans, to_arrow_schema(out)), out)
    whole = F.floor((F.col("n_tokens") - F.col("rest")) / F.col("cap")).cast("int")
    rests = placed.select("cap", F.concat(F.lit("b"), F.col("bin")).alias("bin"), "doc", whole.alias("piece"), F.col("rest").alias("n_tokens"))
    full = items.filter("n_tokens > cap").select("cap", "doc", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select("cap", F.concat(F.lit("d"), F.col("doc"), F.lit("-"), F.col("piece")).alias("bin"), "doc", "piece", F.col("cap").alias("n_tokens"))
    none = items.filter("n_tokens = 0").select("cap", F.lit(None).cast("string").alias("bin"), "doc", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"))
    of = F.explode(F.array(*(F.struct(F.lit(n).alias("container"), F.lit(c).alias("c")) for n, c in caps.items()))).alias("k")
    laid = rests.unionByName(full).unionByName(none)
    if len(sizes_of) == len(names):
        name = F.create_map(*(F.lit(x) for n, c in caps.items() for x in (c, n)))
        return laid.select(name[F.col("cap")].alias("container"), "bin", "doc", "piece", "n_tokens")
    return laid.select("*", of).filter("cap = k.c").select("k.container", "bin", "doc", "piece", "n_tokens")
