"""Exact percentiles per group by distributed multi-select, and summaries of them that can be merged.

Every partition keeps, per group, a sorted run of its different values with counts. The runs propose the median of their part of the
range that remains for a wanted rank, the weighted median of the proposals becomes the pivot, the runs count three ways, the range without the
rank is discarded, and so on until the value is found. Every group goes this way. Only where its runs meet differs: ranges of
up to LOCAL values meet in one task, one after another; the runs of larger ones stay where they are, and what meets are proposals and counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType, _parse_datatype_string

from scrivane.session import materialize, shuffle_partitions

#: Values up to which a group's runs meet in one task; ranks of larger groups that are narrowed at once; rows that are sorted at a time.
LOCAL, AT_ONCE, RUN_ROWS = 4_096, 20_000, 500_000


def _sort_runs(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            code, value = keys.indices.to_numpy(), t.column(1).to_numpy()
            order = np.lexsort((value, code))
            code, value = code[order], value[order]
            fresh = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (value[1:] != value[:-1])])
            count = np.diff(np.r_[fresh, len(code)])
            code, value = code[fresh], value[fresh]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            offsets = pa.array(np.r_[first, len(code)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)).cast(schema.field(i).type) for i, x in ((1, value), (2, count.astype(np.int64)))]
            return pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(code[first])), *lists], schema=schema)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= RUN_ROWS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def value_runs(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, vals, counts): sorted runs. They may be kept, and those of separate loads put together."""
    src = df.select(F.col(f"`{group}`").alias("group"), F.col(f"`{value}`").cast("double").alias("v")).filter("group is not null and v is not null and not isnan(v)")
    schema = StructType([StructField("group", src.schema["group"].dataType), StructField("vals", ArrayType(DoubleType())), StructField("counts", ArrayType(LongType()))])
    return src.mapInArrow(_sort_runs(to_arrow_schema(schema)), schema)


class Range:
    """What is known of a wanted rank: values up to lo are ``below`` in number and ruled out, as are those from hi on; ``left`` remain. An end is None as long as it is open: infinities are values."""

    __slots__ = ("group", "slot", "rank", "lo", "hi", "below", "left", "value")

    def __init__(self, group, slot: int, rank: int, n: int):
        self.group, self.slot, self.rank, self.lo, self.hi, self.below, self.left, self.value = group, slot, rank, None, None, 0, n, None

    def narrow(self, pivot: float, less: int, equal: int) -> None:
        if self.rank <= self.below + less:
            self.hi, self.left = pivot, less
        elif self.rank <= self.below + less + equal:
            self.value = pivot
        else:
            self.lo, self.below, self.left = pivot, self.below + less + equal, self.left - less - equal


def _between(vals: np.ndarray, lo: float | None, hi: float | None) -> tuple[int, int]:
    return 0 if lo is None else int(np.searchsorted(vals, lo, "right")), len(vals) if hi is None else int(np.searchsorted(vals, hi, "left"))


def _over_runs(active: dict, visit, schema: pa.Schema):
    """Runs of groups in active (group -> [(number, ...)]); visit gives what a run sends for one wanted rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, g in enumerate(b.column(0).to_pylist()):
                if g in active:
                    vals, counts = b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()
                    for wanted in active[g]:
                        if (x := visit(vals, counts, *wanted)) is not None:
                            rows.append((wanted[0], *x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _propose(vals, counts, no, lo, hi, _):
    a, b = _between(vals, lo, hi)
    if a == b:
        return None
    total = np.cumsum(counts[a:b])
    return float(vals[a + np.searchsorted(total, (total[-1] + 1) // 2)]), int(total[-1])


def _count(vals, counts, no, lo, hi, pivot):
    a, b = _between(vals, lo, hi)
    p, q = a + int(np.searchsorted(vals[a:b], pivot, "left")), a + int(np.searchsorted(vals[a:b], pivot, "right"))
    return (int(counts[a:p].sum()), int(counts[p:q].sum())) if q > a else None


def select_rank(runs: list[tuple[np.ndarray, np.ndarray]], rank: int, n: int) -> float:
    """The value of a rank among runs (values in order, counts) of n values in all: the rounds that larger groups go through over partitions."""
    w = Range(None, 0, rank, n)
    while w.value is None:
        proposals = sorted(p for vals, counts in runs if (p := _propose(vals, counts, 0, w.lo, w.hi, None)))
        half, pivot = sum(x[1] for x in proposals) / 2, 0.0
        for pivot, weight in proposals:
            half -= weight
            if half <= 0:
                break
        ways = [c for vals, counts in runs if (c := _count(vals, counts, 0, w.lo, w.hi, pivot))]
        w.narrow(pivot, sum(c[0] for c in ways), sum(c[1] for c in ways))
    return w.value


def _rest(vals, counts, no, lo, hi, _):
    a, b = _between(vals, lo, hi)
    return (vals[a:b].tolist(), counts[a:b].tolist()) if b > a else None


def _select_here(quantiles: Sequence[float], wanted: dict | None, schema: pa.Schema):
    """Groups one after another, as a partition has them in order, their values at the quantiles' ranks, or with ``wanted`` at one given rank for each; no more than one group's runs are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        group, done = None, []

        def settle() -> None:
            n = int(sum(c.sum() for _, c in held))
            ranks = [rank_of(q, n) for q in quantiles] if wanted is None else [wanted[group]]
            done.append((group, n, [select_rank(held, r, n) for r in ranks]))
            held.clear()

        for b in batches:
            for i, g in enumerate(b.column(0).to_pylist()):
                if held and g != group:
                    settle()
                group = g
                held.append((b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()))
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
        if held:
            settle()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    return run


def rank_of(q: float, n: int) -> int:
    """The rank, from 1, of quantile q among n values: the least one with at least the share q of the values up to it."""
    return min(n, max(1, math.ceil(round(q * n, 9))))


def select_from_runs(runs: DataFrame, quantiles: Sequence[float], local: int = LOCAL) -> DataFrame:
    """(group, n, values): of every group the values at the quantiles' ranks, exactly. runs: see value_runs; it is read several times."""
    spark = runs.sparkSession
    sizes = runs.groupBy("group").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    few = materialize(sizes.filter(F.col("n") > local), "large")
    n_large = few.count()  # at most the number of values divided by local
    out = StructType([runs.schema["group"], StructField("n", LongType()), StructField("values", ArrayType(DoubleType()))])
    small = runs.join(few.select("group"), "group", "left_anti") if n_large else runs
    result = small.repartition(shuffle_partitions(runs), "group").sortWithinPartitions("group").mapInArrow(_select_here(quantiles, None, to_arrow_schema(out)), out)
    if not n_large:
        return result
    # The runs of large groups, in blocks of groups that are read one after another.
    blocks = -(-n_large * max(1, len(quantiles)) // AT_ONCE)
    block = F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int")
    own = runs.join(few.select("group"), "group", "left_semi").withColumn("block", block)
    large = materialize(own, "runs-of-large", "block")
    found = []
    for k in range(blocks):
        wanted = [Range(r[0], i, rank_of(q, r[1]), r[1]) for r in few.filter(block == k).collect() for i, q in enumerate(quantiles)]  # about AT_ONCE ranks
        here = large.filter(F.col("block") == k).drop("block")
        _narrow(here, wanted, local)
        left = {i: w for i, w in enumerate(wanted) if w.value is None}
        active = _grouped(left, lambda i, w: (i, w.lo, w.hi, 0.0))
        cut, one = _parse_datatype_string("no bigint, vals array<double>, counts array<bigint>"), _parse_datatype_string("no bigint, n bigint, values array<double>")
        rest = here.mapInArrow(_over_runs(active, _rest, to_arrow_schema(cut)), cut).repartition(shuffle_partitions(runs), "no").sortWithinPartitions("no")
        rest = rest.mapInArrow(_select_here((), {i: w.rank - w.below for i, w in left.items()}, to_arrow_schema(one)), one).select("no", F.col("values")[0].alias("value"))
        slots = StructType([StructField("no", LongType()), runs.schema["group"], StructField("slot", LongType()), StructField("known", DoubleType())])
        names = spark.createDataFrame([(i, w.group, w.slot, w.value) for i, w in enumerate(wanted)], slots)
        found.append(materialize(names.join(rest, "no", "left").select("group", "slot", F.coalesce("known", "value").alias("value")), "found"))
    got = found[0]
    for f in found[1:]:
        got = got.unionByName(f)
    whole = got.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda s: s["value"]).alias("values"))  # the quantiles
    return result.unionByName(whole.join(few, "group").select("group", "n", "values"))


def _grouped(wanted: dict[int, Range], entry) -> dict:
    out: dict = {}
    for i, w in wanted.items():
        out.setdefault(w.group, []).append(entry(i, w))
    return out


def _narrow(runs: DataFrame, wanted: list[Range], local: int) -> None:
    """Rounds of proposing, counting and discarding, until the value of each rank is found or what remains may meet in a task, where the rounds go on."""
    proposals = _parse_datatype_string("no bigint, median double, weight bigint")
    counted = _parse_datatype_string("no bigint, less bigint, equal bigint")
    while open_ := {i: w for i, w in enumerate(wanted) if w.value is None and w.left > local}:
        active = _grouped(open_, lambda i, w: (i, w.lo, w.hi, 0.0))
        medians = runs.mapInArrow(_over_runs(active, _propose, to_arrow_schema(proposals)), proposals)
        middle = F.percentile("median", F.lit(0.5), F.col("weight")).alias("p")
        pivots = {r[0]: 0.0 if math.isnan(r[1]) else r[1] for r in medians.groupBy("no").agg(middle).collect()}  # one row for each open rank; NaN lies between the infinities
        active = _grouped(open_, lambda i, w: (i, w.lo, w.hi, pivots[i]))
        ways = runs.mapInArrow(_over_runs(active, _count, to_arrow_schema(counted)), counted)
        sums = {r[0]: r for r in ways.groupBy("no").agg(F.sum("less").alias("less"), F.sum("equal").alias("equal")).collect()}
        for i, w in open_.items():
            w.narrow(pivots[i], *((sums[i][1], sums[i][2]) if i in sums else (0, 0)))


def percentiles(df: DataFrame, group: str, value: str, quantiles: Sequence[float], local: int = LOCAL) -> DataFrame:
    """(group, n, values): per group the number of values and those at the quantiles, exact (each is a value that occurs).

    NULL and NaN values and NULL groups are left out; a group without other values has no row. Ties are values like others. Repeated rows count
    as often as they occur. Infinite values count. An empty table gives no rows; other columns are not read.
    """
    return select_from_runs(materialize(value_runs(df, group, value), "runs"), quantiles, local)


def summary(df: DataFrame, group: str, value: str, steps: int = 100, local: int = LOCAL) -> DataFrame:
    """(group, n, points): a form of bounded size that can be merged; points are (value, weight) in order of value.

    The points are the exact percentiles at i/steps; the weight of a point is the number of ranks it stands for. A quantile read
    from it is off by less than n/steps ranks, and so is one from summaries merged, n being the sum.
    """
    at = percentiles(df, group, value, [i / steps for i in range(steps + 1)], local)
    rank = lambda i: F.greatest(F.lit(1).cast("bigint"), F.ceil(i * F.col("n") / steps))
    points = F.transform("values", lambda v, i: F.struct(v.alias("value"), F.when(i == 0, F.lit(1).cast("bigint")).otherwise(rank(i) - rank(i - 1)).alias("weight")))
    return at.select("group", "n", F.filter(points, lambda p: p["weight"] > 0).alias("points"))


def _thin(steps: int, schema: pa.Schema):
    """Points in order of value, of which each step of n/steps ranks keeps the last, with the weight of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = []
            for own in b.column(2).to_pylist():
                own.sort(key=lambda p: p["value"])
                total = sum(p["weight"] for p in own)
                out, upto, last = [], 0, -1
                for p in own:
                    upto += p["weight"]
                    step = -(-upto * steps // total)
                    if step == last and len(own) > steps + 1:
                        out[-1] = {"value": p["value"], "weight": out[-1]["weight"] + p["weight"]}
                    else:
                        out.append(p)
                    last = step
                points.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(points, schema.field(2).type)], schema=schema)

    return run


def merge_summaries(parts: DataFrame, steps: int = 1000) -> DataFrame:
    """Summaries of separate loads (a union of them), merged per group into one of the same form, of about ``steps`` points at most.

    A quantile read from it is off by what the parts were off in sum, n/steps ranks more for each merge that thinned them.
    """
    joined = parts.groupBy("group").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("points")).alias("points"))  # as many points as loads times steps
    return joined.mapInArrow(_thin(steps, to_arrow_schema(joined.schema)), joined.schema)


def read_summary(summaries: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(group, n, values) from summaries."""

    def at(q: float):
        want = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(q) * F.col("n")))
        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("double").alias("value"))
        step = lambda a, p: F.struct((a["sum"] + p["weight"]).alias("sum"), F.when(a["value"].isNull() & (a["sum"] + p["weight"] >= want), p["value"]).otherwise(a["value"]).alias("value"))
        return F.aggregate("points", start, step, lambda a: a["value"])

    return summaries.select("group", "n", F.array(*(at(q) for q in quantiles)).alias("values"))
