"""Long spans that stand letter for letter in more than one document.

Windows of hashes (winnowing) choose anchors: in any span of at least ``least`` characters, at
least one anchor is chosen, and the same one in every document that has the span. Documents that share an anchor are
held against each other at it, letter by letter, which gives the whole common span. Equal anchors at one short distance mark a
periodic stretch and are one entry; two such stretches are held against each other at all shifts of one phase, by arithmetic. Copies of one text are
one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import gcd

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from scrivane.session import materialize

_BASE = 0x9E3779B97F4A7C15 | 1
#: Characters that are hashed at a time.
CHUNK_CHARS = 1_000_000
#: Parts a class of copies is spread over when its members are looked up.
SALTS = 16


class AnchorHash:
    """Hashes of all k characters in a row, as differences of one running polynomial modulo 2**64."""

    def __init__(self, k: int):
        self.k = k
        self.power = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            m = max(n, 2 * len(self.power))
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(m - 1, _BASE, np.uint64)], dtype=np.uint64)
            back = pow(_BASE, -1, 1 << 64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(m - 1, back, np.uint64)], dtype=np.uint64)
        return self.power[:n], self.inverse[:n]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.k + 1
        power, inverse = self.powers(len(codes))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        h = (total[self.k :] - total[:n]) * inverse[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def _sliding(x: np.ndarray, w: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over every w values in a row, by running values from both ends of blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, fill, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def _chosen(texts: list[str], hasher: AnchorHash, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, position) of all chosen anchors, in that order; a hash is chosen if it is the least of some window."""
    k, most = hasher.k, np.uint64(0xFFFFFFFFFFFFFFFF)
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < k + window - 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = hasher(codes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    crossing = np.zeros(len(h) + 1, np.int32)  # sequences that reach over the end of a text
    lo = np.clip(np.maximum(ends - k + 1, 0), 0, len(h))
    np.add.at(crossing, lo, 1)
    np.add.at(crossing, np.maximum(np.clip(ends, 0, len(h)), lo), -1)
    h[np.cumsum(crossing[:-1]) > 0] = most
    least = _sliding(h, window, np.minimum, int(most))
    pad = np.zeros(window - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate([pad, least, pad]), window, np.maximum, 0) == h) & (h != most))
    owner = np.searchsorted(ends, chosen, "right")
    value, pos = h[chosen].view(np.int64), chosen - starts[owner]
    order = np.lexsort((pos, value, owner))
    return owner[order], value[order], pos[order]


def anchors(texts: list[str], hasher: AnchorHash, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the chosen (hash, position)."""
    o, v, p = _chosen(texts, hasher, window)
    cut = np.searchsorted(o, np.arange(len(texts) + 1))
    return [(v[a:b], p[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def anchor_runs(o: np.ndarray, v: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first position, distance to the last, gap) of the anchors as _chosen gives them: three or more equal ones of a text at one distance of at most k are one entry.

    The text is periodic from the first of them to the end of the last. Any other anchor has distance and gap 0. No anchor is left out.
    """
    zero = np.zeros(len(o), np.int64)
    if len(o) < 3:
        return o, v, p, zero, zero
    gap = np.where((o[1:] == o[:-1]) & (v[1:] == v[:-1]), np.diff(p), 0)
    gap[gap > k] = 0
    begin = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
    end = np.r_[begin[1:], len(gap)]
    run = (gap[begin] > 0) & (end - begin >= 2)
    begin, end = begin[run], end[run]
    held = np.zeros(len(o) + 1, np.int64)
    np.add.at(held, begin, 1)
    np.add.at(held, end + 1, -1)
    alone = np.flatnonzero(np.cumsum(held[:-1]) == 0)
    first = np.r_[alone, begin]
    order = np.argsort(o[first], kind="stable")
    reach, gaps = np.r_[zero[: len(alone)], p[end] - p[begin]], np.r_[zero[: len(alone)], gap[begin]]
    first = first[order]
    return o[first], v[first], p[first], reach[order], gaps[order]


_MARKS = "doc bigint, h1 bigint, h2 bigint, n_chars int, marks array<bigint>, places array<int>, reaches array<int>, gaps array<int>"


def _mark(k: int, window: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = AnchorHash(k)

        def send(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            owner, *found = anchor_runs(*_chosen(texts, hasher, window), k)
            digest = [xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts]
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(t))).cast(schema.field(4 + i).type) for i, (x, t) in enumerate(zip(found, (np.int64, np.int32, np.int32, np.int32)))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([(d >> 64) - (1 << 63) for d in digest], pa.int64()), pa.array([(d & ((1 << 64) - 1)) - (1 << 63) for d in digest], pa.int64()), pa.array([len(t) for t in texts], pa.int32()), *lists], schema=schema)

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_CHARS:
                    yield send(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield send(ids, texts)

    return run


def common_span(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """How far a and b agree before (i, j) and from there on."""

    def ahead(x: str, y: str, p: int, q: int) -> int:
        n, step, most = 0, 64, min(len(x) - p, len(y) - q)
        while step and n < most:
            s = min(step, most - n)
            if x[p + n : p + n + s] == y[q + n : q + n + s]:
                n, step = n + s, step * 2
            elif s == 1:
                break
            else:
                step = s // 2
        return n

    def behind(x: str, y: str, p: int, q: int) -> int:
        n, step, most = 0, 64, min(p, q)
        while step and n < most:
            s = min(step, most - n)
            if x[p - n - s : p - n] == y[q - n - s : q - n]:
                n, step = n + s, step * 2
            elif s == 1:
                break
            else:
                step = s // 2
        return n

    return behind(a, b, i, j), ahead(a, b, i, j)


def _stretch(t: str, at: int, period: int) -> tuple[int, int]:
    """Start and end of the stretch around t[at : at + period] that has this period."""
    back, on = common_span(t, t, at, at + period)
    return at - back, at + on + period


def run_spans(a: str, b: str, run_a: tuple[int, int, int], run_b: tuple[int, int, int], k: int, least: int, every: bool) -> Iterator[tuple[int, int, int]]:
    """(start_a, start_b, length) of the common spans at which an anchor of run_a meets one of run_b; runs are (first, distance to the last, gap).

    Two stretches of one period agree at all shifts of one phase, as far as both reach, and beyond only where their starts or their ends meet. With ``every`` all these
    spans are given; else so many that they cover the same characters of both texts.
    """
    (i, reach_a, gap_a), (j, reach_b, gap_b) = run_a, run_b
    word = a[i : i + k]
    g = gcd(gap_a, gap_b)
    whole = g > 0 and word == b[j : j + k] and word[g:] == word[: k - g]
    if whole:
        (a0, a1), (b0, b1) = _stretch(a, i, g), _stretch(b, j, g)
        whole = a1 >= i + reach_a + k and b1 >= j + reach_b + k
    if not whole:  # single anchors, or gaps without a period in common
        for x in range(i, i + reach_a + 1, gap_a or 1):
            for y in range(j, j + reach_b + 1, gap_b or 1):
                back, on = common_span(a, b, x, y)
                if back + on >= least:
                    yield x - back, y - back, back + on
        return
    met = {s for s in (a0 - b0, a1 - b1) if (s - i + j) % g == 0 and min(a1, b1 + s) - max(a0, b0 + s) >= g}
    for s in met:
        lo, hi = max(a0, b0 + s), min(a1, b1 + s)
        back, on = common_span(a, b, lo, lo - s)
        if back + on >= least:
            yield lo - back, lo - s - back, back + on
    if min(a1 - a0, b1 - b0) < least:
        return
    s, last = a0 + least - b1, a1 - least - b0
    s += (i - j - s) % g
    last -= (last - i + j) % g
    while s <= last:
        lo, hi = max(a0, b0 + s), min(a1, b1 + s)
        if s not in met:
            yield lo, lo - s, hi - lo
        far = s + g if every else min(last, a1 - max(a0 - s, b0), hi - b0)
        s = max(s + g, far - (far - i + j) % g)


_SPANS = "doc_a bigint, doc_b bigint, start_a int, start_b int, length int"


def _extend(k: int, least: int, every: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for da, db, i, j, ra, rb, ga, gb, ta, tb in zip(*(c.to_pylist() for c in b.columns)):
                if ga or gb:
                    for span in run_spans(ta, tb, (i, ra, ga), (j, rb, gb), k, least, every):
                        for col, x in zip(rows, (da, db, *span)):
                            col.append(x)
                    continue
                back, on = common_span(ta, tb, i, j)
                if back + on >= least:
                    for col, x in zip(rows, (da, db, i - back, j - back, back + on)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run


_SEGMENTS = "doc bigint, mark bigint, rel int, start int, size int, c1 bigint, c2 bigint"
_WINDOWS = "doc bigint, was int, start int, many boolean, c1 bigint, c2 bigint"
#: Windows that are looked at together; positions in them take the low bits of the keys that choose anchors.
BLOCK_WINDOWS, POSITION_BITS = 1 << 22, 24


def _content(t: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(t.encode("utf-8", "surrogatepass"))
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def segments(t: str, hasher: AnchorHash, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the anchor, its place in the segment, start, size): all windows of ``least`` characters, those in a row that have the same anchor as one segment.

    The anchor of a window is the place of its least hash, the first of equal ones: what it is depends on the window's characters only.
    """
    w = least - hasher.k + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    h = hasher(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(t) - least + 1
    for first in range(0, n, BLOCK_WINDOWS):
        part = h[first : min(first + BLOCK_WINDOWS, n) + w - 1]
        at = (_sliding((part & ~low) | np.arange(len(part), dtype=np.uint64), w, np.minimum, 0xFFFFFFFFFFFFFFFF) & low).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        end = np.r_[begin[1:], len(at)] - 1
        for b, e, p in zip(begin.tolist(), end.tolist(), at[begin].tolist()):
            yield int(part[p].view(np.int64)), p - b, first + b, e - b + least


def _cut(k: int, least: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = AnchorHash(k)
        for b in batches:
            rows = [(d, m, rel, s, size, *_content(t[s : s + size])) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(t) >= least for m, rel, s, size in segments(t, hasher, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _windows(least: int, schema: pa.Schema):
    """Every window of some segments of a text, by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, own in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(doc, g["start"], i, g["many"], *_content(t[i : i + least])) for g in own for i in range(g["start"], g["start"] + g["size"] - least + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


class SharedSpans:
    """The shared spans of a table of documents.

    ``classes`` (doc, class_doc, n_chars): every document and the smallest document with the same text.
    ``spans`` (doc_a, doc_b, start_a, start_b, length): every maximal common span of two classes, doc_a < doc_b, at
    least ``least`` code points long; starts count from 0. ``covering`` has the same columns and covers the same characters, with fewer of the many
    spans that two periodic stretches have in common. Documents with NULL or no text are in neither, nor are rows without
    a document number. Repeated rows of one document are taken once. Columns beside doc and text are not read.
    """

    def __init__(self, docs: DataFrame, doc: str, text: str, least: int = 320):
        if least < 16:
            raise ValueError("least must be 16 or more")
        self.least, self.k = least, least // 2
        self._src = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null and text <> ''")
        schema = _parse_datatype_string(_MARKS)
        self._marked = materialize(self._src.mapInArrow(_mark(self.k, least - self.k + 1, to_arrow_schema(schema)), schema), "marks")
        self._first = self._marked.groupBy("h1", "h2").agg(F.min("doc").alias("class_doc"))
        self.classes = _part(self._marked.select("doc", "h1", "h2", "n_chars"), "doc").join(_every(self._first), ["h1", "h2", "salt"]).select("doc", "class_doc", "n_chars").dropDuplicates(["doc"])

    @cached_property
    def _both(self) -> DataFrame:
        """Pairs of classes with an anchor in common, where it stands, and both texts."""
        heads = self._marked.join(self._first.select(F.col("class_doc").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
        posts = heads.select("doc", F.inline(F.arrays_zip("marks", "places", "reaches", "gaps")).alias("mark", "at", "reach", "gap"))
        often = posts.groupBy("mark").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("mark")
        shared = materialize(_part(posts, "doc").join(_every(often), ["mark", "salt"], "left_semi").drop("salt"), "anchors")
        side = lambda s: shared.select("mark", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "at", "reach", "gap")))
        # The second side stands once for each salt of the first: an anchor in very many documents is spread over tasks.
        pairs = _part(side("a"), "doc_a").join(_every(side("b")), ["mark", "salt"]).filter("doc_a < doc_b").drop("mark", "salt")
        texts = self._src.join(shared.select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
        both = pairs.join(texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
        return both.select("doc_a", "doc_b", "at_a", "at_b", "reach_a", "reach_b", "gap_a", "gap_b", "text_a", "text_b")

    def _extended(self, every: bool) -> DataFrame:
        out = _parse_datatype_string(_SPANS)
        return self._both.mapInArrow(_extend(self.k, self.least, every, to_arrow_schema(out)), out).distinct()

    @cached_property
    def spans(self) -> DataFrame:
        return self._extended(True)

    @cached_property
    def covering(self) -> DataFrame:
        return self._extended(False)

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all pairs of documents with a span in common, copies included."""
        one = lambda s: self.classes.select(F.col("doc").alias(f"doc_{s}"), F.col("class_doc").alias(f"class_{s}"))
        apart = self.covering.select(F.col("doc_a").alias("class_a"), F.col("doc_b").alias("class_b")).distinct()
        different = apart.join(one("a"), "class_a").join(one("b"), "class_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
        long = self.classes.filter(F.col("n_chars") >= self.least)
        copies = long.select(F.col("doc").alias("doc_a"), "class_doc").join(long.select(F.col("doc").alias("doc_b"), "class_doc"), "class_doc").filter("doc_a < doc_b").select("doc_a", "doc_b")
        return different.unionByName(copies)

    def covered(self) -> DataFrame:
        """(doc, s, e): intervals of the classes' texts, of which every window of ``least`` characters stands in another class too.

        No pairs are formed: windows with one anchor are a segment, and a segment that stands whole in several texts is one entry of each; only segments in which a
        shared stretch begins or ends are taken apart into their windows, and of equal segments one.
        """
        schema = _parse_datatype_string(_SEGMENTS)
        heads = self._src.join(self._first.select(F.col("class_doc").alias("doc")), "doc", "left_semi").dropDuplicates(["doc"])
        cut = materialize(heads.mapInArrow(_cut(self.k, self.least, to_arrow_schema(schema)), schema), "segments")
        several = cut.groupBy("mark").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("mark")
        own = materialize(_part(cut, "doc").join(_every(several), ["mark", "salt"], "left_semi").drop("salt"), "own")
        kinds = materialize(own.groupBy("mark", "c1", "c2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "start", "size")).alias("first")), "kinds")
        whole = _part(own, "doc").join(_every(kinds.filter("lo < hi").select("mark", "c1", "c2")), ["mark", "c1", "c2", "salt"], "left_semi").select("doc", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
        apart = kinds.join(kinds.filter("lo = hi").select("mark").distinct(), "mark", "left_semi").select("first.*", (F.col("lo") < F.col("hi")).alias("many"))
        # A segment may stand more than once in its only text: its other places are covered as the first is.
        asked = apart.groupBy("doc").agg(F.collect_list(F.struct("start", "size", "many")).alias("segments"))  # one text's segments
        ways = _parse_datatype_string(_WINDOWS)
        windows = materialize(heads.join(asked, "doc").select("doc", "text", "segments").mapInArrow(_windows(self.least, to_arrow_schema(ways)), ways), "windows")
        met = windows.groupBy("c1", "c2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("many").alias("many")).filter("lo < hi or many").select("c1", "c2")
        single = _part(windows.filter("not many"), "start").join(_every(met), ["c1", "c2", "salt"], "left_semi").select("doc", "was", F.col("start").alias("s"), (F.col("start") + self.least).alias("e"))
        again = own.join(kinds.filter("lo = hi").select("mark", "c1", "c2", F.col("first.start").alias("was"), F.col("first.doc").alias("doc")), ["mark", "c1", "c2", "doc"]).filter("start <> was")
        step = F.col("start") - F.col("was")
        moved = again.select("doc", "start", "was").join(single, ["doc", "was"]).select("doc", (F.col("s") + step).alias("s"), (F.col("e") + step).alias("e"))
        return whole.unionByName(single.drop("was")).unionByName(moved)

    def coverage(self) -> DataFrame:
        """(doc, class_doc, n_copies, n_chars, shared_chars): one row per document; shared_chars of its text stand in another document.

        n_copies counts the documents with the same text, itself included. A text of at least ``least`` characters with a copy is shared as a whole. Which
        documents these are is told by ``pairs``.
        """
        from pyspark.sql.window import Window

        w = Window.partitionBy("doc").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)  # one text's intervals, by running maximum
        cover = self.covered().distinct().withColumn("b", F.coalesce(F.max("e").over(w), F.lit(0))).groupBy(F.col("doc").alias("class_doc")).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "b"))).alias("c"))
        copies = self.classes.groupBy("class_doc").agg(F.count(F.lit(1)).alias("n_copies"))
        per_class = copies.join(cover, "class_doc", "left")
        whole = (F.col("n_copies") > 1) & (F.col("n_chars") >= self.least)
        return _part(self.classes, "doc").join(_every(per_class), ["class_doc", "salt"]).select("doc", "class_doc", "n_copies", "n_chars", F.when(whole, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).cast("bigint").alias("shared_chars"))


def _part(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(by, F.lit(SALTS)).cast("int"))


def _every(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
