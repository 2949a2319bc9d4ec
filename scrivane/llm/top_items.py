"""The N highest-scoring items of every group, by merging sorted runs with a loser tree.

Every input split writes runs: rows ordered by group, score (highest first) and item, cut
into buckets by a hash of the group. What a run holds of a group beyond its first N different items can't be
among the group's N best, so a run carries N of each group at most, however many rows the group has. A
bucket's runs are merged by a loser tree; after N outputs every run seeks to its next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from scrivane.session import shuffle_partitions

#: Rows that a run is sorted from at a time.
RUN_ROWS = 400_000


class LoserTree:
    """A tournament of k cursors: ``tree[0]`` is the winner, every inner node keeps the loser of its match."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = heads + [None] * (self.k - len(heads))  # None: the run is at its end
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Replays the matches from leaf i to the root; while the tree is being filled, the first to come waits."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def replace(self, i: int, head) -> None:
        """Sets the head of cursor i, which must be the winner."""
        self.heads[i] = head
        self._play(i)


def merge_runs(runs: list[list[tuple]], n: int) -> Iterator[tuple]:
    """Merges runs of (group, order key, item, ...) rows; per group the first n different items.

    ``group_ends`` of a run tells where each row's group ends, so that a cursor can seek.
    """
    ends = []
    for run in runs:
        end, last = [0] * len(run), len(run)
        for i in range(len(run) - 1, -1, -1):
            if i + 1 < len(run) and run[i][0] != run[i + 1][0]:
                last = i + 1
            end[i] = last
        ends.append(end)
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    group, out, before = None, 0, None
    while (row := tree.heads[w := tree.tree[0]]) is not None:
        if row[0] != group:
            group, out, before = row[0], 0, None
        if out < n and row[1:3] != before:
            before, out = row[1:3], out + 1
            yield row
        at[w] = ends[w][at[w]] if out >= n else at[w] + 1
        tree.replace(w, runs[w][at[w]] if at[w] < len(runs[w]) else None)


def _write_runs(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(t: pa.Table) -> pa.Table:
            """Sorts and keeps n different items of each group."""
            t = t.take(pc.sort_indices(t, [("bucket", "ascending"), ("group", "ascending"), ("score", "descending"), ("item", "ascending")])).combine_chunks()
            if t.num_rows < 2:
                return t
            codes = t.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
            same = lambda c: (lambda a: a[1:] == a[:-1])(t.column(c).to_numpy())
            new_group = np.r_[True, codes[1:] != codes[:-1]]
            fresh = np.r_[True, ~(same("score") & same("item"))] | new_group
            t, new_group = t.filter(pa.array(fresh)), new_group[fresh]
            start = np.maximum.accumulate(np.where(new_group, np.arange(len(new_group)), 0))
            return t.filter(pa.array(np.arange(len(new_group)) - start < n))

        held, size = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size >= RUN_ROWS:
                held = [best(pa.concat_tables(held))]
                size = held[0].num_rows
                if size > RUN_ROWS // 2:
                    yield from _as_runs(held[0], schema)
                    held, size = [], 0
        if size:
            yield from _as_runs(best(pa.concat_tables(held)), schema)

    return run


def _as_runs(t: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its sorted run as arrays."""
    if not t.num_rows:
        return
    bucket = t.column("bucket").to_numpy()
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    offsets = pa.array(np.append(starts, len(bucket)).astype(np.int32))
    cols = [pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks()).cast(schema.field(i + 1).type) for i, c in enumerate(("group", "score", "item"))]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *cols], schema=schema)


def _merge(n: int, schema: pa.Schema):
    """Bucket after bucket, as a partition has them in order; no more than one bucket's runs are held."""

    def merged(runs: list) -> Iterator[pa.RecordBatch]:
        rows, place, last, out = list(merge_runs(runs, n)), 0, None, []
        for r in rows:
            place, last = (place + 1 if r[0] == last else 1), r[0]
            out.append(place)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], out), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None
        for b in batches:
            for i, bucket in enumerate(b.column(0).to_pylist()):
                if bucket != at:
                    yield from merged(held)
                    held, at = [], bucket
                g, s, x = (b.column(j)[i].values for j in (1, 2, 3))
                held.append(list(zip(g.to_pylist(), pc.negate(s).to_pylist(), x.to_pylist(), s.to_pylist())))
                if len(held) >= 64:  # a run of runs, so that what is held stays small
                    held = [list(merge_runs(held, n))]
        yield from merged(held)

    return run


def sorted_runs(df: DataFrame, group: str, score: str, item: str, n: int, buckets: int | None = None) -> DataFrame:
    """Bucketed runs (bucket, groups, scores, items); they may be stored, and runs of separate loads merged later."""
    buckets = buckets or 4 * shuffle_partitions(df)
    g, s, x = (F.col(f"`{c}`") for c in (group, score, item))
    src = df.select(F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int").alias("bucket"), g.alias("group"), s.alias("score"), x.alias("item"))
    src = src.filter("group is not null and score is not null and item is not null")
    if dict(src.dtypes)["score"] in ("double", "float"):
        src = src.filter(~F.isnan("score"))
    t = src.schema
    schema = StructType([StructField("bucket", IntegerType()), *(StructField(c + "s", ArrayType(t[c].dataType)) for c in ("group", "score", "item"))])
    return src.mapInArrow(_write_runs(n, to_arrow_schema(schema)), schema)


def merge_top(runs: DataFrame, n: int) -> DataFrame:
    """(group, item, score, place) from bucketed runs."""
    t = runs.schema
    schema = StructType([StructField("group", t["groups"].dataType.elementType), StructField("item", t["items"].dataType.elementType), StructField("score", t["scores"].dataType.elementType), StructField("place", LongType())])
    return runs.repartition(shuffle_partitions(runs), "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(n, to_arrow_schema(schema)), schema)


def top_items(df: DataFrame, group: str, score: str, item: str, n: int) -> DataFrame:
    """(group, item, score, place) of the n items of highest score in every group.

    Among equal scores the smaller item comes first. A row that repeats group, score and item counts once. Rows
    in which one of the three is NULL, or the score NaN, are left out; the empty string is a group like others. Groups with fewer
    items give fewer rows; an empty table gives none. Other columns of df are not read.
    """
    return merge_top(sorted_runs(df, group, score, item, n), n)
