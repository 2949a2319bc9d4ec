"""Per-key results whose cost does not depend on how rows spread over keys.

Every input split (splits are equal in size whatever their keys) encodes its
keys by a dictionary and adds rows into dense accumulator arrays with
numpy. The arrays are cut into blocks by a hash of the key; a reducer aligns the
dictionaries of the blocks it gets and adds the arrays. A key that holds a
third of all rows reaches its reducer as one entry per split, like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.session import shuffle_partitions

#: Rows that are encoded at a time, and distinct keys that a split holds before it sends its arrays on.
CHUNK_ROWS = 262_144
HELD_KEYS = 1_000_000


def ends(whole: bool) -> tuple:
    """What is greater, and what less, than any value."""
    return (np.iinfo(np.int64).max, np.iinfo(np.int64).min) if whole else (np.inf, -np.inf)


class DenseArrays:
    """A key dictionary and, for every value, arrays of count, sum, minimum and maximum at the keys' codes; those of whole numbers are whole numbers."""

    def __init__(self, key_type: pa.DataType, whole: Sequence[bool]):
        self.keys = pa.array([], key_type)
        self.block = np.empty(0, np.int32)
        self.rows = np.empty(0, np.int64)
        self.whole = whole
        self.parts = [[np.empty(0, np.int64), *(np.empty(0, np.int64 if w else float) for _ in range(3))] for w in whole]

    def add(self, keys: pa.Array, block: np.ndarray, rows: np.ndarray, parts: list[list[np.ndarray]]) -> None:
        """Scatter-reduces entries into the arrays; an entry is a row or what another split has for a key."""
        both = pa.concat_arrays([self.keys, keys]).dictionary_encode(null_encoding="encode")
        codes, k = both.indices.to_numpy(zero_copy_only=False), len(both.dictionary)
        old = codes[: len(self.keys)]
        new = codes[len(self.keys) :]

        def spread(held: np.ndarray, fill: float) -> np.ndarray:
            out = np.full(k, fill, held.dtype)
            out[old] = held
            return out

        blocks = spread(self.block, 0)
        blocks[new] = block
        total = spread(self.rows, 0)
        np.add.at(total, new, rows)
        for i, (n, s, lo, hi) in enumerate(parts):
            held = self.parts[i]
            top, bottom = ends(self.whole[i])
            count, total_of, low, high = spread(held[0], 0), spread(held[1], 0), spread(held[2], top), spread(held[3], bottom)
            np.add.at(count, new, n)
            np.minimum.at(low, new, lo)
            np.maximum.at(high, new, hi)
            if self.whole[i]:  # a double has no room for all whole numbers
                np.add.at(total_of, new, s)
            else:
                total_of += np.bincount(new, weights=s, minlength=k)
            self.parts[i] = [count, total_of, low, high]
        self.keys, self.block, self.rows = both.dictionary, blocks, total


def _split_arrays(whole: Sequence[bool], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0

        def take() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            keys = t.column(0).combine_chunks() if t.column(0).num_chunks != 1 else t.column(0).chunk(0)
            parts = []
            for i, w in enumerate(whole):
                v = t.column(2 + i)
                ok = v.is_valid().to_numpy() if w else ~np.isnan(v.to_numpy())
                v = v.fill_null(0).to_numpy() if w else v.to_numpy()
                top, bottom = ends(w)
                parts.append([ok.astype(np.int64), np.where(ok, v, 0), np.where(ok, v, top), np.where(ok, v, bottom)])
            held.add(keys, t.column(1).to_numpy(), np.ones(len(keys), np.int64), parts)

        for b in batches:
            held = held or DenseArrays(b.column(0).type, whole)
            waiting.append(b)
            size += b.num_rows
            if size >= CHUNK_ROWS:
                take()
                waiting, size = [], 0
                if len(held.keys) > HELD_KEYS:
                    yield from _blocks(held, schema)
                    held = DenseArrays(held.keys.type, whole)
        if size:
            take()
        if held is not None and len(held.keys):
            yield from _blocks(held, schema)

    return run


def _blocks(held: DenseArrays, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each block that occurs: its keys and its cut of every array."""
    order = np.argsort(held.block, kind="stable")
    ids, starts = np.unique(held.block[order], return_index=True)
    ends = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = [held.keys.take(pa.array(order)), *(pa.array(x[order]) for x in (held.rows, *(a for p in held.parts for a in p)))]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.ListArray.from_arrays(ends, x).cast(schema.field(i + 1).type) for i, x in enumerate(lists))], schema=schema)


def _sum_blocks(whole: Sequence[bool], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0

        def take() -> None:
            cols = [pa.concat_arrays([b.column(i).flatten() for b in waiting]) for i in range(1, waiting[0].num_columns)]
            block = np.concatenate([np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())) for b in waiting])
            arrays = [c.to_numpy() for c in cols[1:]]
            held.add(cols[0], block, arrays[0], [arrays[1 + 4 * i : 5 + 4 * i] for i in range(len(whole))])

        for b in batches:
            held = held or DenseArrays(b.column(1).type.value_type, whole)
            waiting.append(b)
            size += len(b.column(1).flatten())
            if size >= max(CHUNK_ROWS, len(held.keys)):  # the dictionary is encoded again for as many entries as it has
                take()
                waiting, size = [], 0
        if size:
            take()
        if held is not None:
            out = [held.keys, pa.array(held.rows)]
            for n, s, lo, hi in held.parts:
                none = n == 0
                out += [pa.array(n), *(pa.array(x, mask=none) for x in (s, lo, hi))]
            yield from pa.Table.from_arrays(out, schema=schema).to_batches(65_536)

    return run


def key_totals(df: DataFrame, key: str, values: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Rows per key, and count, sum, minimum and maximum of each value column, by dense accumulator arrays.

    Columns: ``key`` (the type of the key column), ``n_rows``, and for the value column ``v``
    ``v_count``, ``v_sum``, ``v_min``, ``v_max``. NULL is a key of its own. NULL and NaN values count
    in ``n_rows`` only; a key without any other value has count 0 and NULL for the rest. Whole numbers are
    summed as such, all others as doubles. Repeated rows count as often as they occur. An empty table gives no rows.
    Other columns of df are not read.
    """
    whole = [df.schema[v].dataType.typeName() in ("byte", "short", "integer", "long") for v in values]
    kind = ["bigint" if w else "double" for w in whole]
    blocks = blocks or 4 * shuffle_partitions(df)
    k = F.col(f"`{key}`")
    src = df.select(k.alias("key"), F.pmod(F.xxhash64(k), F.lit(blocks)).cast("int").alias("block"), *((F.col(f"`{v}`").cast("bigint") if w else F.coalesce(F.col(f"`{v}`").cast("double"), F.lit(float("nan")))).alias(f"v{i}") for i, (v, w) in enumerate(zip(values, whole))))
    key_sql = src.schema["key"].dataType.simpleString()
    parts = [f"c{i}{p} array<{t}>" for i, k in enumerate(kind) for p, t in (("n", "bigint"), ("s", k), ("l", k), ("h", k))]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    mid = _parse_datatype_string(", ".join(["block int", f"ks array<{key_sql}>", "rs array<bigint>", *parts]))
    end = _parse_datatype_string(", ".join([f"key {key_sql}", "n_rows bigint", *(f"`{v}_{p}` {t}" for v, k in zip(values, kind) for p, t in (("count", "bigint"), ("sum", k), ("min", k), ("max", k)))]))
    arrays = src.mapInArrow(_split_arrays(whole, to_arrow_schema(mid)), mid)
    return arrays.repartition(shuffle_partitions(df), "block").mapInArrow(_sum_blocks(whole, to_arrow_schema(end)), end)


def heavy_keys(df: DataFrame, key: str, share: float = 0.03) -> DataFrame:
    """(key_value, n_rows) of the keys that hold more than ``share`` of all rows.

    The number of rows comes from the files' own counts. NULL counts in the whole but is no key; the
    empty string is one. There are fewer than 1/share such keys whatever the size.
    """
    whole = df.count()
    return key_totals(df, key).filter(F.col("key").isNotNull() & (F.col("n_rows") > F.lit(share * whole))).select(F.col("key").cast("string").alias("key_value"), "n_rows")
