"""Evaluation texts inside a corpus, by latent semantic retrieval and alignment.

One pass over the corpus reads every text whole, counts in how many documents each word of the evaluation items
stands, and keeps the passages most of whose words occur in the items: the part of a passage's TF-IDF vector that lies
outside the items' vocabulary only lowers its cosine with any item, so a passage below that share can't be near one. A
randomised SVD of the passages' TF-IDF matrix, its products summed over partitions, gives the latent space; windows of passages
whose cosine with a window of an item is high enough are candidates, and a longest common subsequence
decides. Items are a query set that is held by every task; its size is checked.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from scrivane.session import materialize, shuffle_partitions

#: Bounds of a block of the query set.
MOST_ITEMS, MOST_ITEM_WORDS = 50_000, 2_000_000
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HIDDEN = re.compile("[­​-‍⁠﻿]")


def words_of(text: str) -> list[str]:
    """Words without regard to case, punctuation, spacing, line breaks and markup."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(_HIDDEN.sub("", text).lower())


def aligned(item: list, passage: list, least: int = 16, each: int = 8) -> bool:
    """Whether the passage has the whole item, or ``least`` successive words of it, with at most one word in ``each`` changed.

    The longest common subsequence gives pairs of equal words; between two of them the changes are the words of the
    longer side; words of the item before the first and after the last may count as changed too, so that 14 equal words are enough for 16.
    """
    n, m = len(item), len(passage)
    if not n or not m:
        return False
    codes = {w: i for i, w in enumerate(set(item))}
    a = np.array([codes[w] for w in item])
    b = np.array([codes.get(w, -1) for w in passage])
    table = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(table[i + 1, :m], np.where(b == a[i], table[i + 1, 1:] + 1, 0))
        table[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < n and j < m and table[i, j]:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    want = min(least, n)
    for p in range(len(pairs)):
        cost = 0
        for q in range(p, len(pairs)):
            if q > p:
                cost += max(pairs[q][0] - pairs[q - 1][0], pairs[q][1] - pairs[q - 1][1]) - 1
            span = pairs[q][0] - pairs[p][0] + 1
            more = max(0, want - span)
            if (cost + more) * each <= span + more and span + more <= n:
                if span + more >= want:
                    return True
            elif cost * each > n:
                break
    return _in_step(a, b, want, each) if len(pairs) * each >= want * (each - 1) - each else False


def _in_step(a: np.ndarray, b: np.ndarray, want: int, each: int) -> bool:
    """The same for words that are only exchanged, on every diagonal: a repeated word can draw the subsequence off it."""
    n, m = len(a), len(b)
    sizes = sorted({want, n, *range(-(-want // each) * each, n + 1, each)})
    for d in range(1 - n, m):
        lo, hi = max(0, -d), min(n, m - d)
        if hi - lo < want:
            continue
        changed = np.concatenate([[0], np.cumsum(a[lo:hi] != b[lo + d : hi + d])])
        for size in sizes:
            if size <= hi - lo and ((changed[size:] - changed[:-size]) * each <= size).any():
                return True
    return False


_PASSAGES = "doc bigint, words array<string>, docs_with array<int>, n_docs bigint"


def _read(vocabulary: dict[str, int], window: int, need: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs = np.zeros(len(vocabulary), np.int32), 0
        get = vocabulary.get
        for b in batches:
            ids, passages = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                n_docs += 1
                codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                inside = codes >= 0
                df[np.unique(codes[inside])] += 1
                total = np.concatenate([[0], np.cumsum(inside)])
                if total[-1] < min(need, window):
                    continue
                if len(words) <= window:
                    hit = np.array([0]) if total[-1] >= need else np.empty(0, np.int64)
                else:
                    hit = np.flatnonzero(total[window:] - total[:-window] >= need)
                if len(hit):
                    breaks = np.flatnonzero(np.diff(hit) > window)
                    for s, e in zip(np.r_[0, breaks + 1], np.r_[breaks, len(hit) - 1]):
                        ids.append(doc)
                        passages.append(words[max(0, hit[s] - window // 2) : hit[e] + window + window // 2])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(passages, schema.field(1).type), pa.nulls(len(ids), schema.field(2).type), pa.nulls(len(ids), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, schema.field(1).type), pa.array([df.tolist()], schema.field(2).type), pa.array([n_docs], pa.int64())], schema=schema)

    return run


class TermSpace:
    """TF-IDF vectors of windows over the items' vocabulary; words outside it count in a window's length only."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, window: int, step: int):
        self.vocabulary, self.idf, self.window, self.step = vocabulary, idf.astype(np.float32), window, step

    def starts(self, n: int) -> np.ndarray:
        last = max(0, n - self.window)
        return np.unique(np.append(np.arange(0, last + 1, self.step), last))

    def project(self, words: list[str], basis: np.ndarray) -> np.ndarray:
        """Rows: the windows' vectors times basis."""
        codes = np.array([self.vocabulary.get(w, -1) for w in words])
        rows = np.where((codes >= 0)[:, None], self.idf[codes][:, None] * basis[codes], 0)
        total = np.concatenate([np.zeros((1, basis.shape[1]), basis.dtype), np.cumsum(rows, axis=0)])
        s = self.starts(len(words))
        return total[np.minimum(s + self.window, len(words))] - total[s]

    def spread(self, words: list[str], rows: np.ndarray, out: np.ndarray) -> None:
        """Adds the transposed matrix of the windows' vectors times rows to out."""
        for s, r in zip(self.starts(len(words)), rows):
            for w in words[s : s + self.window]:
                if (c := self.vocabulary.get(w, -1)) >= 0:
                    out[c] += self.idf[c] * r


def _blocks_sum(df: DataFrame, function, width: int, height: int) -> np.ndarray:
    """Sum over all partitions of a matrix of fixed size (the vocabulary's), added row by row in a shuffle."""
    schema = _parse_datatype_string("at int, row array<float>")
    parts = df.mapInArrow(function(to_arrow_schema(schema)), schema)
    summed = parts.repartition(shuffle_partitions(df), "at").mapInArrow(_add_rows(to_arrow_schema(schema)), schema)
    out = np.zeros((height, width), np.float64)
    for r in summed.toLocalIterator():  # no more rows than the vocabulary
        out[r[0]] += r[1]
    return out


def _add_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at in enumerate(b.column(0).to_pylist()):
                row = b.column(1)[i].values.to_numpy()
                held[at] = held[at] + row if at in held else row
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.astype(np.float32) for x in held.values()], schema.field(1).type)], schema=schema)

    return run


def _sketch(space: TermSpace, basis: np.ndarray):
    def of(schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, any_row = np.zeros((len(space.vocabulary), basis.shape[1]), np.float32), False
            for b in batches:
                for words in b.column(0).to_pylist():
                    v = space.project(words, basis)
                    space.spread(words, v, out)
                    any_row = True
            if any_row:
                at = np.flatnonzero(np.abs(out).sum(axis=1) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(out[at]), schema.field(1).type)], schema=schema)

        return run

    return of


def _search(space: TermSpace, held, item_ids: list, item_words: list[list[str]], least_cosine: float, least: int, each: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided: dict = {}
        basis, item_rows, owner = held.value
        bags = [set(w) for w in item_words]
        for b in batches:
            docs, items = [], []
            for doc, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = space.project(words, basis)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                near = np.unique(owner[(v @ item_rows.T >= least_cosine).any(axis=0)])
                for k in near.tolist():
                    want = min(least, len(item_words[k]))
                    if sum(w in bags[k] for w in words) * 2 < want:
                        continue  # half of the words at least are equal in any case
                    key = (k, tuple(words))
                    if key not in decided:
                        decided[key] = aligned(item_words[k], words, least, each)
                    if decided[key]:
                        docs.append(doc)
                        items.append(item_ids[k])
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], schema=schema)
            if len(decided) > 100_000:
                decided.clear()

    return run


def leaked_items(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = 16, each: int = 8, rank: int = 256, least_cosine: float = 0.45, seed: int = 7) -> DataFrame:
    """(doc, item), each pair once: documents that hold the whole item, or at least ``least`` successive words of it, with at most one word in ``each`` changed.

    Case, punctuation, spacing, line breaks and markup don't count. Items without words and NULL texts match nothing; items of fewer
    than ``least`` words must stand as a whole. Repeated items and documents give the pair once. ``rank`` is the dimension of the
    latent space, ``least_cosine`` the cosine in it from which a window is a candidate. Items are searched for in blocks of at most MOST_ITEMS items and
    MOST_ITEM_WORDS words, which tasks hold, with a pass over the corpus for each; items of ``least`` words or more apart from shorter ones, which need narrower windows.
    Empty tables give no rows. doc and item must be whole numbers.
    """
    spark = docs.sparkSession
    found = None
    picked = items.select(F.col(f"`{item}`").cast("bigint"), F.col(f"`{item_text}`")).dropna().distinct().orderBy(F.col(f"`{item}`"))
    for block in _item_blocks(picked.toLocalIterator(), least):
        part = _leaked(docs, doc, text, block, least, each, rank, least_cosine, seed)
        found = part if found is None else materialize(found.unionByName(part), "leaks")
    return spark.createDataFrame([], "doc bigint, item bigint") if found is None else found.distinct()


def _item_blocks(rows, least: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The query set in blocks: long items, and short ones by their number of words."""
    open_: dict[int, list] = {}
    size: dict[int, int] = {}
    for i, text in rows:
        if words := words_of(text):
            k = min(least, len(words))
            k = k if k == least or k < 4 else k - k % 4  # few blocks
            open_.setdefault(k, []).append((i, words))
            size[k] = size.get(k, 0) + len(words)
            if len(open_[k]) >= MOST_ITEMS or size[k] >= MOST_ITEM_WORDS:
                yield open_.pop(k)
                size.pop(k)
    yield from open_.values()


def _leaked(docs: DataFrame, doc: str, text: str, item_words: list[tuple[int, list[str]]], least: int, each: int, rank: int, least_cosine: float, seed: int) -> DataFrame:
    out = _parse_datatype_string("doc bigint, item bigint")
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in item_words for w in ws}))}
    window = min(least, min(len(w) for _, w in item_words))
    need = max(1, window - 2 * -(-window // each))

    src = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("doc is not null and text <> ''")
    schema = _parse_datatype_string(_PASSAGES)
    read = materialize(src.mapInArrow(_read(vocabulary, window, need, to_arrow_schema(schema)), schema), "passages")
    counts = read.filter("docs_with is not null")
    n_docs = counts.agg(F.sum("n_docs")).first()[0] or 0
    df = np.zeros(len(vocabulary))
    for r in counts.select(F.posexplode("docs_with")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # as many rows as the vocabulary
        df[r[0]] = r[1]
    space = TermSpace(vocabulary, np.log((1 + n_docs) / (1 + df)) + 1, window, 2)
    passages = read.filter("doc is not null").select("doc", "words")

    rng = np.random.default_rng(seed)
    k = min(rank, len(vocabulary))
    test = rng.standard_normal((len(vocabulary), min(k + 16, len(vocabulary)))).astype(np.float32)

    def product(basis: np.ndarray) -> np.ndarray:
        """Transposed matrix times matrix times basis, over the corpus's passages and the items."""
        basis = basis.astype(np.float32)
        total = _blocks_sum(passages.select("words"), _sketch(space, basis), basis.shape[1], len(vocabulary))
        own = np.zeros_like(basis)
        for _, w in item_words:
            space.spread(w, space.project(w, basis), own)
        return total + own

    q, _ = np.linalg.qr(product(test))
    b = q.T @ product(q)
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    basis = (q @ vectors[:, np.argsort(values)[::-1][:k]]).astype(np.float32)
    rows = [space.project(w, basis) for _, w in item_words]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    item_rows = np.concatenate(rows)
    item_rows /= np.maximum(np.linalg.norm(item_rows, axis=1, keepdims=True), 1e-9)
    held = docs.sparkSession.sparkContext.broadcast((basis, item_rows, owner))  # bounded by the block
    search = _search(space, held, [i for i, _ in item_words], [w for _, w in item_words], least_cosine, least, each, to_arrow_schema(out))
    return passages.mapInArrow(search, out)
