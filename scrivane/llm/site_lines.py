"""Lines that stand in many documents of one site.

A line is brought to tokens (lower case, white space as one blank, digit runs as a wildcard
slot) and sorted into a tree of fixed depth: site, number of tokens, first tokens; a leaf
keeps templates. Every partition grows its own trees and sends, per template, the number of documents and where
they have it; trees of all partitions are merged by adding the numbers. A line of a site with a third
of all documents reaches the merge as one entry per partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from scrivane.session import materialize

#: Tokens that lead from the root to a leaf, after the site and the number of tokens.
DEPTH = 3
#: Lines that a partition's trees hold before they are sent on.
HELD_LINES = 400_000
#: Parts that a site's rows are spread over when they meet what is known of it.
SALTS = 16
#: The slot that stands for any run of digits.
SLOT = "0"
_DIGITS = re.compile(r"\d+")


def line_template(line: str) -> str:
    """The template of a line: lower case, white space runs as one blank, digit runs as a slot; '' for an empty line."""
    return _DIGITS.sub(SLOT, " ".join(line.lower().split()))


class TokenTree:
    """site -> number of tokens -> first DEPTH tokens -> templates with their places (document, line)."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.lines = 0

    def add(self, site: str, doc: int, text: str) -> None:
        for no, line in enumerate(text.split("\n"), 1):
            if template := line_template(line):
                tokens = template.split(" ")
                node = self.root.setdefault(site, {}).setdefault(len(tokens), {})
                for t in tokens[:DEPTH]:
                    node = node.setdefault(t, {})
                node.setdefault(" ".join(tokens[DEPTH:]), {}).setdefault(doc, []).append(no)
                self.lines += 1

    def leaves(self) -> Iterator[tuple[str, str, dict[int, list[int]]]]:
        """(site, template, places), from the top of the tree down."""
        for site, by_count in self.root.items():
            for count, top in by_count.items():
                level = [("", top)]
                for _ in range(min(DEPTH, count)):
                    level = [(f"{path} {t}" if path else t, node) for path, nodes in level for t, node in nodes.items()]
                for path, leaf in level:
                    for rest, places in leaf.items():
                        yield site, f"{path} {rest}" if rest else path, places


_PARTIAL = "site string, h1 bigint, h2 bigint, n_docs bigint, docs array<bigint>, line_nos array<array<int>>"


def _grow(schema: pa.Schema):
    def send(tree: TokenTree) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(6)]
        for site, template, places in tree.leaves():
            h = xxhash.xxh3_128_intdigest(template)
            for col, x in zip(rows, (site, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), len(places), list(places), list(places.values()))):
                col.append(x)
            if len(rows[0]) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)
                rows = [[] for _ in range(6)]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TokenTree()
        for b in batches:
            for site, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                tree.add(site, doc, text)
                if tree.lines >= HELD_LINES:
                    yield from send(tree)
                    tree = TokenTree()
        yield from send(tree)

    return run


def repeated_lines(docs: DataFrame, doc: str, site: str, text: str, least_docs: int = 4, least_share: float = 0.2) -> DataFrame:
    """(doc, line_no) of each line whose template stands in at least least_docs documents of its site and in at least least_share of them.

    Lines are split at ``\\n`` and counted from 1. ``doc`` must be a whole number and unique. Documents whose site or text is NULL
    have no such lines; NULL texts don't count among a site's documents, empty ones do. The empty string is a site.
    Templates are told apart by 128-bit hashes. Empty tables give no rows; other columns are not read.
    """
    src = docs.select(F.col(f"`{site}`").alias("site"), F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text")).filter("site is not null and text is not null and doc is not null")
    schema = _parse_datatype_string(_PARTIAL)
    trees = materialize(src.mapInArrow(_grow(to_arrow_schema(schema)), schema), "trees")
    every = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Trees are merged by their numbers alone; where lines stand is asked for again, of those found only, and spread over tasks.
    sizes = src.groupBy("site").agg(F.count(F.lit(1)).alias("site_docs"))
    merged = trees.groupBy("site", "h1", "h2").agg(F.sum("n_docs").alias("in_docs")).filter(F.col("in_docs") >= least_docs).withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int"))
    often = merged.join(every(sizes), ["site", "salt"]).filter(F.col("in_docs") >= F.col("site_docs") * least_share).select("site", "h1", "h2")
    hits = trees.withColumn("salt", F.pmod(F.element_at("docs", 1), F.lit(SALTS)).cast("int")).join(every(often), ["site", "h1", "h2", "salt"], "left_semi")
    return hits.select(F.inline(F.arrays_zip("docs", "line_nos")).alias("doc", "nos")).select("doc", F.explode("nos").alias("line_no"))


def without_lines(docs: DataFrame, doc: str, text: str, lines: DataFrame) -> DataFrame:
    """docs, with the lines named in ``lines`` (doc, line_no) taken out of the text column; all other columns stay.

    A document without such lines, or with NULL text, stays as it is; one that loses all lines gets ''.
    """
    gone = lines.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line_no").alias("__gone"))  # no more than one text's lines
    kept = F.array_join(F.transform(F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x"))), lambda s: ~F.array_contains("__gone", s["n"])), lambda s: s["x"]), "\n")
    return docs.join(gone, F.col(f"`{doc}`") == F.col("__doc"), "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).drop("__doc", "__gone")
