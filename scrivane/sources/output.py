"""Results as JSON, lists and short tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.functions.text import score_bar, shorten
from scrivane.patterns.library import CATEGORIES


def as_json(df: DataFrame) -> DataFrame:
    """(json): one object per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def json_text(df: DataFrame, one: bool = False, most: int = 10_000) -> str:
    """For the screen: rows as indented JSON. More than ``most`` are refused: they belong in a file."""
    rows = [json.loads(r[0]) for r in as_json(df).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them to files instead")
    return json.dumps(rows[0] if one and rows else rows, indent=2, ensure_ascii=False)


def table_text(df: DataFrame, most: int = 1000) -> str:
    """For the screen: rows in columns; what is left out is said."""
    rows = df.limit(most + 1).collect()
    cells = [df.columns, *([_cell(x) for x in r] for r in rows[:most])]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([*lines, *([f"... and more; the first {most} rows are shown"] if len(rows) > most else [])])


def _cell(x) -> str:
    if x is None:
        return ""
    return f"{x:.2f}" if isinstance(x, float) else " ".join(str(x).split())


def category_table(scored: DataFrame) -> DataFrame:
    """(source, category, bar, norm_score, colour) from (source, categories): what is shown of one result."""
    long = scored.select("source", F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col("categories")[c].alias("norm_score")) for c in CATEGORIES))))
    return score_table(long, "category")


def write_urls(df: DataFrame, path: str) -> None:
    df.select("url").write.mode("overwrite").text(path)


def append_failures(domains: DataFrame, path: str, header: str) -> None:
    """A header and the domains in order, added to a log folder."""
    lines = domains.select(F.lit(1).alias("o"), F.col("domain").alias("value")).unionByName(domains.sparkSession.createDataFrame([(0, f"# {header}")], "o int, value string"))
    lines.coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("append").text(path)


def score_table(results: DataFrame, *also: str) -> DataFrame:
    """Rows for a terminal: source, the columns in ``also``, bar and colour of a score between 0 and 1."""
    colour = F.when(F.col("norm_score") >= 0.65, "red").when(F.col("norm_score") >= 0.35, "yellow").otherwise("green")
    return results.select(shorten(F.col("source")).alias("source"), *also, score_bar(F.col("norm_score")).alias("bar"), "norm_score", colour.alias("colour"))


def badge(stats: DataFrame) -> DataFrame:
    """(domain, text, colour) of each domain's badge, from domain_stats."""
    colour = F.when(F.col("avg_score") >= 65, "red").when(F.col("avg_score") >= 35, "yellow").otherwise("green")
    return stats.select("domain", F.format_string("style %.1f", F.col("avg_score").cast("double")).alias("text"), colour.alias("colour"))
