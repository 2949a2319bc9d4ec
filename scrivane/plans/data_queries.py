"""Queries on the core operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.operators.heavy_keys import heavy_keys, key_totals
from scrivane.operators.timestamps import normalize_times
from scrivane.session import table


def one_per_scan(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """A scan that was delivered more than once counts once."""
    return table(spark, d, "scans").select("id", *columns).dropDuplicates(["id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [heavy_keys(table(spark, d, t), c).select(F.lit(f"{t}.{c}").alias("field_name"), "key_value") for t, c in (("scans", "domain"), ("pattern_scores", "scan_id"))]
    return parts[0].unionByName(parts[1])


def p3_domain_totals(spark: SparkSession, d: str) -> DataFrame:
    t = key_totals(table(spark, d, "scans"), "domain", ["score", "word_count"])
    return t.select(F.col("key").alias("domain"), "n_rows", "score_count", F.col("score_sum").cast("bigint").alias("score_sum"), F.col("score_min").cast("bigint").alias("score_min"), F.col("score_max").cast("bigint").alias("score_max"), F.col("word_count_sum").cast("bigint").alias("word_count_sum"))


def p3_scan_totals(spark: SparkSession, d: str) -> DataFrame:
    t = key_totals(table(spark, d, "pattern_scores"), "scan_id", ["norm_score"])
    return t.select(F.col("key").alias("scan_id"), "n_rows", F.col("norm_score_count").alias("n_scores"), F.round("norm_score_sum", 6).alias("sum_scores"), F.col("norm_score_max").alias("top_score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scans = one_per_scan(spark, d, "scanned_at", "published_date", "node")
    times = normalize_times(scans, ["scanned_at", "published_date"], ["id"], "node", table(spark, d, "worker_nodes"))
    return times.filter("value_utc is not null").select("field_name", F.col("id").alias("scan_id"), "value_utc")


QUERIES = {f.__name__: f for f in (p3_found, p3_domain_totals, p3_scan_totals, p6_found)}

SQL = {
    "p3_found": """
        select 'scans.domain' as field_name, domain as key_value from scans where domain is not null group by domain having count(*) > 0.03 * (select count(*) from scans)
        union all select 'pattern_scores.scan_id', cast(scan_id as varchar) from pattern_scores where scan_id is not null group by scan_id having count(*) > 0.03 * (select count(*) from pattern_scores)""",
    "p3_domain_totals": """select domain, count(*) as n_rows, count(score) as score_count, cast(sum(score) as bigint) as score_sum, cast(min(score) as bigint) as score_min,
        cast(max(score) as bigint) as score_max, cast(sum(word_count) as bigint) as word_count_sum from scans group by domain""",
    "p3_scan_totals": """with p as (select scan_id, case when isnan(norm_score) then null else norm_score end as v from pattern_scores)
        select scan_id, count(*) as n_rows, count(v) as n_scores, round(sum(v), 6) as sum_scores, max(v) as top_score from p group by scan_id""",
}
