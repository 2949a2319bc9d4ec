"""Continuous refresh: documents arrive as files, are scored in micro-batches and merged into versioned tables.

``availableNow`` takes what is there and stops, which is one cycle; a processing time keeps it going. Every table remembers the last batch that it
took in, so that one which is run again after a failure changes nothing twice. A merge rewrites the buckets of its documents' keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.operators.detectors import long_results, score_documents
from scrivane.operators.store import VersionedTable, replace_children, upsert_scans
from scrivane.patterns.library import Pattern
from scrivane.session import materialize

SCANS = "scan_key string, url string, domain string, file_path string, word_count bigint, score int, label string, categories struct<tropes:double,punctuation:double,phrases:double,structure:double,emoji:double,vocabulary:double>, scanned_at timestamp, published_date date, title string"
SCORES = "scan_key string, url string, pattern_id string, category string, raw_value double, norm_score double, pattern_version int, pattern_hash string"


def scan_key() -> Column:
    """The url; for documents without one, a hash of their path, text and time."""
    return F.coalesce("url", F.concat(F.lit("document:"), F.sha2(F.concat_ws("\0", F.coalesce("file_path", F.lit("")), F.coalesce("text", F.lit("")), F.coalesce(F.col("scanned_at").cast("string"), F.lit(""))), 256)))


def scored_batch(docs: DataFrame, patterns: list[Pattern], weights: dict[str, float], least_words: int = 0) -> DataFrame:
    """Documents with url, domain, file_path, text, scanned_at, published_date, title, and raw_html if there is any, scored once and kept as a table."""
    html = "raw_html" if "raw_html" in docs.columns else None
    scored = score_documents(docs.withColumn("scan_key", scan_key()), patterns, weights, raw_html=html).filter(F.col("n_words") >= least_words)
    return materialize(scored.drop("text", "raw_html"), "scored")


def facts(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans, pattern scores) of scored documents. Of a key that comes more than once the newest counts, for its scores."""
    scans = scored.select("scan_key", "url", "domain", "file_path", F.col("n_words").cast("bigint").alias("word_count"), F.col("index").alias("score"), F.col("verdict").alias("label"), "categories", "scanned_at", "published_date", "title")
    newest = scored.groupBy("scan_key").agg(F.max(F.struct("scanned_at", "url", "results")).alias("r")).select("scan_key", F.col("r.url").alias("url"), F.col("r.results").alias("results"))
    return scans, long_results(newest, ["scan_key", "url"]).select("scan_key", "url", "pattern_id", "category", "raw_value", "norm_score", "pattern_version", "pattern_hash")


def recently_scanned(scans: DataFrame, hours: float, now=None) -> DataFrame:
    """(domain) whose last scan is younger than so many hours."""
    now = F.current_timestamp() if now is None else F.lit(now)
    return scans.groupBy("domain").agg(F.max("scanned_at").alias("last")).filter(F.unix_timestamp(now) - F.unix_timestamp("last") < hours * 3600).select("domain")


class Refresher:
    def __init__(self, spark: SparkSession, root: str, patterns: list[Pattern], weights: dict[str, float], skip_existing: bool = False, rest_hours: float | None = None, least_words: int = 0):
        self.spark, self.patterns, self.weights, self.skip_existing, self.rest_hours, self.least_words = spark, patterns, weights, skip_existing, rest_hours, least_words
        self.scans, self.scores = VersionedTable(spark, f"{root}/scans"), VersionedTable(spark, f"{root}/scores")
        self.root = root

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> int:
        """Scores a batch and takes it into both tables; gives how many documents were scored."""
        old = self.scans.read(SCANS)
        if self.skip_existing:
            batch = batch.join(old.select("url").filter("url is not null"), "url", "left_anti")
        if self.rest_hours:
            batch = batch.join(recently_scanned(old, self.rest_hours), "domain", "left_anti")
        scored = scored_batch(batch, self.patterns, self.weights, self.least_words)
        scans, scores = facts(scored)
        self.scores.merge(scores, "scan_key", lambda was, new: replace_children(was, new, "scan_key"), SCORES, batch_id)
        self.scans.merge(scans, "scan_key", lambda was, new: upsert_scans(was, new, "scan_key"), SCANS, batch_id)
        return scored.count()

    def run(self, stream: DataFrame, every: str | None = None):
        """Starts on a stream of documents; without ``every`` it takes what is there and ends."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.merge(df, i) and None).option("checkpointLocation", f"{self.root}/_stream")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_seen(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each url once, as far as it comes again within the lateness."""
    return stream.withWatermark("scanned_at", lateness).dropDuplicatesWithinWatermark(["url"])


def score_windows(stream: DataFrame, window: str = "1 day", lateness: str | None = "1 day", time: str = "scanned_at") -> DataFrame:
    """Scans and mean score by domain and window of event time; windows that lateness has closed come out. None for a stream that has a watermark."""
    stream = stream.withWatermark(time, lateness) if lateness else stream
    return stream.groupBy(F.window(time, window), "domain").agg(F.count(F.lit(1)).alias("scans"), F.avg("score").alias("avg_score"))
