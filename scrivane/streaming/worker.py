"""The worker's cycle: sites and trending hosts, discovery, what is new or stale, scans, outcomes."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivane.functions.text import base_url
from scrivane.operators import analytics
from scrivane.operators.store import VersionedTable
from scrivane.patterns.library import patterns_table
from scrivane.session import materialize, release
from scrivane.sources import discovery, documents
from scrivane.sources.output import append_failures
from scrivane.streaming.refresh import SCANS, SCORES, Refresher

#: What became of a site in a cycle.
SCANNED, NO_DISCOVERY, ALL_EXISTING = "scanned", "no_discovery", "all_existing"
OUTCOMES = "cycle int, domain string, status string, saved bigint, at timestamp"


def cycle_sites(refresher: Refresher, curated: DataFrame, fetch: discovery.Fetch, excluded: DataFrame | None = None, top: int = 0, fresh: int = 0, least: int = 2, stories: int = 200, fresh_stories: int = 100) -> DataFrame:
    """(domain): curated sites, which nothing excludes, and trending hosts: ``top`` of the top stories, ``fresh`` of the new ones, where one story is enough."""
    spark = refresher.spark
    out = curated.select(F.lower("domain").alias("domain"))
    no = spark.createDataFrame([(h,) for h in discovery.EXCLUDED_HOSTS], "domain string")
    if excluded is not None:
        no = no.unionByName(excluded.select("domain")).distinct()
    for kind, n, most, enough in (("top", top, stories, least), ("new", fresh, fresh_stories, 1)):
        if n > 0:
            items = discovery.stories(discovery.story_items(spark, fetch, kind, most))
            out = out.unionByName(analytics.trending_domains(items, no, n, enough, most).select("domain"))
    return out.distinct()


def scan_sites(refresher: Refresher, sites: DataFrame, fetch: discovery.Fetch, limit: int = 200, skip: list[str] | None = None, source: str = "auto", rescan_stale: bool = True, skip_existing: bool = True, least_words: int = 50, cycle: int = 1) -> DataFrame:
    """Scans up to ``limit`` pages of every site and gives the outcomes: (cycle, domain, status, saved, at). All sites go through each step together."""
    spark = refresher.spark
    sites = sites.select("domain", base_url(F.col("domain")).alias("base"))
    found = materialize(discovery.discover_urls(sites, fetch, source), "found")
    urls = found.filter("url is not null").select("base", "url", "position")
    old = refresher.scans.read(SCANS)
    wanted = analytics.without_patterns(urls, skip or [])
    wanted = analytics.new_urls(wanted, old) if skip_existing else wanted
    wanted = wanted.select("base", "url", F.lit(1).alias("rank"), "position")
    if rescan_stale:
        current, own = patterns_table(spark, refresher.patterns), refresher.scores.read(SCORES)
        stale = analytics.stale_urls(old.withColumn("id", F.col("scan_key")), own.withColumn("scan_id", F.col("scan_key")), current)
        stale = stale.select(base_url(F.col("url")).alias("base"), "url", F.lit(0).alias("rank"), F.lit(0).alias("position")).join(sites.select("base").distinct(), "base", "left_semi")
        wanted = stale.unionByName(wanted)
    first = wanted.groupBy("base", "url").agg(F.min(F.struct("rank", "position")).alias("o"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("o.rank", "o.position", "url"))).filter(F.col("n") <= limit)
    todo = materialize(first.select("base", "url"), "todo")
    pages = documents.documents_from_pages(discovery.fetch_pages(todo.select("url").distinct(), fetch).filter("html is not null"), least_words=least_words)
    pages = materialize(pages.select("url", "domain", F.lit(None).cast("string").alias("file_path"), "text", "raw_html", F.lit(datetime.now(timezone.utc)).alias("scanned_at"), F.lit(None).cast("date").alias("published_date"), "title"), "pages")
    refresher.merge(pages)
    saved = pages.groupBy(base_url(F.col("url")).alias("base")).agg(F.count(F.lit(1)).alias("saved"))
    some, asked = urls.select("base").distinct().withColumn("some", F.lit(True)), todo.select("base").distinct().withColumn("asked", F.lit(True))
    status = F.when(F.col("asked"), SCANNED).when(F.col("some"), ALL_EXISTING).otherwise(NO_DISCOVERY)
    out = sites.join(some, "base", "left").join(asked, "base", "left").join(saved, "base", "left")
    return materialize(out.select(F.lit(cycle).alias("cycle"), "domain", status.alias("status"), F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved"), F.current_timestamp().alias("at")), "outcomes")


def run_worker(refresher: Refresher, curated: DataFrame, fetch: discovery.Fetch, max_cycles: int = 0, interval_minutes: float = 60, failed_log: str | None = None, excluded: DataFrame | None = None, top: int = 0, fresh: int = 0, report=print, **scan) -> None:
    """Cycle after cycle, or ``max_cycles`` of them: outcomes are kept in the table ``outcomes``, sites without discovery also in a log."""
    log = VersionedTable(refresher.spark, f"{refresher.root}/outcomes")
    cycle = 0
    while not max_cycles or cycle < max_cycles:
        cycle += 1
        sites = materialize(cycle_sites(refresher, curated, fetch, excluded, top, fresh), "sites")
        outcomes = scan_sites(refresher, sites, fetch, cycle=cycle, **scan)
        log.merge(outcomes, "domain", lambda was, new: was.unionByName(new), OUTCOMES)
        for r in analytics.outcome_counts(outcomes).orderBy("status").collect():  # three rows
            report(f"cycle {cycle}: {r.status}: {r.domains} sites, {r.saved} pages saved")
        lost = outcomes.filter(F.col("status") == NO_DISCOVERY).select("domain")
        if failed_log and lost.limit(1).count():
            append_failures(lost, failed_log, f"cycle {cycle}, {datetime.now(timezone.utc):%Y-%m-%d %H:%M}")
        release(refresher.spark)
        if not max_cycles or cycle < max_cycles:
            time.sleep(max(interval_minutes, 1) * 60)
