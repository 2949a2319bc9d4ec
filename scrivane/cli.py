"""Command line: analyze, compare, scan, discover, track, worker, patterns.

    python -m scrivane.cli [--patterns-dir DIR] [--output terminal|json] COMMAND ...

Pages come from tables or files; URLs are fetched by a Python function if one is named (--fetcher module:function), else over HTTP.
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.text import authority, base_url, word_count
from scrivane.operators import analytics
from scrivane.operators.detectors import long_results, score_documents
from scrivane.operators.scoring import model_similarity, similarity_map
from scrivane.operators.store import VersionedTable
from scrivane.patterns.library import HERE, load_patterns, load_weights, patterns_table, profile, profiles_table
from scrivane.session import local_session
from scrivane.sources import discovery, documents, output
from scrivane.streaming.refresh import SCANS, SCORES, Refresher
from scrivane.streaming.worker import run_worker

#: Fewest words of a page that is kept when many are scanned, and below which a single one is warned of.
SCAN_WORDS, WARN_WORDS = 50, 100


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scrivane")
    p.add_argument("--patterns-dir", default=os.environ.get("SCRIVANE_PATTERNS_DIR", str(HERE)))
    p.add_argument("--output", choices=["terminal", "json"], default="terminal")
    p.add_argument("--store", default="scrivane-store", help="folder of the tables")
    p.add_argument("--fetcher", help="module:function from a URL to (status, URL, markup) or (URL, markup)")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("analyze", help="score one file, URL or text")
    c.add_argument("target", nargs="?")
    c.add_argument("--text")
    c.add_argument("--compare-model")
    c = sub.add_parser("compare", help="score several files or URLs and rank them")
    c.add_argument("targets", nargs="+")
    c = sub.add_parser("scan", help="score the URLs of a list")
    c.add_argument("--batch", required=True)
    c.add_argument("--save", action="store_true")
    c.add_argument("--min-words", type=int, default=SCAN_WORDS)
    c.add_argument("--no-skip-existing", action="store_true")
    c = sub.add_parser("discover", help="URLs of a site from its sitemaps and feeds, fetched or saved as files")
    c.add_argument("domain")
    c.add_argument("--bodies", help="folder with sitemap and feed documents; without it they are fetched")
    c.add_argument("--type", choices=["auto", "sitemap", "rss"], default="auto")
    c.add_argument("-o", "--out")
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--filter-ext", default=".html,.htm,/")
    c = sub.add_parser("track", help="scan what is new or stale of a list of a site's URLs")
    c.add_argument("--urls", required=True)
    c.add_argument("--limit", type=int, default=100)
    c.add_argument("--skip-patterns", default="")
    c.add_argument("--no-skip-existing", action="store_true")
    c.add_argument("--rescan-stale", action="store_true")
    c = sub.add_parser("worker", help="discover and scan sites in cycles, or merge documents that arrive as files")
    c.add_argument("--inbox", help="folder of parquet files with url, domain, file_path, text, scanned_at, published_date, title; without it sites are scanned")
    c.add_argument("--domains-file")
    c.add_argument("--exclude-domains-file")
    c.add_argument("--failed-log")
    c.add_argument("--limit", type=int, default=200)
    c.add_argument("--trending", type=int, default=0, help="hosts of top stories to add in each cycle")
    c.add_argument("--fresh", type=int, default=0, help="hosts of new stories to add in each cycle")
    c.add_argument("--skip-patterns", default="")
    c.add_argument("--no-skip-existing", action="store_true")
    c.add_argument("--no-rescan-stale", action="store_true")
    c.add_argument("--interval", type=int, default=60, help="minutes")
    c.add_argument("--max-cycles", type=int, default=0, help="1: take what is there and end")
    c = sub.add_parser("patterns", help="the pattern library")
    c.add_argument("what", choices=["list", "versions", "show"])
    c.add_argument("id", nargs="?")
    return p


def _fetcher(name: str | None):
    if not name:
        return discovery.http_fetcher()
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _pages(spark: SparkSession, urls: DataFrame, args) -> DataFrame:
    got = discovery.fetch_pages(urls, _fetcher(args.fetcher)).filter("html is not null")
    docs = documents.documents_from_pages(got)
    return docs.select("url", "domain", F.lit(None).cast("string").alias("file_path"), "text", "raw_html", F.lit(datetime.now(timezone.utc)).alias("scanned_at"), F.lit(None).cast("date").alias("published_date"), "title")


def _targets(spark: SparkSession, targets: list[str], args) -> DataFrame:
    urls = [t for t in targets if t.startswith(("http://", "https://"))]
    files = [t for t in targets if t not in urls]
    parts = [documents.read_files(spark, f).select(F.col("file_path").alias("source"), "text", "raw_html") for f in files]
    if urls:
        parts.append(_pages(spark, spark.createDataFrame([(u,) for u in urls], "url string"), args).select(F.col("url").alias("source"), "text", "raw_html"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _show(df: DataFrame, args, one: bool = False) -> None:
    if args.output == "json":
        print(output.json_text(df, one))
    else:
        print(output.table_text(df))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or local_session()
    patterns, weights = load_patterns(args.patterns_dir), load_weights(args.patterns_dir)
    scans, scores = VersionedTable(spark, f"{args.store}/scans"), VersionedTable(spark, f"{args.store}/scores")
    if args.command == "patterns":
        table = patterns_table(spark, patterns)
        if args.what == "versions":
            table = analytics.pattern_status(scores.read(SCORES).withColumnRenamed("scan_key", "scan_id"), table)
        elif args.what == "show":
            table = table.filter(F.col("id") == args.id)
        else:
            table = table.select("id", "category", "weight", "detection_type", "version", "severity").orderBy(F.desc("weight"), "id")
        return _show(table, args)
    if args.command in ("analyze", "compare"):
        if args.command == "analyze" and args.text is not None:
            docs = documents.from_texts(spark, [args.text]).select(F.lit("text").alias("source"), "text", F.lit(None).cast("string").alias("raw_html"))
        else:
            docs = _targets(spark, [args.target] if args.command == "analyze" else args.targets, args)
        scored = score_documents(docs, patterns, weights, raw_html="raw_html").cache()
        if args.command == "compare":
            ranked = analytics.rank_results(scored.select(F.col("source").alias("url"), F.col("index").alias("score"), F.col("verdict").alias("label"), "categories"))
            return _show(ranked, args)
        if (row := scored.select("n_words").first()) and row[0] < WARN_WORDS:
            print(f"warning: only {row[0]} words", file=sys.stderr)
        result = scored.select("source", "n_words", F.col("index").alias("score"), F.col("verdict").alias("label"), "categories", "results")
        if args.compare_model:
            chosen = profiles_table(spark, {args.compare_model: profile(args.compare_model, args.patterns_dir)})
            near = similarity_map(model_similarity(long_results(scored, ["source"]), chosen, ["source"]), ["source"])
            result = result.join(near, "source", "left")
        if args.output == "terminal":
            _show(output.category_table(scored.select("source", "categories")), args)
        return _show(result if args.output == "json" else result.drop("results", "categories"), args, one=True)
    if args.command == "discover":
        if not args.bodies:
            sites = spark.createDataFrame([(args.domain,)], "site string").select(base_url(F.col("site")).alias("base"))
            found = discovery.discover_urls(sites, _fetcher(args.fetcher), args.type).filter("url is not null").select("base", "url").cache()
            base = found.select("base").first()
            urls = analytics.article_urls(found.select("url"), base[0] if base else "", [e for e in args.filter_ext.split(",") if e]).orderBy("url")
            urls = urls.limit(args.limit) if args.limit else urls
            return output.write_urls(urls, args.out) if args.out else _show(urls, args)
        bodies = documents.read_files(spark, args.bodies).select(F.lit(args.domain).alias("site"), F.col("text").alias("body")).withColumn("base", base_url(F.col("site")))
        urls = discovery.sitemap_urls(bodies).unionByName(discovery.feed_urls(bodies)).select("url").distinct()
        base = bodies.select("base").first()
        urls = analytics.article_urls(urls, base[0] if base else "", [e for e in args.filter_ext.split(",") if e]).orderBy("url")
        urls = urls.limit(args.limit) if args.limit else urls
        return output.write_urls(urls, args.out) if args.out else _show(urls, args)
    if args.command == "worker" and not args.inbox:
        lines = lambda p: documents.domain_list(spark.read.text(p)) if p else spark.createDataFrame([], "domain string")
        run_worker(
            Refresher(spark, args.store, patterns, weights), lines(args.domains_file), _fetcher(args.fetcher), args.max_cycles, args.interval, args.failed_log, lines(args.exclude_domains_file), args.trending, args.fresh,
            limit=args.limit, skip=[s for s in args.skip_patterns.split(",") if s], skip_existing=not args.no_skip_existing, rescan_stale=not args.no_rescan_stale,
        )
        return None
    if args.command == "worker":
        stream = spark.readStream.schema("url string, domain string, file_path string, text string, scanned_at timestamp, published_date date, title string").parquet(args.inbox)
        query = Refresher(spark, args.store, patterns, weights).run(stream, None if args.max_cycles == 1 else f"{max(args.interval, 1)} minutes")
        return query.awaitTermination()
    found = documents.read_url_list(spark, args.batch if args.command == "scan" else args.urls)
    old = scans.read(SCANS)
    if args.command == "track":
        current = patterns_table(spark, patterns)
        own = scores.read(SCORES).withColumnRenamed("scan_key", "scan_id")
        stale = analytics.stale_urls(old.withColumn("id", F.col("scan_key")), own, current) if args.rescan_stale else None
        found = analytics.work_list(found, old, stale, not args.no_skip_existing, [s for s in args.skip_patterns.split(",") if s]).orderBy("url").limit(args.limit)
    elif args.save and not args.no_skip_existing:
        found = analytics.new_urls(found, old)
    least = args.min_words if args.command == "scan" else SCAN_WORDS
    pages = _pages(spark, found, args)
    if args.command == "track" or args.save:
        Refresher(spark, args.store, patterns, weights).merge(pages.filter(word_count(F.col("text")) >= least))
        return _show(analytics.domain_stats(scans.read(SCANS)), args)
    scored = score_documents(pages, patterns, weights, raw_html="raw_html").filter(F.col("n_words") >= least)
    return _show(analytics.rank_results(scored.select("url", authority(F.col("url")).alias("domain"), F.col("index").alias("score"), F.col("verdict").alias("label"))), args)


if __name__ == "__main__":
    main()
