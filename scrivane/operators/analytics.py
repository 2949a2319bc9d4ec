"""Analytic queries on scans and pattern scores.

scans: one row per scan (id, url, domain, score, label, categories, scanned_at, published_date, title ...). Ties are settled by url and id.
Averages are rounded half to even where the result is a statistic of one domain, half away from zero in overviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivane.operators.scoring import AI, BETWEEN, HUMAN
from scrivane.patterns.library import CATEGORIES
from scrivane.session import broadcast_small


def _labels() -> list[Column]:
    return [F.sum(F.when(F.col("label") == x, 1).otherwise(0)).alias(n) for n, x in (("likely_human", HUMAN), ("uncertain", BETWEEN), ("likely_ai", AI))]


def leaderboard(scans: DataFrame, limit: int = 50, offset: int = 0, label: str | None = None) -> DataFrame:
    """Scans by score, highest first."""
    if label:
        scans = scans.filter(F.col("label") == label)
    return scans.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("url"), "id").offset(offset).limit(limit)


def domain_stats(scans: DataFrame, domain: str | None = None) -> DataFrame:
    """Count, mean, extremes, last scan and labels of one domain or of each. A domain without scans gives a row of 0 if named."""
    measures = [F.count(F.lit(1)).alias("scans"), F.bround(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.max("scanned_at").alias("latest"), *_labels()]
    if domain is not None:
        return scans.filter(F.col("domain") == domain).agg(*measures).select(F.lit(domain).alias("domain"), "*")
    return scans.groupBy("domain").agg(*measures)


def global_stats(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count(F.lit(1)).alias("scans"), F.countDistinct("domain").alias("domains"), F.round(F.avg("score"), 1).alias("avg_score"), *_labels())


def domain_leaderboard(scans: DataFrame, limit: int | None = 100) -> DataFrame:
    """(domain, scans, avg_score, max_score, latest, place): domains by mean score, best first; for no limit all of them, without order and place.

    One aggregation; a heavy domain is one row of each split before it is shuffled.
    """
    measures = [F.count(F.lit(1)).alias("scans"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), F.max("scanned_at").alias("latest")]
    board = scans.filter("domain <> ''").groupBy("domain").agg(*measures)
    if limit is None:
        return board
    order = [F.desc_nulls_last("avg_score"), F.asc("domain")]
    return board.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy("place")  # no more rows than the limit


def leaderboard_percentile(board: DataFrame) -> DataFrame:
    """board with the share, in percent, of its domains whose mean is not greater."""
    steps = board.groupBy("avg_score").agg(F.count(F.lit(1)).alias("n"))  # rounded scores, a few thousand at most
    upto = steps.withColumns({"upto": F.sum("n").over(Window.orderBy(F.asc_nulls_last("avg_score"))), "total": F.sum("n").over(Window.partitionBy())})
    return board.join(upto.drop("n"), "avg_score").select(*board.columns, F.round(F.col("upto") / F.greatest("total", F.lit(1)) * 100).cast("int").alias("percentile"))


def quiet_domains(scans: DataFrame, most: float) -> DataFrame:
    """Domains whose mean score, not rounded, is at most so much."""
    return scans.filter("domain <> ''").groupBy("domain").agg(F.avg("score").alias("avg")).filter(F.col("avg") <= most).select("domain", F.round("avg", 1).alias("avg_score"))


def corpus_percentile(scans: DataFrame, score: int) -> DataFrame:
    """Share of all scans with a score up to this, to three digits; 0 for none."""
    return scans.agg(F.bround(F.coalesce(F.try_divide(F.sum(F.when(F.col("score") <= score, 1).otherwise(0)), F.count(F.lit(1))), F.lit(0.0)), 3).alias("percentile"))


def score_percentiles(scans: DataFrame) -> DataFrame:
    """The same for every score that occurs: a table of the scores, 0 to 100, summed up in order."""
    per = scans.groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # no more rows than scores
    upto = F.sum(F.when(F.col("score").isNotNull(), F.col("n")).otherwise(0)).over(Window.orderBy(F.asc_nulls_first("score")))
    return per.withColumn("p", F.bround(upto / F.sum("n").over(Window.partitionBy()), 3)).filter("score is not null").select("score", F.col("p").alias("percentile"))


def domain_trend(scans: DataFrame, domain: str | None = None, last: int | None = None) -> DataFrame:
    """Scans that have a date of publication, oldest first; with ``last``, the newest so many of each domain."""
    dated = scans.filter("published_date is not null")
    if domain is not None:
        dated = dated.filter(F.col("domain") == domain)
    if last is not None:
        w = Window.partitionBy("domain").orderBy(F.desc("published_date"), F.asc_nulls_last("url"), "id")
        dated = dated.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= last).drop("__n")
    return dated.orderBy("domain", "published_date", F.asc_nulls_last("url"), "id")


def monthly_trend(scans: DataFrame, date: str) -> DataFrame:
    return scans.filter(F.col(date).isNotNull()).groupBy("domain", F.date_format(F.trunc(date, "month"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("scans"), F.round(F.avg("score"), 6).alias("avg_score"))


_ORDERS = {"recent": lambda: [F.desc_nulls_last("scanned_at")], "highest": lambda: [F.desc_nulls_last("score")], "lowest": lambda: [F.asc_nulls_last("score")]}


def domain_scans(scans: DataFrame, limit: int = 200, sort: str = "recent", domain: str | None = None) -> DataFrame:
    """The first scans of one domain or of each in an order. Spark cuts each domain in every partition before it shuffles."""
    order = [*_ORDERS[sort](), F.asc_nulls_last("url"), "id"]
    if domain is not None:
        return scans.filter(F.col("domain") == domain).orderBy(*order).limit(limit)
    return scans.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(*order))).filter(F.col("place") <= limit)


def domain_extremes(scans: DataFrame, n: int = 5, min_words: int = 100) -> DataFrame:
    """The n highest and n lowest scans of each domain among those of more than min_words words."""
    long = scans.filter((F.col("word_count") > min_words) & F.col("score").isNotNull())
    parts = [domain_scans(long, n, s).withColumn("side", F.lit(s)) for s in ("highest", "lowest")]
    return parts[0].unionByName(parts[1])


def category_averages(scans: DataFrame, recent: int = 20) -> DataFrame:
    """Mean of each category over the newest scans of each domain."""
    new = domain_scans(scans, recent, "recent")
    return new.groupBy("domain").agg(F.count(F.lit(1)).alias("scans"), *(F.round(F.avg(F.col("categories")[c]), 6).alias(c) for c in CATEGORIES))


def pattern_stats(scores: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Mean score and rows of each pattern, highest first; NaN counts as no score. With a catalog, what it says of the pattern follows (NULL for one it doesn't have)."""
    v = F.when(~F.isnan("norm_score"), F.col("norm_score"))
    stats = scores.groupBy("pattern_id").agg(F.min("category").alias("category"), F.round(F.avg(v), 6).alias("avg_score"), F.count(F.lit(1)).alias("occurrences"))
    if catalog is not None:
        stats = stats.join(catalog.select(F.col("id").alias("pattern_id"), "name", "description", "detection_type", "version", "severity"), "pattern_id", "left")
    return stats.orderBy(F.desc_nulls_last("avg_score"), "pattern_id")


def pattern_versions(scores: DataFrame) -> DataFrame:
    return scores.groupBy("pattern_id").agg(F.max("pattern_version").alias("max_version"), F.countDistinct("scan_id").alias("scan_count"))


def pattern_status(scores: DataFrame, patterns: DataFrame) -> DataFrame:
    """What is loaded against what is stored: new, STALE or ok."""
    stored = pattern_versions(scores)
    status = F.when(F.col("max_version").isNull(), "new").when(F.col("max_version") < F.col("version"), "STALE").otherwise("ok")
    return patterns.select(F.col("id").alias("pattern_id"), "version").join(stored, "pattern_id", "left").select("pattern_id", "version", "max_version", F.coalesce("scan_count", F.lit(0)).alias("scan_count"), status.alias("status"))


def stale_urls(scans: DataFrame, scores: DataFrame, patterns: DataFrame, domain: str | None = None) -> DataFrame:
    """URLs with a score of an older version or, where the pattern has a hash, another hash. A pattern that is new makes none stale.

    The patterns are a dimension; what is joined to the scans is one row per stale scan.
    """
    current = patterns.select(F.col("id").alias("pattern_id"), F.col("version").alias("__v"), F.coalesce("hash", F.lit("")).alias("__h"))
    old = (F.col("pattern_version") < F.col("__v")) | ((F.col("__h") != "") & (F.coalesce("pattern_hash", F.lit("")) != F.col("__h")))
    stale = scores.select("scan_id", "pattern_id", "pattern_version", "pattern_hash").join(broadcast_small(current), "pattern_id").filter(old).select(F.col("scan_id").alias("id")).distinct()
    own = scans.filter("url is not null")
    if domain is not None:
        own = own.filter(F.col("domain") == domain)
    return own.select("id", "url").join(stale, "id", "left_semi").select("url").distinct()


def new_urls(found: DataFrame, scans: DataFrame) -> DataFrame:
    """Found URLs that haven't been scanned."""
    return found.join(scans.select("url").filter("url is not null"), "url", "left_anti")


def work_list(found: DataFrame, scans: DataFrame, stale: DataFrame | None = None, skip_existing: bool = True, skip: list[str] | None = None) -> DataFrame:
    """(url): what to scan. Stale URLs come first and whatever they contain; with any of them, URLs that exist are always left out otherwise."""
    wanted = without_patterns(found.select("url").filter("url is not null"), skip or []).distinct()
    if stale is not None and stale.limit(1).count():
        return stale.select("url").unionByName(new_urls(wanted, scans)).distinct()
    return new_urls(wanted, scans) if skip_existing else wanted


def without_patterns(urls: DataFrame, skip: list[str]) -> DataFrame:
    """URLs that contain none of the strings."""
    for s in skip:
        urls = urls.filter(~F.contains("url", F.lit(s)))
    return urls


def article_urls(urls: DataFrame, base: str, endings: list[str]) -> DataFrame:
    """URLs that end in one of the endings or have a path of more than one part; all of them if fewer than three are left."""
    rest = F.regexp_replace(F.substring(F.col("url"), len(base) + 1, 1_000_000), "^/+", "")
    keep = F.contains(rest, F.lit("/"))
    for e in endings:
        keep = keep | F.endswith("url", F.lit(e))
    kept = urls.filter(keep)
    return kept if kept.limit(3).count() == 3 else urls


def site_article_urls(urls: DataFrame, endings: list[str]) -> DataFrame:
    """article_urls for the URLs of many sites at once: (base, url) -> (base, url), where a site with fewer than three article URLs keeps all."""
    rest = F.regexp_replace(F.expr("substring(url, length(base) + 1)"), "^/+", "")
    keep = F.contains(rest, F.lit("/"))
    for e in endings:
        keep = keep | F.endswith("url", F.lit(e))
    flagged = urls.select("base", "url", keep.alias("keep"))
    few = flagged.groupBy("base").agg(F.sum(F.col("keep").cast("int")).alias("n")).filter("n < 3").select("base")
    return flagged.filter("keep").select("base", "url").unionByName(flagged.filter("not keep").join(few, "base", "left_semi").select("base", "url"))


def trending_domains(stories: DataFrame, excluded: DataFrame, top: int = 25, least: int = 2, limit: int = 500) -> DataFrame:
    """(domain, stories) of the hosts with most stories among the first ``limit``; of equal ones the first to be seen."""
    from scrivane.functions.text import host

    first = stories.filter("url is not null").orderBy("position").limit(limit).withColumn("domain", host(F.col("url")))
    own = first.filter("domain is not null").join(broadcast_small(excluded.select("domain")), "domain", "left_anti")
    return own.groupBy("domain").agg(F.count(F.lit(1)).alias("stories"), F.min("position").alias("first")).filter(F.col("stories") >= least).orderBy(F.desc("stories"), "first").limit(top).select("domain", "stories")


def rank_results(scored: DataFrame) -> DataFrame:
    """Highest score first, by a sort over ranges that needs no single task."""
    return scored.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("url"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Per status: domains and pages saved."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("domains"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))


def scan_status(outcomes: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """(domain, status, at): the newest outcome of each domain; with ``domains``, of these, "unknown" where there is none."""
    last = outcomes.groupBy("domain").agg(F.max(F.struct("at", "status")).alias("m")).select("domain", F.col("m.status").alias("status"), F.col("m.at").alias("at"))
    if domains is None:
        return last
    return domains.select("domain").distinct().join(last, "domain", "left").select("domain", F.coalesce("status", F.lit("unknown")).alias("status"), "at")


def category_report(scores: DataFrame) -> DataFrame:
    """Mean and rows by category and pattern, with subtotals."""
    v = F.when(~F.isnan("norm_score"), F.col("norm_score"))
    return scores.rollup("category", "pattern_id").agg(F.round(F.avg(v), 6).alias("avg_score"), F.count(F.lit(1)).alias("n"))
