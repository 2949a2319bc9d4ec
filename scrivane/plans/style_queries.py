"""Queries on scoring, analytics, stores and sources, and their SQL.

Detectors are also run with definitions that hit the given corpus (PROBES); they are parameters like any other.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivane.functions import text as T
from scrivane.operators import analytics as A
from scrivane.operators import detectors as D
from scrivane.operators import scoring as S
from scrivane.operators import store
from scrivane.patterns.library import Pattern, load_patterns, load_profiles, load_weights, patterns_table, profiles_table
from scrivane.sources import discovery, documents
from scrivane.sources import output as out
from scrivane.session import table

TERMS = ["the ", "not just", "—", " und ", "tion", "perhaps", "perhaps"]
WORDS = ["the", "and", "en", "la"]
MARKS = [r"[.!?]", "—", ";", r"\d+ (?:pages|Seiten|Tage)"]
TAGS = [r"<li\b[^>]*>", r"<h2\b"]
TEXT_TAGS = [r"(?m)^\s*[-*+]\s+", r"perhaps"]
PROBES = [
    Pattern("probe_terms", "terms", "phrases", 0.8, "frequency", {"terms": TERMS, "threshold_low": 5, "threshold_high": 60}),
    Pattern("probe_words", "words", "phrases", 0.4, "frequency", {"terms": WORDS, "match_mode": "exact", "threshold_low": 1, "threshold_high": 50}),
    Pattern("probe_marks", "marks", "punctuation", 0.5, "regex", {"patterns": MARKS, "threshold_low": 40, "threshold_high": 160}),
]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").select("scan_id", "url", "text", "raw_html")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    """A scan that was delivered more than once counts once."""
    return table(spark, d, "scans").dropDuplicates(["id"])


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pattern_scores")


def _ready(spark: SparkSession, d: str) -> DataFrame:
    return D.prepare(_docs(spark, d))


def _even(x):
    """Six digits, the same whatever the order of a sum was."""
    return F.round(x + 1e-9, 6) + 0.0


_D = D.DocumentColumns()


def _measure(spark: SparkSession, d: str, **columns) -> DataFrame:
    return _ready(spark, d).select("doc_id", *(c.alias(n) for n, c in columns.items()))


def word_count(spark, d):
    return _measure(spark, d, n_words=_D.n_words)


def freq_contains(spark, d):
    return _measure(spark, d, n=T.count_terms(_D.low, TERMS))


def freq_exact(spark, d):
    return _measure(spark, d, n=T.count_terms(_D.low, WORDS, exact=True))


def regex_count(spark, d):
    return _measure(spark, d, n=T.count_matches(_D.text, MARKS))


def html_regex_count(spark, d):
    return _pages(spark, d).filter("raw_html is not null").select("scan_id", T.count_matches(F.col("raw_html"), TAGS, "iuUs").alias("n"))


def html_text_fallback(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _pages(spark, d).select("scan_id", F.when(F.col("raw_html").isNotNull(), T.count_matches(F.col("raw_html"), TAGS, "iuUs")).otherwise(T.count_matches(t, TEXT_TAGS, "iuUdm")).alias("n"))


def bullet_density(spark, d):
    return _measure(spark, d, ratio=F.round(D.bullet_density(_D), 6))


def header_ratio(spark, d):
    return _measure(spark, d, ratio=F.round(D.header_ratio(_D), 6))


def paragraph_uniformity(spark, d):
    return _measure(spark, d, value=F.round(D.paragraph_uniformity(_D), 6))


def emoji_density(spark, d):
    return _measure(spark, d, ratio=F.round(D.emoji_density(_D), 6))


def sentence_split(spark, d):
    return _measure(spark, d, n_sentences=F.size(_D.sentences).cast("bigint"), n_words=F.aggregate(_D.sentences, F.lit(0.0), lambda a, s: a + s["n"]).cast("bigint"))


def sentence_burstiness(spark, d):
    return _measure(spark, d, value=F.round(D.sentence_burstiness(_D), 6))


def avg_sentence_length(spark, d):
    return _measure(spark, d, value=F.round(D.avg_sentence_length(_D), 6))


def question_rate(spark, d):
    return _measure(spark, d, share=F.round(D.question_share(_D), 6), value=F.round(D.question_rate(_D, {"threshold_high": 0.08, "score_cap": 0.7}), 6))


def type_token_ratio(spark, d):
    return _measure(spark, d, value=F.round(D.type_token_ratio(_D), 6))


def word_freq_variance(spark, d):
    """With word frequencies of the corpus itself."""
    docs = _docs(spark, d)
    scores = D.word_frequency_scores(docs, "doc_id", "text", D.zipf_table(docs, "text"), {"threshold_low": 0.7, "threshold_high": 1.25})
    return scores.select("doc_id", "zipf_raw")


def _probed(spark, d):
    return D.score_documents(_docs(spark, d), PROBES, load_weights())


def stylistic_index(spark, d):
    """Scores by the probes: raw values, categories, index and label."""
    r = lambda i: F.round(F.col("results")[i]["raw_value"], 6)
    return _probed(spark, d).select("doc_id", "n_words", r(0).alias("terms"), r(1).alias("words"), r(2).alias("marks"), F.round("categories.phrases", 6).alias("phrases"), F.round("categories.punctuation", 6).alias("punctuation"), F.col("index").cast("bigint").alias("score"), F.col("verdict").alias("label"))


def scored_documents(spark, d):
    """All patterns of the library on all documents."""
    return D.score_documents(_docs(spark, d), load_patterns(), load_weights()).select("doc_id", "n_words", "categories", F.col("index").alias("score"), F.col("verdict").alias("label"))


def scored_pages(spark, d):
    """All patterns on all pages, on their markup where there is any."""
    return D.score_documents(_pages(spark, d), load_patterns(), load_weights(), raw_html="raw_html").select("scan_id", "n_words", "categories", F.col("index").alias("score"), F.col("verdict").alias("label"))


def pattern_scores_long(spark, d):
    return D.long_results(_probed(spark, d), ["doc_id"]).select("doc_id", "pattern_id", "category", F.round("norm_score", 6).alias("norm_score"), "pattern_version")


def library_scores_long(spark, d):
    """One row for each document and pattern of the library."""
    return D.long_results(D.score_documents(_docs(spark, d), load_patterns(), load_weights()), ["doc_id"])


def normalize_clamp(spark, d):
    bounds = table(spark, d, "dim_patterns").select(F.col("id").alias("pattern_id"), *(F.get_json_object("params", f"$.{c}").cast("double").alias(c) for c in ("low", "high")))
    s = _scores(spark, d).join(F.broadcast(bounds), "pattern_id")
    return s.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.clamp(F.col("raw_value"), F.col("low"), F.col("high"))), 6).alias("avg_norm"))


def category_weighted_mean(spark, d):
    w = table(spark, d, "dim_patterns").select(F.col("id").alias("pattern_id"), "weight")
    s = _scores(spark, d).filter("norm_score is not null and not isnan(norm_score)").join(F.broadcast(w), "pattern_id")
    m = S.category_means(s, ["scan_id"])
    return m.select("scan_id", *(_even(F.col(c)).alias(c) for c in S.CATEGORIES))


def label_assignment(spark, d):
    return _scans(spark, d).filter("score is not null").select(F.col("id"), S.label_of(F.col("score")).alias("computed"))


def model_similarity(spark, d):
    own = _scores(spark, d).filter("norm_score is not null and not isnan(norm_score)").groupBy("scan_id", "pattern_id").agg(F.max("norm_score").alias("norm_score"))
    sim = S.model_similarity(own, table(spark, d, "dim_model_profiles"), ["scan_id"], 9)
    return sim.select("scan_id", "model_id", _even(F.col("similarity")).alias("similarity"))


def rank_results(spark, d):
    """The first 200 of all results, best first."""
    first = A.rank_results(_scans(spark, d).filter("url is not null").groupBy("url").agg(F.max("score").alias("score"))).limit(200)
    order = Window.orderBy(F.desc_nulls_last("score"), F.asc_nulls_last("url"))
    return first.select("url", "score", F.row_number().over(order).cast("bigint").alias("place"))


def delta_vector(spark, d):
    """Category differences between each domain's highest and lowest scan."""
    ex = A.domain_extremes(_scans(spark, d).filter("domain <> ''"), 1, 100)
    pick = lambda side: ex.filter(F.col("side") == side).select("domain", F.col("categories").alias(side))
    both = pick("highest").join(pick("lowest"), "domain")
    return both.select("domain", S.delta_vector(F.col("highest"), F.col("lowest"), 9).alias("x")).select("domain", *(_even(F.col(f"x.{c}")).alias(c) for c in S.CATEGORIES))


def leaderboard(spark, d):
    return A.leaderboard(_scans(spark, d), 50).select("id", "domain", "score", "label")


def leaderboard_label_filter(spark, d):
    return A.leaderboard(_scans(spark, d), 50, label=S.BETWEEN).select("id", "domain", "score", "label")


def leaderboard_page2(spark, d):
    return A.leaderboard(_scans(spark, d), 50, 50).select("id", "domain", "score", "label")


def domain_stats(spark, d):
    return A.domain_stats(_scans(spark, d)).select("domain", "scans", F.col("avg_score").cast("double").alias("avg_score"), "max_score", "min_score", "latest", "likely_human", "uncertain", "likely_ai")


def domain_leaderboard(spark, d):
    return A.domain_leaderboard(_scans(spark, d), 100).select("domain", "scans", "avg_score", "max_score", "latest", F.col("place").cast("bigint").alias("place"))


def leaderboard_percentile(spark, d):
    return A.leaderboard_percentile(A.domain_leaderboard(_scans(spark, d), None)).select("domain", F.col("percentile").cast("bigint").alias("percentile"))


def quiet_domains(spark, d):
    return A.quiet_domains(_scans(spark, d), 25)


def corpus_percentile(spark, d):
    return A.corpus_percentile(_scans(spark, d), 25)


def score_percentiles(spark, d):
    return A.score_percentiles(_scans(spark, d))


def global_stats(spark, d):
    return A.global_stats(_scans(spark, d))


def pattern_stats(spark, d):
    return A.pattern_stats(_scores(spark, d))


def pattern_stats_catalog(spark, d):
    return A.pattern_stats(_scores(spark, d), table(spark, d, "dim_patterns")).select("pattern_id", "category", "avg_score", "occurrences", "name", "detection_type", "version", "severity")


def scan_status(spark, d):
    """The newest label of every domain as its status."""
    outcomes = _scans(spark, d).groupBy("domain", "label").agg(F.max("word_count").alias("at")).select("domain", F.col("label").alias("status"), "at")
    return A.scan_status(outcomes)


def outcome_counts(spark, d):
    """Scans by label as outcomes, their words as what was saved."""
    return A.outcome_counts(_scans(spark, d).select("domain", F.col("label").alias("status"), F.col("word_count").alias("saved")))


def category_report(spark, d):
    return A.category_report(_scores(spark, d))


def pattern_version_summary(spark, d):
    return A.pattern_versions(_scores(spark, d)).select("pattern_id", F.col("max_version").cast("bigint").alias("max_version"), "scan_count")


def pattern_version_status(spark, d):
    return A.pattern_status(_scores(spark, d), table(spark, d, "dim_patterns")).select("pattern_id", "scan_count", "status")


def stale_urls(spark, d):
    return A.stale_urls(_scans(spark, d), _scores(spark, d), table(spark, d, "dim_patterns"))


def new_urls_anti_join(spark, d):
    """URLs of documents that no scan has."""
    return A.new_urls(table(spark, d, "documents").select("url").filter("url is not null").distinct(), _scans(spark, d))


def work_list(spark, d):
    found = table(spark, d, "documents").select("url")
    return A.work_list(found, _scans(spark, d), A.stale_urls(_scans(spark, d), _scores(spark, d), table(spark, d, "dim_patterns")), skip=["/tag/", "/author/"])


def domain_trend(spark, d):
    return A.domain_trend(_scans(spark, d).filter("domain <> ''")).select("id", "domain", "published_date", "score")


def trend_last_120(spark, d):
    return A.domain_trend(_scans(spark, d).filter("domain <> ''"), last=120).select("id", "domain", "published_date")


def monthly_trend(spark, d):
    return A.monthly_trend(_scans(spark, d).groupBy("id", "domain", "score").agg(F.min("landed_at").alias("landed_at")), "landed_at")


def domain_scans_recent(spark, d):
    return A.domain_scans(_scans(spark, d), 20, "recent").select("id", "domain", F.col("place").cast("bigint").alias("place"))


def domain_scans_highest(spark, d):
    return A.domain_scans(_scans(spark, d), 20, "highest").select("id", "domain", F.col("place").cast("bigint").alias("place"))


def domain_scans_lowest(spark, d):
    return A.domain_scans(_scans(spark, d), 20, "lowest").select("id", "domain", F.col("place").cast("bigint").alias("place"))


def domain_extremes(spark, d):
    return A.domain_extremes(_scans(spark, d), 5).select("id", "domain", "side", F.col("place").cast("bigint").alias("place"))


def category_avgs_recent20(spark, d):
    return A.category_averages(_scans(spark, d), 20)


def upsert_latest(spark, d):
    """Deliveries of scans up to a day as the table that exists, later ones merged into it: one row per url, all columns."""
    s = table(spark, d, "scans").select("url", "domain", "file_path", "score", "title", "published_date", F.col("landed_at").alias("scanned_at"), F.col("id").alias("scan")).filter("url is not null")
    early = F.col("scanned_at") < F.lit("2025-07-01").cast("timestamp")
    existing = store.upsert_scans(s.limit(0), s.filter(early))
    merged = store.upsert_scans(existing, s.filter(~early | F.col("scanned_at").isNull()))
    return merged.select("url", "domain", "file_path", "score", "title", "published_date", "scan", F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


def replace_children(spark, d):
    """The rows of rescanned scans replaced by one row each."""
    old = _scores(spark, d).select("scan_id", "pattern_id", "pattern_version")
    fresh = old.filter("pattern_version < 2").groupBy("scan_id").agg(F.lit("rescan").alias("pattern_id"), F.max("pattern_version").alias("pattern_version"))
    return store.replace_children(old, fresh, "scan_id").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.max("pattern_id").alias("last"), F.sum("pattern_version").alias("versions"))


def delete_domain(spark, d):
    """What is left, by domain and by pattern, when the scans of files and pasted texts are deleted."""
    kept, children = store.delete_domain(_scans(spark, d), _scores(spark, d), "")
    parts = [df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "key", "n") for p, df, c in (("scans", kept, "domain"), ("scores", children, "pattern_id"))]
    return parts[0].unionByName(parts[1])


def excluded_domains(spark, d):
    return documents.domain_list(table(spark, d, "dim_excluded"), "domain", hosts=True)


def delete_excluded(spark, d):
    """By domain, what was deleted and what is left."""
    kept, gone = store.delete_excluded(_scans(spark, d), excluded_domains(spark, d))
    return gone.select("domain", "deleted", F.lit(0).cast("bigint").alias("kept")).unionByName(kept.groupBy("domain").agg(F.lit(0).cast("bigint").alias("deleted"), F.count(F.lit(1)).alias("kept")))


def url_authority(spark, d):
    return table(spark, d, "documents").filter("url is not null").select("doc_id", T.authority(F.col("url")).alias("authority"))


def host_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.host(F.col("url")).alias("host"))


def trending_domains(spark, d):
    stories = table(spark, d, "documents").select(F.col("doc_id").alias("position"), "url")
    return A.trending_domains(stories, excluded_domains(spark, d), top=25, least=2, limit=500)


def skip_pattern_filter(spark, d):
    return A.without_patterns(_pages(spark, d).filter("url is not null").select("scan_id", "url"), ["/2024/", "status"]).select("scan_id")


def article_urls(spark, d):
    urls = _scans(spark, d).filter("url is not null").select(T.base_url(F.col("url")).alias("base"), "url").distinct()
    return A.site_article_urls(urls, [".html", ".htm", "/"]).select("url")


def min_words_filter(spark, d):
    return word_count(spark, d).filter("n_words >= 50").select("doc_id")


def sitemap_locs(spark, d):
    """The documents' URLs as one sitemap per source, parsed again."""
    locs = F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), F.col("url"), F.lit(" </loc></url>"))), ""), F.lit("</urlset>"))
    maps = table(spark, d, "documents").filter("url is not null").withColumn("part", F.pmod("doc_id", F.lit(64))).groupBy("source", "part").agg(locs.alias("body"))
    return discovery.sitemap_urls(maps.withColumn("base", F.concat(F.lit("https://"), F.col("source")))).select("url")


def score_json_roundtrip(spark, d):
    s = _scans(spark, d).select("id", F.from_json(F.to_json("categories"), "map<string,double>").alias("m"))
    return s.select("id", *(F.round(F.col("m")[c], 6).alias(c) for c in S.CATEGORIES))


def html_to_text(spark, d):
    return _pages(spark, d).filter("raw_html is not null").select("scan_id", documents.html_to_text(F.col("raw_html")).alias("text")).select("scan_id", F.length("text").alias("n_chars"), T.word_count(F.col("text")).alias("n_words"))


def library(spark, d):
    return patterns_table(spark, load_patterns()).select("id", "category", "weight", "detection_type", "version", "hash")


def library_profiles(spark, d):
    return profiles_table(spark, load_profiles())


def badges(spark, d):
    return out.badge(A.domain_stats(_scans(spark, d).filter("domain <> ''")))


QUERIES = {f.__name__: f for f in (
    word_count, freq_contains, freq_exact, regex_count, html_regex_count, html_text_fallback, bullet_density, header_ratio, paragraph_uniformity, emoji_density, sentence_split, sentence_burstiness,
    avg_sentence_length, question_rate, type_token_ratio, word_freq_variance, stylistic_index, scored_documents, scored_pages, pattern_scores_long, normalize_clamp, category_weighted_mean, label_assignment,
    model_similarity, rank_results, delta_vector, leaderboard, leaderboard_label_filter, leaderboard_page2, domain_stats, domain_leaderboard, leaderboard_percentile, quiet_domains, corpus_percentile,
    score_percentiles, global_stats, pattern_stats, pattern_stats_catalog, scan_status, outcome_counts, library_scores_long, category_report, pattern_version_summary, pattern_version_status, stale_urls, new_urls_anti_join, work_list, domain_trend, trend_last_120, monthly_trend,
    domain_scans_recent, domain_scans_highest, domain_scans_lowest, domain_extremes, category_avgs_recent20, upsert_latest, replace_children, delete_domain, excluded_domains, delete_excluded, url_authority,
    host_normalize, trending_domains, skip_pattern_filter, article_urls, min_words_filter, sitemap_locs, score_json_roundtrip, html_to_text, library, library_profiles, badges,
)}
