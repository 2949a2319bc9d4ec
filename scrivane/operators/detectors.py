"""Detectors as column expressions: a pattern and a document's columns give a raw value, a score and a label.

All detectors of a library run in one projection without a shuffle. The columns that they share (lower case, words, sentences) are computed
once, behind a generator that keeps the optimizer from copying them into every detector.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import text as T
from scrivane.functions.measures import MEASURES, measurer
from scrivane.functions.runs import run_counter
from scrivane.operators.scoring import category_scores, clamp, index_of, label_of
from scrivane.patterns.library import OWN_KINDS, Pattern, usable
from scrivane.session import spread


class DocumentColumns:
    """The columns that detectors read: text, low, n_words, raw_html (may be NULL), and what is measured once."""

    def __init__(self, prefix: str = "d"):
        self._p = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(f"{self._p}.{name}")


def prepare(df: DataFrame, text: str = "text", raw_html: str | None = None, prefix: str = "d") -> DataFrame:
    """df with a struct of the columns that detectors share. A NULL text counts as empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    html = F.col(f"`{raw_html}`") if raw_html else F.lit(None).cast("string")
    sent = F.split(T.strip(t), T.SENTENCE_END.replace(r"\s", T.WS))
    shared = F.struct(
        t.alias("text"), F.lower(t).alias("low"), T.word_count(t).alias("n_words"), html.alias("raw_html"),
        F.transform(T.words(F.lower(t)), lambda w: F.btrim(w, F.lit(T.TOKEN_EDGE))).alias("tokens"), T.lengths(T.paragraphs(t)).alias("paragraphs"),
        F.filter(F.transform(sent, lambda s: F.struct(T.word_count(s).cast("double").alias("n"), F.endswith(s, F.lit("?")).alias("asks"))), lambda s: s["n"] >= 2).alias("sentences"),
    )
    return df.select("*", F.inline(F.array(F.struct(shared.alias(prefix)))))


def measure_all(df: DataFrame, measure, text: str = "text", raw_html: str | None = None, prefix: str = "d") -> DataFrame:
    """df with a struct of the columns that detectors share, those of words measured in one pass."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    html = F.col(f"`{raw_html}`") if raw_html else F.lit(None).cast("string")
    out = df.withColumn("__m", measure(t, F.lower(t)))
    shared = F.struct(t.alias("text"), html.alias("raw_html"), *(F.col(f"__m.{c.split()[0]}") for c in MEASURES.split(", ")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.inline(F.array(F.struct(shared.alias(prefix)))))


def _rate(count: Column, d, params: dict) -> Column:
    return count / F.greatest(d.n_words, F.lit(1)).cast("double") * int(params.get("per_n_words", 1000))


def frequency(p: Pattern, d) -> Column:
    return _rate(T.count_terms(d.low, p.params["terms"], p.params.get("match_mode", "contains") == "exact"), d, p.params)


def regex(p: Pattern, d) -> Column:
    return _rate(T.count_matches(d.text, p.params["patterns"]), d, p.params)


def html_regex(p: Pattern, d) -> Column:
    """On the markup if there is any, else on the text by other expressions; either way per words of the text."""
    found = F.when(d.raw_html.isNotNull(), T.count_matches(d.raw_html, p.params.get("patterns") or [], "iuUs")).otherwise(T.count_matches(d.text, p.params.get("text_patterns") or [], "iuUdm"))
    return _rate(found, d, p.params)


def bullet_density(d) -> Column:
    lines = F.size(F.filter(F.split(d.text, T.LINE_END), lambda x: T.strip(x) != ""))
    found = F.regexp_count(d.text, F.lit("(?mdU)" + T.BULLET)).cast("double")
    return F.when(lines > 0, found / F.greatest(lines, F.lit(1))).otherwise(0.0)


def header_ratio(d) -> Column:
    return F.regexp_count(d.text, F.lit("(?mdU)" + T.HEADING)).cast("double") / F.greatest(d.n_words, F.lit(1))


def paragraph_uniformity(d) -> Column:
    return F.when(F.size(d.paragraphs) >= 3, 1.0 - F.least(T.variation(d.paragraphs), F.lit(1.0))).otherwise(0.0)


def emoji_density(d) -> Column:
    return F.regexp_count(d.text, F.lit(T.PICTOGRAPHS)).cast("double") / F.greatest(F.length(d.text), F.lit(1))


def sentence_burstiness(d) -> Column:
    own = F.transform(d.sentences, lambda s: s["n"])
    return F.when(F.size(own) >= 4, F.greatest(F.lit(0.0), 1.0 - T.variation(own))).otherwise(0.0)


def type_token_ratio(d) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - T.window_type_ratio(d.tokens)), F.lit(0.0))


def question_share(d) -> Column:
    return F.size(F.filter(d.sentences, lambda s: s["asks"])).cast("double") / F.greatest(F.size(d.sentences), F.lit(1))


def question_rate(d, params: dict) -> Column:
    return _few_questions(question_share(d), F.size(d.sentences), params)


def _few_questions(share: Column, sentences: Column, params: dict) -> Column:
    most = max(float(params.get("threshold_high", 0.08)), 0.001)
    inverse = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - share / most), F.lit(float(params.get("score_cap", 0.70))))
    return F.when(sentences > 0, inverse).otherwise(0.0)


def avg_sentence_length(d) -> Column:
    return T.mean(F.transform(d.sentences, lambda s: s["n"]))


_BY_METRIC = {
    "bullet_density": bullet_density, "header_ratio": header_ratio, "paragraph_cv_inverted": paragraph_uniformity, "emoji_density": emoji_density, "sentence_burstiness": sentence_burstiness,
    "type_token_ratio": type_token_ratio, "avg_sentence_length": avg_sentence_length,
}


#: The same from the columns of one measuring pass.
_MEASURED = {
    "paragraph_cv_inverted": lambda d, _: d.uniformity, "sentence_burstiness": lambda d, _: d.burstiness, "type_token_ratio": lambda d, _: d.type_ratio, "avg_sentence_length": lambda d, _: d.sentence_length,
    "question_rate": lambda d, params: _few_questions(d.question_share, d.n_sentences, params),
}


def metric(p: Pattern, d) -> Column:
    if p.params["metric"] == "question_rate":
        return question_rate(d, p.params)
    # Without a frequency table word_freq_variance is 0, with its weight kept; see word_frequency_scores.
    return _BY_METRIC[p.params["metric"]](d) if p.params["metric"] in _BY_METRIC else F.lit(0.0)


BUILDERS = {"frequency": frequency, "regex": regex, "html_regex": html_regex, "structural": metric, "linguistic": metric}


def register_kind(kind: str, builder) -> None:
    """Adds a kind of detection: builder(pattern, document columns) gives the raw value as a column. Definitions of this kind may then be loaded."""
    if kind in BUILDERS and kind not in OWN_KINDS:
        raise ValueError(f"{kind} is a kind already")
    BUILDERS[kind] = builder
    OWN_KINDS.add(kind)


def label_text(p: Pattern, raw: Column) -> Column:
    kinds = {
        "bullet_density": F.format_string("%.1f%% bullet lines", raw * 100), "header_ratio": F.format_string("%.1f headers per 1000 words", raw * 1000), "paragraph_cv_inverted": F.format_string("uniformity=%.2f", raw),
        "emoji_density": F.format_string("%.2f emojis per 1000 chars", raw * 1000), "sentence_burstiness": F.format_string("burstiness=%.2f", 1.0 - raw), "type_token_ratio": F.format_string("STTR=%.3f", 1.0 - raw),
        "question_rate": F.format_string("absence of questions %.2f", raw), "avg_sentence_length": F.format_string("%.1f words/sentence avg", raw), "word_freq_variance": F.lit("no word frequencies"),
    }
    return kinds.get(p.params.get("metric"), F.format_string(f"%.1f per {int(p.params.get('per_n_words', 1000))} words", raw))


def raw_value(p: Pattern, d) -> Column:
    return BUILDERS[p.detection_type](p, d).cast("double")


def result(p: Pattern, raw: Column) -> Column:
    """The result struct of one pattern."""
    norm = F.lit(0.0) if p.params.get("metric") == "word_freq_variance" else clamp(raw, float(p.params.get("threshold_low", 0.0)), float(p.params.get("threshold_high", 1.0)))
    return F.struct(F.lit(p.id).alias("pattern_id"), F.lit(p.category).alias("category"), raw.alias("raw_value"), norm.cast("double").alias("norm_score"), F.lit(p.weight).alias("weight"), label_text(p, raw).alias("label"), F.lit(p.version).alias("pattern_version"), F.lit(p.hash).alias("pattern_hash"))


def compiles(spark: SparkSession, p: Pattern) -> bool:
    """Whether the engine can run a pattern's expressions: one that it can't must not end the job."""
    expressions = [T.java_regex(x, "iu") for c in ("patterns", "text_patterns") for x in (p.params.get(c) or []) if p.detection_type in ("regex", "html_regex")]
    try:
        compiler = spark._jvm.java.util.regex.Pattern
    except AttributeError:  # a client without a JVM of its own
        return True
    try:
        for x in expressions:
            compiler.compile(x)
    except (Py4JError, PySparkException):
        return False
    return True


def score_documents(df: DataFrame, patterns: list[Pattern], weights: dict[str, float], text: str = "text", raw_html: str | None = None, frequencies: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """df with n_words, results (an array, one struct per pattern), categories (a struct), index and verdict.

    Patterns that can't be built are left out of results and weights. With ``frequencies`` (word, zipf), ``key`` must name a unique column: the scores
    of word_freq_variance then come from it. NULL and empty texts have score 0 throughout, but for an index from absent questions.
    """
    use = [p for p in patterns if usable(p) and compiles(df.sparkSession, p)]
    measured = T.term_automaton(("a",)) is not None  # else all of it by column expressions
    phrases = [p for p in use if p.detection_type == "frequency"] if measured else []
    at = {p.id: i for i, p in enumerate(phrases)}
    runs = {x: i for i, x in enumerate(dict.fromkeys(x for p in use if p.detection_type == "regex" for x in p.params["patterns"] if run_counter(x)))} if measured else {}
    d = DocumentColumns()

    def raw_of(p: Pattern) -> Column:
        if p.id in at:
            return _rate(F.col("d.phrases")[at[p.id]], d, p.params)
        if p.detection_type == "regex" and any(x in runs for x in p.params["patterns"]):
            found = T.count_matches(d.text, [x for x in p.params["patterns"] if x not in runs])
            return _rate(reduce(lambda n, x: n + F.col("d.runs")[runs[x]], (x for x in p.params["patterns"] if x in runs), found), d, p.params)
        if measured and p.params.get("metric") in _MEASURED:
            return _MEASURED[p.params["metric"]](d, p.params)
        return raw_value(p, d)

    raws = F.struct(*(raw_of(p).cast("double").alias(f"r{i}") for i, p in enumerate(use)), F.lit(0).alias("none"))
    results = F.array(*(result(p, F.col(f"raws.r{i}")) for i, p in enumerate(use))) if use else F.array().cast("array<struct<pattern_id:string,category:string,raw_value:double,norm_score:double,weight:double,label:string,pattern_version:int,pattern_hash:string>>")
    if measured:
        measure = measurer([(p.params["terms"], p.params.get("match_mode", "contains") == "exact") for p in phrases], list(runs))
        out = measure_all(spread(df), measure, text, raw_html)
    else:
        out = prepare(spread(df), text, raw_html)
    out = out.select("*", F.inline(F.array(F.struct(raws.alias("raws")))))
    out = out.select("*", F.inline(F.array(F.struct(results.alias("results"))))).drop("raws")
    zipf = [p for p in use if p.params.get("metric") == "word_freq_variance"]
    if frequencies is not None and zipf and key:
        own = word_frequency_scores(df, key, text, frequencies, zipf[0].params)
        out = out.join(own, key, "left").withColumn("results", F.transform("results", lambda r: F.when(r["pattern_id"] == zipf[0].id, r.withField("raw_value", F.coalesce("zipf_raw", F.lit(0.0))).withField("norm_score", F.coalesce("zipf_norm", F.lit(0.0))).withField("label", F.format_string("Zipf std=%.3f", F.coalesce("zipf_raw", F.lit(0.0))))).otherwise(r))).drop("zipf_raw", "zipf_norm")
    place = {p.id: i for i, p in enumerate(use)}
    cats = category_scores(use, lambda p: F.col("results")[place[p.id]]["norm_score"])
    out = out.withColumn("categories", cats).withColumn("index", index_of(F.col("categories"), weights))
    return out.withColumns({"n_words": F.col("d.n_words"), "verdict": label_of(F.col("index"))}).drop("d")


def word_frequency_scores(df: DataFrame, key: str, text: str, frequencies: DataFrame, params: dict) -> DataFrame:
    """(key, zipf_raw, zipf_norm): spread of the words' frequencies; none for documents of fewer than 30 words of four letters or 20 known ones."""
    low, high = float(params.get("threshold_low", 0.70)), float(params.get("threshold_high", 1.25))
    found = df.select(F.col(f"`{key}`").alias(key), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(r"(?U)\b([a-z]{4,})\b"), 1)).alias("word"))
    counted = found.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n")).join(frequencies, "word", "left")
    z = F.when(F.col("zipf") > 0, F.col("zipf"))
    k, s, q = (F.sum(F.when(z.isNotNull(), F.col("n") * x)) for x in (F.lit(1), z, z * z))
    per = counted.groupBy(key).agg(F.sum("n").alias("all"), k.alias("k"), s.alias("s"), q.alias("q")).filter("all >= 30 and k >= 20")
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1)))
    return per.select(key, F.bround(std, 4).alias("zipf_raw"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - std) / (high - low))).alias("zipf_norm"))


def zipf_table(df: DataFrame, text: str) -> DataFrame:
    """(word, zipf) of a corpus: log10 of the occurrences among a billion words."""
    found = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(r"(?U)\b([a-z]+)\b"), 1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    whole = found.agg(F.sum("n")).first()[0] or 1
    return found.select("word", F.log10(F.col("n") * (1e9 / whole)).alias("zipf"))


def long_results(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document and pattern."""
    return scored.select(*keys, F.inline("results"))
