"""Detectors, scoring and the pattern library on hand fixtures with golden values."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrivane.functions import text as T
from scrivane.functions.measures import measurer
from scrivane.functions.runs import run_counter
from scrivane.operators import detectors as D
from scrivane.operators import scoring as S
from scrivane.patterns import library as L

B = "# Guide\n\n## Key Takeaways\n\n- **Fast**: it runs.\n- **Safe**: it holds.\n1. **Next**: go on.\n\nWe all know this works; it does. Honestly? It is robust — truly.\n\n## Why This Matters\nMoreover, thus we go."
C = '<html><body><h2><a name="x"></a>The Takeaway</h2><p>Body text here.</p><ul><li><svg/><strong>One</strong> a</li><li><b>Two</b> b</li><li>plain</li></ul></body></html>'
CT = "The Takeaway\nBody text here.\nOne a\nTwo b\nplain"
DOCS = [
    ("B", B, None), ("C", CT, C), ("C2", CT, None), ("D", "thus thus thus we go. Hence, hence it was; thus\nthus it is thus thus thus end", None),
    ("E", "Is this so now? We went home today. Who knows it? They came back late. He slept well. It was good.", None), ("F", "漢字 ok 😀😀 ■ 한글 • ◦ done", None),
    ("G", "Go on now. He ran fast. Openly. We saw it. In a book. The end came. Done.", None), ("H", "", None), ("N", None, None),
    ("I", "intro line\n\n- one\n-\n- two\n\n\n* three\n-5 degrees\n--- rule\n12) twelve\n13.x no\nplain", None), ("J", "Go on now. " * 40_000, None),
]
#: words, index, label, and (pattern, raw, norm) of some patterns.
GOLD = {
    "B": (38, 52, "LIKELY AI", [("bullet_point_density", 0.375, 0.7857), ("header_frequency", 0.0789, 1), ("paragraph_uniformity", 0.3382, 0.2303), ("second_person_address", 52.6316, 1)]),
    "C": (10, 14, "LIKELY HUMAN", [("ai_section_headers", 100, 1), ("bold_first_bullets", 200, 1)]), "C2": (10, 7, "LIKELY HUMAN", [("ai_section_headers", 100, 1), ("bold_first_bullets", 0, 0)]),
    "D": (17, 6, "LIKELY HUMAN", [("formal_register", 294.1176, 1)]), "E": (21, 9, "LIKELY HUMAN", [("question_avoidance", 0, 0), ("sentence_burstiness", 0.8435, 1)]),
    "F": (8, 6, "LIKELY HUMAN", [("emoji_density", 0.2273, 1)]), "G": (17, 9, "LIKELY HUMAN", [("short_punchy_fragments", 176.4706, 1)]), "H": (0, 0, "LIKELY HUMAN", []), "N": (0, 0, "LIKELY HUMAN", []),
    "I": (18, 4, "LIKELY HUMAN", [("bullet_point_density", 0.6, 1), ("paragraph_uniformity", 0.2362, 0.0604)]),
}


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(DOCS, "id string, text string, raw_html string").withColumn("d", F.lit("clash")).withColumn("label", F.lit("clash"))
    out = D.score_documents(df.drop("d"), L.load_patterns(), L.load_weights(), raw_html="raw_html")
    return {r.id: r for r in out.collect()}


def test_golden_values(scored):
    for key, (words, index, label, some) in GOLD.items():
        r = scored[key]
        assert (r.n_words, r["index"], r.verdict) == (words, index, label), key
        by = {x.pattern_id: x for x in r.results}
        for pattern, raw, norm in some:
            assert by[pattern].raw_value == pytest.approx(raw, abs=1e-4) and by[pattern].norm_score == pytest.approx(norm, abs=1e-4), (key, pattern)


def test_long_document_of_short_sentences(scored):
    r = {x.pattern_id: x for x in scored["J"].results}
    assert scored["J"].n_words == 120_000 and r["short_punchy_fragments"].raw_value == pytest.approx(1000 / 120_000)


def test_scores_are_in_range(scored):
    for r in scored.values():
        assert 0 <= r["index"] <= 100 and all(0 <= x.norm_score <= 1 for x in r.results) and len(r.results) == 31


def test_half_even_and_label_edges(spark):
    df = spark.createDataFrame([(0.145,), (0.155,), (0.15,), (0.16,), (0.29,), (0.30,)], "x double").select(F.struct(*(F.col("x").alias(c) for c in L.CATEGORIES)).alias("c"))
    rows = df.select(S.index_of(F.col("c"), {"tropes": 1.0}).alias("i")).withColumn("l", S.label_of(F.col("i"))).collect()
    assert [r.i for r in rows][2:] == [15, 16, 29, 30] and [r.l for r in rows][2:] == ["LIKELY HUMAN", "UNCERTAIN", "UNCERTAIN", "LIKELY AI"]
    assert [r.i for r in spark.createDataFrame([(14.5,), (15.5,)], "x double").select(F.bround("x").cast("int").alias("i")).collect()] == [14, 16]


def test_clamp_edges(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (2.0,), (0.0,), (9.0,)], "x double").select(S.clamp(F.col("x"), 1, 3), S.clamp(F.col("x"), 2, 2)).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (1, 1), (0.5, 0), (0, 0), (1, 1)]


def test_expressions_match_pythons(spark):
    """Every expression of the library counts what Python's re finds."""
    texts = [x[1] or "" for x in DOCS[:-1]] + ["Not fast, not slow, and never late. It's not just a tool — it's a way; of life; of work; Honestly? Really.\nBrilliant.\nSo it goes ... on … [oai_citation:0] turn0search1 utm_source=chatgpt.com INSERT_URL 2025-XX-XX", "x" * 5000, C]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    todo = [(p, "iuUd", re.I) for q in L.load_patterns() if q.detection_type == "regex" for p in q.params["patterns"]]
    for q in L.load_patterns():
        if q.detection_type == "html_regex":
            todo += [(p, "iuUs", re.I | re.S) for p in q.params["patterns"]] + [(p, "iuUdm", re.I | re.M) for p in q.params["text_patterns"]]
    rows = df.select("i", *(T.count_matches(F.col("t"), [p], f).alias(f"c{k}") for k, (p, f, _) in enumerate(todo))).collect()
    for r in rows:
        for k, (p, _, f) in enumerate(todo):
            assert r[f"c{k}"] == len(re.findall(re.escape(p) if len(p) <= 3 else p, texts[r.i], f)), (p, texts[r.i][:60])


def test_automaton_counts_as_expressions(spark):
    groups = [(["ab", "aba", "a b", "the", "the"], False), (["thus", "so on"], True)]
    texts = ["ababa aba the a b", "thus thus thus so on end", " thus so on so on x", "", None, "the" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(T.term_counter(groups)(F.col("t")).alias("a"), F.array(*(T.count_terms(F.coalesce("t", F.lit("")), g, e) for g, e in groups)).alias("b")).collect()):
        assert r.a == r.b, t


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n\t  é", max_size=80), min_size=1, max_size=10))
def test_word_count_is_pythons(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.word_count(F.col("t"))).collect()]
    assert got == [len(t.split()) for t in texts]


def test_urls(spark):
    urls = ["http://U@WWW.Ex.com:80/a?b", "https://www.Example.com", "not a url", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(T.authority(F.col("u")), T.host(F.col("u"))).collect()
    assert [tuple(r) for r in rows] == [("U@WWW.Ex.com:80", "u@www.ex.com:80"), ("www.Example.com", "example.com"), ("", None), (None, None)]
    rows = spark.createDataFrame([("stackoverflow.com",), ("https://a.x/",)], "d string").select(T.clean_domain(F.col("d")), T.base_url(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [("stackoverflow.com", "https://stackoverflow.com"), ("a.x", "https://a.x")]


def test_model_similarity_and_word_frequencies(spark):
    long = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 1.0), ("v", "z", 1.0)], "url string, pattern_id string, norm_score double")
    prof = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5)], "model_id string, pattern_id string, expected double")
    assert {(r.url, r.model_id): r.similarity for r in S.model_similarity(long, prof, ["url"]).collect()} == {("u", "m"): 0.75, ("v", "m"): 0.0}
    words = [a + b * 3 for a in "abcdefgh" for b in "ijklm"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "few words here"), (3, None)], "id int, text string")
    zipf = spark.createDataFrame([(w, float(i % 3 + 1)) for i, w in enumerate(words)], "word string, zipf double")
    got = D.word_frequency_scores(docs, "id", "text", zipf, {"threshold_low": 0.7, "threshold_high": 1.25}).collect()
    import statistics

    assert [r.id for r in got] == [1] and got[0].zipf_raw == pytest.approx(statistics.stdev(float(i % 3 + 1) for i in range(40)), abs=1e-4)


def test_library_rejects_bad_definitions(tmp_path):
    good = {"id": "x", "name": "x", "category": "phrases", "weight": 0.5, "detection_type": "regex", "params": {"patterns": ["a"]}}
    assert L.make_pattern(good).hash == L.make_pattern(good | {"name": "other", "description": "y"}).hash != L.make_pattern(good | {"version": 2}).hash
    for bad in ({"weight": 1.2}, {"category": "foo"}, {"detection_type": "bar"}, {"weight": "much"}):
        with pytest.raises(L.PatternError):
            L.make_pattern(good | bad, "f.yaml")
    with pytest.raises(L.PatternError, match="params"):
        L.make_pattern({k: v for k, v in good.items() if k != "params"}, "f.yaml")
    (tmp_path / "a.yaml").write_text(json.dumps(good))
    (tmp_path / "b.yaml").write_text(json.dumps(good | {"weight": 0.7}))
    (tmp_path / "_x.yaml").write_text("[1]")
    assert [p.weight for p in L.load_patterns(tmp_path)] == [0.7] and sum(L.load_weights(tmp_path).values()) == pytest.approx(1.05)
    (tmp_path / "_weights.yaml").write_text("weights: {tropes: 0.9}")
    with pytest.raises(L.PatternError):
        L.load_weights(tmp_path)
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(L.PatternError):
        L.load_patterns(tmp_path)
    with pytest.raises(L.PatternError, match="claude"):
        L.profile("unknown")


def test_unknown_metric_is_left_out(spark):
    p = L.Pattern("x", "x", "structure", 0.5, "structural", {"metric": "unknown"})
    r = D.score_documents(spark.createDataFrame([("a",)], "text string"), [p], L.load_weights()).first()
    assert r.results == [] and r["index"] == 0


def test_bad_expressions_are_left_out(spark):
    """Ones that no engine reads, and ones that only the JVM can't."""
    bad = [L.Pattern(f"b{i}", "b", "tropes", 0.5, "regex", {"patterns": ["fine", x]}) for i, x in enumerate(("(open and", "(?P<n>a)(?P=n)+ very"))]
    good = L.Pattern("g", "g", "tropes", 0.5, "regex", {"patterns": ["a+ word"], "threshold_low": 0, "threshold_high": 1})
    r = D.score_documents(spark.createDataFrame([("aa word",)], "text string"), [*bad, good], L.load_weights()).first()
    assert [x.pattern_id for x in r.results] == ["g"]


RUNS = [r"(?:[A-Z][^.!?\n]{1,38}[.!?][ \t]){3,}", r"[A-Z][^.;!?\n]{10,90};\s*[^.;!?\n]{10,90};\s*[^.;!?\n]{10,90}[.!?]", r"\b[^,\n]{10,60},\s+[^,\n]{10,60},\s+and\s+[^,.\n]{10,60}[.,]"]
PARTS = ["He went.", "It is so. ", "No! ", "Why? ", "a", "B ", "honest words, ", "and the other thing, ", "and ", "\n", ". ", "; ", "some longer piece of text here", "ten chars!", "é", "ſ", "ı", "  ", "\t", ", and then we left the house.", "x" * 40, "²", "_", " AND more of the same kind, ", "; \n", "word word; next words here; last words here. ", "", "\n\n", "? \"Who? ", "...", "\x1f", "\u00a0"]


def _mixed(n, seed):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_runs_count_as_the_engine(spark):
    counters = [run_counter(x) for x in RUNS]
    assert all(counters) and not any(map(run_counter, (r"[a-z]{3,}", r"\b\w+, and", RUNS[0].replace("[.!?]", "[.!;]"), RUNS[2].replace(",.", ",;"))))
    texts = _mixed(3000, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    rows = df.select("i", *(T.count_matches(F.col("t"), [x]).alias(f"c{k}") for k, x in enumerate(RUNS))).collect()
    for r in rows:
        assert [c(texts[r.i]) for c in counters] == [r.c0, r.c1, r.c2], texts[r.i]
    assert all(sum(r[f"c{k}"] for r in rows) > 100 for k in range(3))


def test_measures_equal_expressions(spark):
    """One pass in Python gives what the column expressions give, to the last bit."""
    texts = _mixed(400, 4) + ["", "one", "A b. C d. E f. G h.", "w " * 49, "w x " * 50, "p one two\n\np two three four\n \np five six seven eight nine"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r for r in D.measure_all(df, measurer([], []), "t").select("i", "d.*").collect()}
    d = D.DocumentColumns()
    want = D.prepare(df, "t").select("i", d.n_words.alias("n_words"), D.paragraph_uniformity(d).alias("uniformity"), D.sentence_burstiness(d).alias("burstiness"), D.avg_sentence_length(d).alias("sentence_length"), D.question_share(d).alias("question_share"), F.size(d.sentences).alias("n_sentences"), D.type_token_ratio(d).alias("type_ratio"))
    for r in want.collect():
        assert tuple(r)[1:] == tuple(got[r.i][c] for c in want.columns[1:]), texts[r.i]


def test_kinds_of_detection_may_be_added(spark):
    raw = {"id": "loud", "name": "Loud", "category": "punctuation", "weight": 0.5, "detection_type": "marks", "params": {"mark": "!", "threshold_low": 0, "threshold_high": 4}}
    with pytest.raises(L.PatternError):
        L.make_pattern(raw)
    D.register_kind("marks", lambda p, d: T.count_substring(d.text, p.params["mark"]).cast("double"))
    try:
        r = D.score_documents(spark.createDataFrame([("a! b!",)], "text string"), [L.make_pattern(raw)], L.load_weights()).first()
        assert (r.results[0].raw_value, r.results[0].norm_score) == (2.0, 0.5)
        with pytest.raises(ValueError):
            D.register_kind("regex", None)
    finally:
        L.OWN_KINDS.clear()
        D.BUILDERS.pop("marks")
