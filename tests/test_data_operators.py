"""Key totals, timestamps, stores, analytics, sources and streaming on small fixtures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scrivane.operators import analytics as A
from scrivane.operators import store
from scrivane.operators.heavy_keys import heavy_keys, key_totals
from scrivane.operators.timestamps import normalize_times
from scrivane.patterns.library import load_patterns, load_weights
from scrivane.sources import discovery, documents, output
from scrivane.streaming.refresh import SCANS, Refresher, first_seen, recently_scanned, score_windows
from scrivane.streaming.worker import run_worker


def test_key_totals(spark, monkeypatch):
    nan = float("nan")
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("", nan), (None, 2.0), (None, 2.0), ("b" * 5000, -1.0)] + [("hot", float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, v double").withColumn("block", F.lit("clash")).repartition(5)
    got = {r.key: tuple(r)[1:] for r in key_totals(df, "key", ["v"]).collect()}
    assert got == {"a": (3, 2, 4.0, 1.0, 3.0), "": (1, 0, None, None, None), None: (2, 2, 4.0, 2.0, 2.0), "b" * 5000: (1, 1, -1.0, -1.0, -1.0), "hot": (500, 500, 124750.0, 0.0, 499.0)}
    assert {r.key_value for r in heavy_keys(df, "key", 0.5).collect()} == {"hot"}
    large = spark.createDataFrame([("a", 2**60), ("a", 2**60 + 1), ("a", None), ("b", None)], "key string, v long").repartition(3)
    assert {tuple(r) for r in key_totals(large, "key", ["v"]).collect()} == {("a", 3, 2, 2**61 + 1, 2**60, 2**60 + 1), ("b", 1, 0, None, None, None)}
    assert heavy_keys(df.filter("key = 'hot'"), "key").count() == 1
    assert key_totals(df.limit(0), "key", ["v"]).collect() == [] and heavy_keys(df.limit(0), "key").collect() == []
    assert {tuple(r) for r in key_totals(df.select(F.lit(7).alias("k")), "k").collect()} == {(7, 507)}


CASES = [
    ("2023-07-10T08:40:59.348500", "berlin", "2023-07-10 06:40:59.348500", "local"), ("2023-08-17T07:39:05,480545Z", "berlin", "2023-08-17 07:39:05.480545", "zoned"), ("07/12/2025 10:55 AM", "berlin", "2025-07-12 08:55:00.000000", "local"),
    ("12/31/2025 12:05 AM", None, "2025-12-31 00:05:00.000000", "local"), ("20250621", "berlin", "2025-06-21", "date"), ("1686649891928", "berlin", "2023-06-13 09:51:31.928000", "zoned"), ("1770639369", None, "2026-02-09 12:16:09.000000", "zoned"),
    ("1747396899889059", None, "2025-05-16 12:01:39.889059", "zoned"), ("1629617768.144111", None, "2021-08-22 07:36:08.144111", "zoned"), ("Fri, 05 Apr 2024 09:34:48 +0100", "york", "2024-04-05 08:34:48.000000", "zoned"),
    ("3 de mayo de 2022", "berlin", "2022-05-03", "date"), ("25. Juli 2024", "berlin", "2024-07-25", "date"), ("9 décembre 2024", None, "2024-12-09", "date"), ("1 août 2024", None, "2024-08-01", "date"), ("10. März 2024", None, "2024-03-10", "date"),
    ("08-May-2023", None, "2023-05-08", "date"), ("Apr 1, 2022", None, "2022-04-01", "date"), ("June 30, 2024 4:31 AM UTC", "berlin", "2024-06-30 04:31:00.000000", "zoned"), ("2023-10-25 22:36:08 CEST", "berlin", "2023-10-25 20:36:08.000000", "zoned"),
    ("2025-01-24 20:02:23 IST", "kolkata", "2025-01-24 14:32:23.000000", "zoned"), ("20251226T112918Z", None, "2025-12-26 11:29:18.000000", "zoned"), ("20211210T043805+0400", None, "2021-12-10 00:38:05.000000", "zoned"), ("15.12.2025, 06:32", "york", "2025-12-15 11:32:00.000000", "local"),
    ("2024-10-27 02:30:00", "berlin", "2024-10-27 00:30:00.000000", "ambiguous"), ("2024-03-31 02:30:00", "berlin", "2024-03-31 01:30:00.000000", "skipped"), ("2024-11-03 01:30:00", "york", "2024-11-03 05:30:00.000000", "ambiguous"), ("1.1.2023", None, "2023-01-01", "date"),
    ("  2023/10/08 ", "berlin", "2023-10-08", "date"), ("2024-05-04 04:31:01,587033", "nowhere", "2024-05-04 04:31:01.587033", "local"), ("1e9", None, None, None), ("2024-02-30", None, None, None), ("31.02.2024", None, None, None), ("2024-13-45", None, None, None), ("0000-00-00 00:00:00", None, None, None),
    ("2024-01-01 25:00:00", None, None, None), ("13/01/2024", None, None, None), ("not yet", None, None, None), ("", None, None, None), (None, "berlin", None, None), ("2024-01-01T10:00:00 QQT", "berlin", None, None), ("x" * 100_000, None, None, None), ("5 Foo 2024", None, None, None),
]


def test_timestamps(spark):
    nodes = spark.createDataFrame([("berlin", "Europe/Berlin"), ("york", "America/New_York"), ("kolkata", "Asia/Kolkata"), (None, "Asia/Tokyo")], "node string, tz_name string")
    df = spark.createDataFrame([(i, t, n, t) for i, (t, n, _, _) in enumerate(CASES)], "id int, t string, node string, raw_text string").withColumnRenamed("id", "date")
    got = {r.date: r for r in normalize_times(df, ["t"], ["date"], "node", nodes).collect()}
    for i, (text, _, value, kind) in enumerate(CASES):
        assert (got[i].value_utc, got[i].kind) == (value, kind), text
    assert normalize_times(df.limit(0), ["t"], ["date"], "node", nodes).collect() == []
    assert normalize_times(df, ["t", "raw_text"], ["date"], "node", nodes.limit(0)).count() == 2 * len(CASES)


def test_times_do_not_depend_on_the_session_zone(spark):
    nodes = spark.createDataFrame([("b", "Europe/Berlin")], "node string, tz_name string")
    df = spark.createDataFrame([(1, "2024-07-01 12:00:00", "b")], "id int, t string, node string")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        assert normalize_times(df, ["t"], ["id"], "node", nodes).first().value_utc == "2024-07-01 10:00:00.000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _at(n):
    return datetime(2024, 1, n)


def test_upsert(spark):
    schema = "url string, scanned_at timestamp, score int, published_date date, title string, file_path string, domain string"
    old = spark.createDataFrame([("u1", _at(1), 10, date(2024, 1, 1), "A", None, "d1"), (None, _at(1), 1, None, None, "f", "")], schema)
    new = spark.createDataFrame([("u1", _at(2), 20, None, None, "p", "d2"), (None, _at(2), 2, None, None, "f", "")], schema)
    got = store.upsert_scans(old, new)
    rows = {(r.url, r.score): r for r in got.collect()}
    assert set(rows) == {("u1", 20), (None, 1), (None, 2)}
    r = rows["u1", 20]
    assert (r.published_date, r.title, r.domain, r.file_path) == (date(2024, 1, 1), "A", "d1", None)
    again = store.upsert_scans(got.filter("url is not null"), new.filter("url is not null"))
    assert again.collect() == got.filter("url is not null").collect()
    assert store.upsert_scans(old.limit(0), new.limit(0)).collect() == []


def test_store_deletions(spark):
    scans = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, domain string")
    kids = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "scan_id int, p string")
    kept, left = store.delete_domain(scans, kids, "a")
    assert {r.id for r in kept.collect()} == {2, 3} and {r.scan_id for r in left.collect()} == {2, 3}
    kept, gone = store.delete_excluded(scans, spark.createDataFrame([("b",), ("q",)], "domain string"))
    assert {r.id for r in kept.collect()} == {1, 3} and [tuple(r) for r in gone.collect()] == [("b", 1)]
    out = store.replace_children(kids, spark.createDataFrame([(1, "n"), (1, "m")], "scan_id int, p string"), "scan_id")
    assert sorted(map(tuple, out.collect())) == [(1, "m"), (1, "n"), (2, "y"), (3, "z")]


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), buckets=4)
    assert t.read("a int").count() == 0
    for k in range(4):
        t.write(spark.range(k + 1).withColumn("a", F.col("id") * 2), "id" if k == 3 else None)
    assert t.read().count() == 4 and len(t.versions()) == 2 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 2


def test_versioned_table_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    schema = "id bigint, v string"
    rows = lambda t: sorted(tuple(r) for r in t.read(schema).collect())
    combine = lambda was, new: store.replace_children(was, new, "id")
    t = store.VersionedTable(spark, str(tmp_path / "t"), buckets=8)

    def die(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:  # before the first version
        m.setattr(t, "_commit", die)
        with pytest.raises(OSError):
            t.merge(spark.createDataFrame([(0, "lost")], schema), "id", combine, schema, 0)
    assert rows(t) == []
    assert t.merge(spark.createDataFrame([(i, "a") for i in range(50)], schema), "id", combine, schema, 1)
    before = t.current()["folders"]
    with monkeypatch.context() as m:  # folders written, version not committed
        m.setattr(t, "_commit", die)
        with pytest.raises(OSError):
            t.merge(spark.createDataFrame([(1, "lost")], schema), "id", combine, schema, 2)
    assert rows(t) == [(i, "a") for i in range(50)] and t.current()["folders"] == before
    assert t.merge(spark.createDataFrame([(1, "b"), (99, "b")], schema), "id", combine, schema, 2)
    assert not t.merge(spark.createDataFrame([(1, "again")], schema), "id", combine, schema, 2)
    assert rows(t) == [(0, "a"), (1, "b"), *((i, "a") for i in range(2, 50)), (99, "b")]
    after = t.current()["folders"]
    assert sum(after[b] != before.get(b) for b in after) <= 2  # other buckets are taken over as they are
    t.merge(spark.createDataFrame([], schema), "id", combine, schema, 3)
    assert t.current()["folders"] == after and t.current()["batch"] == 3


def test_stale_and_work_list(spark):
    scans = spark.createDataFrame([(1, "u1", "d"), (2, "u2", "d"), (3, "u3", "d"), (4, "u4", "d"), (5, None, "d")], "id int, url string, domain string")
    scores = spark.createDataFrame([(1, "p1", 1, "x"), (2, "p2", 1, None), (3, "p3", 1, "any"), (4, "p1", 2, "h2"), (5, "p1", 1, "x")], "scan_id int, pattern_id string, pattern_version int, pattern_hash string")
    now = spark.createDataFrame([("p1", 2, "h2"), ("p2", 1, "h"), ("p3", 1, ""), ("p4", 1, "n")], "id string, version int, hash string")
    stale = A.stale_urls(scans, scores, now)
    assert {r.url for r in stale.collect()} == {"u1", "u2"}
    found = spark.createDataFrame([("u1",), ("u3",), ("n/tag/x",), ("n1",), (None,)], "url string")
    urls = lambda df: {r.url for r in df.collect()}
    assert urls(A.work_list(found, scans, stale, False, ["/tag/"])) == {"u1", "u2", "n1"}
    assert urls(A.work_list(found, scans, stale.limit(0), True)) == {"n/tag/x", "n1"}
    assert urls(A.work_list(found, scans, None, False)) == {"u1", "u3", "n/tag/x", "n1"}
    assert {(r.pattern_id, r.status) for r in A.pattern_status(scores, now).collect()} == {("p1", "ok"), ("p2", "ok"), ("p3", "ok"), ("p4", "new")}


def test_empty_tables_in_analytics(spark):
    none = spark.createDataFrame([], "id int, url string, domain string, score int, label string, scanned_at string, published_date string, word_count int")
    assert A.global_stats(none).first().asDict() == {"scans": 0, "domains": 0, "avg_score": None, "likely_human": None, "uncertain": None, "likely_ai": None}
    assert A.corpus_percentile(none, 10).first()[0] == 0.0 and A.domain_stats(none, "x").first().scans == 0
    assert A.domain_leaderboard(none).collect() == [] and A.domain_extremes(none).collect() == [] and A.score_percentiles(none).collect() == []


def test_trending_and_lists(spark):
    stories = discovery.stories(spark.createDataFrame([(0, '{"url":"https://www.a.com/1"}'), (1, '{"url":"https://a.com/2"}'), (2, '{"url":"https://github.com/x"}'), (3, "{}"), (4, "broken")], "position int, json string"))
    out = documents.domain_list(spark.createDataFrame([("www.GitHub.com # code",), ("# all",), ("",), (None,)], "value string"), hosts=True)
    assert [tuple(r) for r in A.trending_domains(stories, out, least=2).collect()] == [("a.com", 2)]
    few = spark.createDataFrame([("https://a.x/p.html",), ("https://a.x/b",)], "url string")
    assert A.article_urls(few, "https://a.x", [".html"]).count() == 2


def test_sources(spark, tmp_path):
    bodies = spark.createDataFrame([("https://a.x", 1, "<urlset><url><loc>https://a.x/p1</loc></url><url><loc>/p2</loc></url><url><loc>p3</loc></url></urlset>"), ("https://a.x", 0, "<none/>"), ("https://b.x", 0, None)], "base string, rank int, body string")
    assert {r.url for r in discovery.sitemap_urls(bodies).collect()} == {"https://a.x/p1", "https://a.x/p2"} == {r.url for r in discovery.first_sitemap(bodies).collect()}
    feed = spark.createDataFrame([("https://a.x", "<link>/feed.xml</link><link>/post/1</link><link rel='self' href='/x.atom'/>")], "base string, body string")
    assert [r.url for r in discovery.feed_urls(feed).collect()] == ["https://a.x/post/1"]
    (tmp_path / "a.html").write_text("<html><head><title>T</title></head><body><nav>Menu</nav><p>" + "word " * 25 + "&amp; more</p><script>x()</script></body></html>")
    (tmp_path / "short.htm").write_text("<p>few</p>")
    (tmp_path / "b.md").write_bytes(b"plain \xff text")
    (tmp_path / "c.txt").write_text("  \n")
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.html", "short.htm", "b.md"} and rows["a.html"].text.endswith("& more") and "Menu" not in rows["a.html"].text and rows["short.htm"].text == "<p>few</p>" and "�" in rows["b.md"].text
    lst = tmp_path / "urls.lst"
    lst.write_text("# c\n\nhttps://a.x/1\n  https://a.x/2 \n # kept\n")
    assert {r.url for r in documents.read_url_list(spark, str(lst)).collect()} == {"https://a.x/1", "https://a.x/2", "# kept"}
    spark.dataSource.register(discovery.LinesSource)
    assert spark.read.format("url_lines").option("path", str(lst)).load().count() == 3

    def fetch(url):
        if url.endswith("2"):
            raise OSError("down")
        return url, "<p>" + "w " * 30 + "</p>"

    got = {r.url: r for r in discovery.fetch_pages(spark.createDataFrame([("https://a.x/1",), ("https://a.x/2",)], "url string"), fetch).collect()}
    assert got["https://a.x/2"].error == "down" and got["https://a.x/1"].html
    docs = documents.documents_from_pages(spark.createDataFrame([("https://a.x/1", got["https://a.x/1"].html), ("https://a.x/3", "<p>few</p>"), (None, None)], "url string, html string"))
    assert [(r.domain, r.n_words) for r in docs.collect()] == [("a.x", 30)]
    assert '"a": null' in output.json_text(spark.sql("select 1 as b, cast(null as int) as a"), one=True)


def test_refresh_in_two_batches_equals_one(spark, tmp_path):
    schema = "url string, domain string, file_path string, text string, scanned_at timestamp, published_date date, title string"
    one = [("u1", "d", None, "It is. " * 30, _at(1), None, "A"), ("u2", "d", None, "Moreover, we go; on.", _at(1), None, None), (None, "", "f", "text", _at(1), None, None)]
    two = [("u1", "d", None, "thus we go " * 20, _at(2), date(2024, 1, 1), None), ("u3", "e", None, None, _at(2), None, None)]
    patterns, weights = load_patterns()[:6], load_weights()
    inbox = tmp_path / "in"
    r = Refresher(spark, str(tmp_path / "s"), patterns, weights)
    for batch in (one, two):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        r.run(spark.readStream.schema(schema).parquet(str(inbox))).awaitTermination()
    whole = Refresher(spark, str(tmp_path / "w"), patterns, weights)
    whole.merge(spark.createDataFrame(one + two, schema))
    key = lambda t: sorted(map(str, t.read().collect()))
    assert key(r.scans) == key(whole.scans) and key(r.scores) == key(whole.scores)
    rows = {x.url: x for x in r.scans.read(SCANS).collect()}
    assert set(rows) == {"u1", "u2", "u3", None} and rows["u1"].title == "A" and rows["u1"].published_date == date(2024, 1, 1)
    r.merge(spark.createDataFrame(two, schema))
    r.merge(spark.createDataFrame(one, schema), 0)  # a batch that was taken in
    r.merge(spark.createDataFrame(one, schema).filter("url is null"))
    assert key(r.scans) == key(whole.scans) and key(r.scores) == key(whole.scores)
    keys = {x.scan_key for x in r.scores.read().collect()}
    assert keys == {x.scan_key for x in r.scans.read().collect()} and len(keys) == 4  # documents without url have scores too
    assert {x.domain for x in recently_scanned(r.scans.read(), 24, datetime(2024, 1, 2, 12)).collect()} == {"d", "e"}


def test_fetching_rules(spark):
    import time

    def fetch(url):
        if "slow" in url:
            time.sleep(3)
        return {"gone": (404, url, "x"), "moved": (200, "https://a.x/new", "<p>here</p>"), "none": None}.get(url.rsplit("/", 1)[1], (200, url, "ok"))

    urls = spark.createDataFrame([(f"https://a.x/{n}",) for n in ("gone", "moved", "none", "slow", *map(str, range(40)))], "url string").coalesce(1)
    got = {r.url.rsplit("/", 1)[1]: r for r in discovery.fetch_pages(urls, fetch, seconds=0.5).collect()}
    assert got["gone"].error == "HTTP 404" and got["none"].error == "no text" and "within" in got["slow"].error and got["moved"].final_url == "https://a.x/new" and sum(r.html == "ok" for r in got.values()) == 40


def test_worker_cycle(spark, tmp_path):
    """Discovery by sitemap index, page and feed, trending hosts, exclusions, limits, outcomes and the failure log, on saved bodies."""
    page = lambda n: f"<html><head><title>{n}</title></head><body><p>{'Moreover, we go there. ' * 30}</p></body></html>"
    saved = {
        "https://a.x/sitemap.xml": "<sitemapindex><sitemap><loc>https://a.x/s1.xml</loc></sitemap></sitemapindex>", "https://a.x/s1.xml": "<urlset><url><loc>/p/1</loc></url><url><loc> https://a.x/p/2 </loc></url><url><loc>https://a.x/tag/3</loc></url></urlset>",
        "https://b.x": "<link rel='alternate' type='application/rss+xml' href='/own.rss'>", "https://b.x/own.rss": "<rss><link>https://b.x/n/1</link><link>https://b.x/x.xml</link></rss>", "https://c.x/rss": "<feed><link href='https://c.x/1'/></feed>",
        "https://hn.x/v0/topstories.json": "[1, 2, 3, 4, 5]", **{f"https://hn.x/v0/item/{i}.json": '{"url": "https://www.c.x/%d"}' % i for i in (1, 2)}, "https://hn.x/v0/item/3.json": '{"url": "https://github.com/x"}', "https://hn.x/v0/item/4.json": '{"url": "https://no.x/y"}',
    }
    fetch = lambda u: (200, u, saved[u]) if u in saved else (200, u, page(u)) if "/p/" in u or "/n/" in u or u == "https://c.x/1" else (404, u, "")
    got = {(r.base, r.via, r.url) for r in discovery.discover_urls(spark.createDataFrame([("https://a.x",), ("https://b.x",), ("https://c.x",), ("https://d.x",)], "base string"), fetch).collect()}
    assert got == {("https://a.x", "sitemap", f"https://a.x/{x}") for x in ("p/1", "p/2", "tag/3")} | {("https://b.x", "feed", "https://b.x/n/1"), ("https://c.x", "feed", "https://c.x/1"), ("https://d.x", None, None)}
    discovery.register_discovery(spark, fetch)
    assert {r.url for r in spark.sql("select d.url from values ('https://b.x'), ('https://d.x') as s(base), lateral discover_urls(s.base) d").collect()} == {"https://b.x/n/1"}
    items = discovery.story_items(spark, fetch, root="https://hn.x/v0")
    assert {r.domain for r in A.trending_domains(discovery.stories(items), spark.createDataFrame([(h,) for h in discovery.EXCLUDED_HOSTS], "domain string"), 5, 1).collect()} == {"c.x", "no.x"}
    refresher = Refresher(spark, str(tmp_path / "s"), load_patterns()[:3], load_weights())
    lines, curated = [], spark.createDataFrame([("a.x",), ("b.x",), ("d.x",)], "domain string")
    run_worker(refresher, curated, fetch, 1, failed_log=str(tmp_path / "log"), report=lines.append, skip=["/tag/"], limit=1)
    run_worker(refresher, curated, fetch, 1, report=lines.append, skip=["/tag/"], limit=5)
    run_worker(refresher, curated, fetch, 1, report=lines.append, skip=["/tag/"], limit=5)
    assert {r.url for r in refresher.scans.read(SCANS).collect()} == {"https://a.x/p/1", "https://a.x/p/2", "https://b.x/n/1"}
    assert [x for x in lines if "scanned" in x] == ["cycle 1: scanned: 2 sites, 2 pages saved", "cycle 1: scanned: 1 sites, 1 pages saved"] and "cycle 1: all_existing: 2 sites, 0 pages saved" in lines
    outcomes = store.VersionedTable(spark, str(tmp_path / "s" / "outcomes")).read()
    assert {(r.domain, r.status) for r in A.scan_status(outcomes, spark.createDataFrame([("a.x",), ("d.x",), ("z.x",)], "domain string")).collect()} == {("a.x", "all_existing"), ("d.x", "no_discovery"), ("z.x", "unknown")}
    assert {r.value for r in spark.read.text(str(tmp_path / "log")).collect()} >= {"d.x"}


def test_scratch_folder(spark, tmp_path):
    from types import SimpleNamespace

    from scrivane import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError):
        session.scratch_root(cluster)
    made = session.materialize(spark.range(3), "kept")
    assert made.count() == 3 and session._made
    session.release(spark)
    assert not session._made


def test_stream_windows_and_dedupe(spark, tmp_path):
    spark.createDataFrame([("u1", "d", 10, _at(1)), ("u1", "d", 10, _at(1)), ("u2", "d", 30, _at(1)), ("u9", "x", 1, _at(9))], "url string, domain string, score int, scanned_at timestamp").write.parquet(str(tmp_path / "i"))
    stream = spark.readStream.schema("url string, domain string, score int, scanned_at timestamp").parquet(str(tmp_path / "i"))
    q = score_windows(first_seen(stream), lateness=None).writeStream.format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.domain, r.scans, r.avg_score) for r in spark.table("w1").collect()] == [("d", 2, 20.0)]


@pytest.mark.parametrize("args", [["patterns", "list"], ["--output", "json", "analyze", "--text", "We go; on. Moreover, it is."], ["patterns", "versions"]])
def test_command_line(spark, args, capsys, tmp_path):
    from scrivane.cli import main

    main(["--store", str(tmp_path), *args], spark)
    assert len(capsys.readouterr().out) > 50
