"""URLs from sitemaps, feeds and story lists, and pages.

Parsing is done by column expressions on tables of what was fetched, or in tasks that fetch. What fetches is a function that the caller brings (tests bring
one that reads saved bodies); ``http_fetcher`` makes one that asks servers.
"""

from __future__ import annotations

import html
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Where sites keep sitemaps and feeds, in the order in which they are tried.
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")
FEEDS = ("/feed.xml", "/feed", "/rss.xml", "/rss", "/atom.xml", "/feeds/posts/default", "/feeds/all.atom.xml", "/index.xml")
#: Hosts of code, video, social networks, search, commerce and reference, which trending stories leave out.
EXCLUDED_HOSTS = (
    "news.ycombinator.com", "github.com", "gitlab.com", "codeberg.org", "bitbucket.org", "sourcehut.org", "sr.ht", "gitea.io", "youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "reddit.com", "old.reddit.com", "lobste.rs",
    "twitter.com", "x.com", "linkedin.com", "mastodon.social", "bsky.app", "threads.net", "google.com", "google.co.uk", "amazon.com", "stackoverflow.com", "docs.google.com", "drive.google.com", "wikipedia.org", "en.wikipedia.org",
)
#: Lists of stories by kind, and the most of one list that are read.
STORY_LISTS = {"top": "topstories", "new": "newstories", "best": "beststories"}
MOST_STORIES = 500
#: Requests at a time in a task, and seconds that one may take.
AT_ONCE, SECONDS = 10, 30.0
#: Sitemaps that one index may name in turn, and how deep indexes may lie in one another.
INDEX_DEPTH = 3

#: A function from a URL to (status, final URL, body), or to (final URL, body) for a page that is there; None for nothing.
Fetch = Callable[[str], "tuple | None"]


def absolute(url: Column, base: Column) -> Column:
    """An absolute URL; one that begins with a slash gets the base, any other is NULL."""
    u = F.btrim(url)
    return F.when(u.rlike("^https?://"), u).when(F.startswith(u, F.lit("/")), F.concat(base, u))


def sitemap_urls(bodies: DataFrame, body: str = "body", base: str = "base") -> DataFrame:
    """(base, url) of all loc elements."""
    loc = F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{body}`"), F.lit("")), F.lit(r"<loc>([^<]+)</loc>"), 1))
    return bodies.select(F.col(f"`{base}`").alias("base"), loc.alias("loc")).select("base", absolute(F.col("loc"), F.col("base")).alias("url")).filter("url is not null")


def first_sitemap(bodies: DataFrame) -> DataFrame:
    """(base, url): of each site's candidates (base, rank, body) only the first that has any URL counts."""
    found = bodies.select("base", "rank", "body")
    urls = found.select("base", "rank", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"<loc>([^<]+)</loc>"), 1)).alias("loc")).select("base", "rank", absolute(F.col("loc"), F.col("base")).alias("url")).filter("url is not null")
    best = urls.groupBy("base").agg(F.min("rank").alias("rank"))
    return urls.join(best, ["base", "rank"]).select("base", "url")


def feed_urls(bodies: DataFrame, body: str = "body", base: str = "base") -> DataFrame:
    """(base, url) of the links in RSS and Atom documents, without links to further feeds."""
    b = F.coalesce(F.col(f"`{body}`"), F.lit(""))
    links = F.concat(F.regexp_extract_all(b, F.lit(r"<link>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)"), 1), F.regexp_extract_all(b, F.lit(r"""<link\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), 1))
    urls = bodies.select(F.col(f"`{base}`").alias("base"), F.explode(links).alias("link")).select("base", absolute(F.col("link"), F.col("base")).alias("url"))
    return without_feeds(urls.filter("url is not null"))


def without_feeds(urls: DataFrame) -> DataFrame:
    return urls.filter(~F.col("url").rlike(r"\.(xml|rss|atom)$"))


def stories(items: DataFrame, json: str = "json") -> DataFrame:
    """(position, url) from items as a story API gives them, one JSON object each; what can't be read has no url."""
    return items.select("position", F.get_json_object(F.col(f"`{json}`"), "$.url").alias("url"))


def http_fetcher(seconds: float = SECONDS, agent: str = "Mozilla/5.0 (compatible; scrivane)") -> Fetch:
    """A function that asks servers, follows redirects and gives the status as it is."""

    def fetch(url: str) -> tuple[int, str, str]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds) as r:
                return r.status, r.url, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, url, ""

    return fetch


def _page(fetch: Fetch, url: str) -> tuple[str, str]:
    """(final URL, body), or an error for what isn't there."""
    got = fetch(url)
    if not got:
        raise LookupError("no text")
    if len(got) == 3:
        if not 200 <= got[0] < 300:
            raise LookupError(f"HTTP {got[0]}")
        got = got[1:]
    return got[0] or url, got[1] or ""


def _body(fetch: Fetch, url: str) -> str:
    try:
        return _page(fetch, url)[1]
    except Exception:  # noqa: BLE001  the next candidate is tried
        return ""


def fetch_pages(urls: DataFrame, fetch: Fetch, at_once: int = AT_ONCE, seconds: float = SECONDS) -> DataFrame:
    """(url, final_url, html, error): every URL through ``fetch``. A status outside 200 to 299, what fetch raises, and a page that takes longer than ``seconds`` become the error.

    URLs are spread evenly over tasks; each task has ``at_once`` requests under way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pool = ThreadPoolExecutor(at_once)
            waiting = [(u, pool.submit(_page, fetch, u)) for u in b["url"]]
            rows = []
            for u, w in waiting:
                try:
                    rows.append((u, *w.result(seconds), None))
                except Late:
                    w.cancel()
                    rows.append((u, None, None, f"no answer within {seconds:g} s"))
                except Exception as e:  # noqa: BLE001  one bad page must not end the batch
                    rows.append((u, None, None, str(e)[:500] or type(e).__name__))
            pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(rows, columns=["url", "final_url", "html", "error"])

    n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return urls.select("url").repartition(n).mapInPandas(run, "url string, final_url string, html string, error string")


_LOC = re.compile(r"<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]+)")
_LINK = re.compile(r"<link>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)|<link\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']")
_ALTERNATE = re.compile(r"<link\b(?=[^>]*\brel\s*=\s*[\"']?alternate)(?=[^>]*application/(?:rss|atom)\+xml)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def _whole(base: str, url: str) -> str | None:
    url = html.unescape(url.strip())
    return url if url.startswith(("http://", "https://")) else base + url if url.startswith("/") else None


def _in_sitemap(base: str, body: str, fetch: Fetch, depth: int = 0) -> list[str]:
    found = [u for x in _LOC.findall(body) if (u := _whole(base, x))]
    if "<sitemapindex" in body:
        return [u for x in found for u in _in_sitemap(base, _body(fetch, x), fetch, depth + 1)] if depth < INDEX_DEPTH else []
    return found


def _in_feed(base: str, body: str) -> list[str]:
    if "<rss" not in body and "<feed" not in body and "<rdf" not in body.lower():
        return []
    return [u for x in _LINK.findall(body) if (u := _whole(base, x[0] or x[1])) and not u.endswith((".xml", ".rss", ".atom"))]


def site_urls(base: str, fetch: Fetch, source: str = "auto") -> tuple[str | None, list[str]]:
    """(where from, URLs of one site): the first sitemap that has any, else the first feed, of those that its front page names and then of the usual ones."""
    if source in ("auto", "sitemap"):
        for path in SITEMAPS:
            if found := _in_sitemap(base, _body(fetch, base + path), fetch):
                return "sitemap", list(dict.fromkeys(found))
    if source in ("auto", "rss"):
        named = [u for x in _ALTERNATE.findall(_body(fetch, base)) if (u := _whole(base, x))]
        for url in [*named, *(base + p for p in FEEDS)]:
            if found := _in_feed(base, _body(fetch, url)):
                return "feed", list(dict.fromkeys(found))
    return None, []


def discover_urls(sites: DataFrame, fetch: Fetch, source: str = "auto", at_once: int = AT_ONCE) -> DataFrame:
    """(base, via, position, url): the URLs of every site (base: scheme and authority), in order; a site without any has one row with NULL in place of them.

    Sites are spread over tasks; a task has ``at_once`` of them under way.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for base, (via, urls) in zip(b["base"], pool.map(lambda x: site_urls(x, fetch, source), b["base"])):
                    yield pd.DataFrame({"base": base, "via": pd.Series([via] * max(1, len(urls)), dtype="string"), "position": range(max(1, len(urls))), "url": pd.Series(urls or [None], dtype="string")})

    n = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sites.select("base").filter("base is not null").distinct().repartition(n).mapInPandas(run, "base string, via string, position int, url string")


def register_discovery(spark: SparkSession, fetch: Fetch, name: str = "discover_urls", source: str = "auto") -> None:
    """Makes discovery a table function of SQL: ``select s.domain, d.* from sites s, lateral discover_urls(s.base) d`` gives (via, position, url)."""

    class Discover:
        def eval(self, base: str):
            via, urls = site_urls(base, fetch, source) if base else (None, [])
            for i, url in enumerate(urls):
                yield via, i, url

    spark.udtf.register(name, F.udtf(Discover, returnType="via string, position int, url string"))


def story_items(spark: SparkSession, fetch: Fetch, kind: str = "top", limit: int = 200, root: str = "https://hacker-news.firebaseio.com/v0", at_once: int = AT_ONCE) -> DataFrame:
    """(position, json) of the first stories of a list, no more than MOST_STORIES; empty where the list can't be read. An item that can't be read has NULL."""
    ids = json.loads(_body(fetch, f"{root}/{STORY_LISTS.get(kind, STORY_LISTS['top'])}.json") or "[]")[: max(1, min(int(limit), MOST_STORIES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                bodies = pool.map(lambda i: _body(fetch, f"{root}/item/{i}.json") or None, b["id"])
                yield pd.DataFrame({"position": b["position"], "json": pd.Series(list(bodies), dtype="string")})

    return spark.createDataFrame(list(enumerate(ids)), "position bigint, id bigint").repartition(8).mapInPandas(run, "position bigint, json string")


class LinesSource(DataSource):
    """A data source ``url_lines``: the URLs of list files, one partition for each path (options path, separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "url_lines"

    def schema(self) -> str:
        return "url string, list string"

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader([p for p in self.options.get("path", "").split(",") if p])


class _LinesReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            for line in f:
                if line.strip() and not line.startswith("#"):
                    yield line.strip(), partition.value
