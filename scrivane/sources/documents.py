"""Documents from files, texts, markup and lists. Reading is Spark's; what is built here are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.text import authority, strip, word_count

#: Pages with fewer words than this give no document.
LEAST_WORDS = 20
#: The entities that plain pages use, and what they stand for. The ampersand is last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&middot;": "·", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&copy;": "©", "&amp;": "&"}


def html_to_text(html: Column) -> Column:
    """Markup to text: scripts, styles, head, navigation and comments out; block tags as line ends; entities read; blank lines out."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|nav|noscript|template|svg)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)[ \t\r\n]+", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|aside|header|footer|blockquote|pre|br|hr|td|th|dd|dt|dl|figure|main|form)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]*\n[ \t\n]*", "\n")
    return F.btrim(t, F.lit(" \n\t"))


def html_title(html: Column) -> Column:
    t = F.btrim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)


def documents_from_pages(pages: DataFrame, html: str = "html", url: str = "url", least_words: int = LEAST_WORDS) -> DataFrame:
    """url, domain, title, text, n_words, raw_html of the pages whose text has words enough."""
    h = F.col(f"`{html}`")
    docs = pages.select(F.col(f"`{url}`").alias("url"), h.alias("raw_html"), F.inline(F.array(F.struct(html_to_text(h).alias("text")))))
    docs = docs.withColumns({"domain": F.coalesce(authority(F.col("url")), F.lit("")), "title": html_title(F.col("raw_html")), "n_words": word_count(F.col("text"))})
    return docs.filter(F.col("n_words") >= least_words)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_path, text, raw_html, n_words of text and HTML files; bytes that aren't UTF-8 are replaced, blank files left out.

    An HTML file whose text has fewer than LEAST_WORDS words is taken as it is.
    """
    raw = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    is_html = F.lower("file_path").rlike(r"\.html?$")
    raw = raw.select("file_path", F.when(is_html, F.col("body")).alias("raw_html"), "body", F.inline(F.array(F.struct(F.when(is_html, html_to_text(F.col("body"))).alias("plain")))))
    text = F.when((F.col("plain").isNotNull()) & (word_count(F.col("plain")) >= LEAST_WORDS), F.col("plain")).otherwise(F.col("body"))
    return raw.select("file_path", text.alias("text"), "raw_html").filter(strip(F.col("text")) != "").withColumn("n_words", word_count(F.col("text")))


def from_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """text, n_words of texts given directly; they have neither url nor path."""
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("n_words", word_count(F.col("text")))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) from a list: blank lines and lines that begin with # are left out."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.btrim("value") != ""))
    return lines.select(F.btrim("value").alias("url"))


def domain_list(lines: DataFrame, column: str = "value", hosts: bool = False) -> DataFrame:
    """(domain) from lines of a list; what follows a # is a comment. hosts: lower case without www., as in lists of exclusions."""
    d = F.btrim(F.regexp_replace(F.coalesce(F.col(f"`{column}`"), F.lit("")), r"#.*$", ""))
    d = F.regexp_replace(F.lower(d), r"^www\.", "") if hosts else d
    return lines.select(d.alias("domain")).filter("domain <> ''").distinct()
