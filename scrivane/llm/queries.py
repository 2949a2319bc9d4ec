"""Queries on the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm.eval_leaks import leaked_items
from scrivane.llm.main_body import furniture_lines
from scrivane.llm.packing import pack_texts
from scrivane.llm.percentiles import merge_summaries, percentiles, read_summary, summary
from scrivane.llm.shared_spans import SharedSpans
from scrivane.llm.site_lines import repeated_lines, without_lines
from scrivane.llm.template_residue import residue
from scrivane.llm.top_items import top_items
from scrivane.session import table


def scan_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scans").select(F.col("id").alias("scan_id"), "domain").dropDuplicates(["scan_id"])


def site_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "fetch_results").select("scan_id", "text", *columns).join(scan_domains(spark, d), "scan_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    scans = table(spark, d, "scans").filter("domain <> ''")
    return top_items(scans, "domain", "score", "id", 5).select(F.col("group").alias("domain"), F.col("item").alias("scan_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "scans").select("id", "domain", "title", F.lit(None).cast("string").alias("text")).dropDuplicates(["id"])
    texts = table(spark, d, "fetch_results").select(F.col("scan_id").alias("id"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("title"), "text")
    return residue(titles.unionByName(texts), "id", {"title": True, "text": False}, "domain").select("field_name", F.col("record").alias("scan_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "scans").select(F.col("id").alias("scan_id"), "domain", "title").dropDuplicates(["scan_id"])
    return furniture_lines(table(spark, d, "fetch_results"), "scan_id", "domain", "title", "text", "raw_html", names).select(F.col("scan").alias("scan_id"), "line_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(site_texts(spark, d), "scan_id", "domain", "text").select(F.col("doc").alias("scan_id"), "line_no")


def p5_cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = site_texts(spark, d)
    return without_lines(texts, "scan_id", "text", repeated_lines(texts, "scan_id", "domain", "text")).select("scan_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


_QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """norm_score per pattern and score per domain; a scan that was delivered twice counts once."""
    columns = [F.col("values")[i].alias(n) for i, n in enumerate(_QUANTILES)]
    scans = table(spark, d, "scans").select("id", "domain", "score").dropDuplicates(["id"])
    a = percentiles(table(spark, d, "pattern_scores"), "pattern_id", "norm_score", list(_QUANTILES.values()))
    b = percentiles(scans, "domain", "score", list(_QUANTILES.values()))
    return a.select(F.lit("norm_score").alias("field_name"), "group", "n", *columns).unionByName(b.select(F.lit("score").alias("field_name"), "group", "n", *columns))


def p7_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of two separate loads of pattern_scores (scans with even and odd numbers), merged, and what is read from them."""
    scores = table(spark, d, "pattern_scores")
    loads = [summary(scores.filter(F.pmod("scan_id", F.lit(2)) == k), "pattern_id", "norm_score", 200) for k in (0, 1)]
    merged = read_summary(merge_summaries(loads[0].unionByName(loads[1])), list(_QUANTILES.values()))
    return merged.select("group", "n", *(F.col("values")[i].alias(n) for i, n in enumerate(_QUANTILES)))


#: A parameter of the queries: the rank file of a public byte-level vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Kinds of containers that may be filled at once; more are refused.
MOST_KINDS = 1000


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = {r[0]: r[1] for r in table(spark, d, "container_sizes").select("container", "capacity_tokens").limit(MOST_KINDS + 1).collect()}
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", kinds, VOCABULARY).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents"), "doc_id", "text").pairs().select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents"), "doc_id", "text").coverage().withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p5_cleaned_texts, p7_percentiles, p7_merged_loads, p8_packed, p9_found, p10_found, p10_coverage)}

_LINES = r"""
    docs as (select f.scan_id, s.domain, f.text from fetch_results f join (select distinct id, domain from scans) s on s.id = f.scan_id where f.text is not null),
    lines as (select scan_id, domain, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no from docs),
    same as (select scan_id, domain, line, line_no, trim(regexp_replace(regexp_replace(lower(line), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '\p{Nd}+', '0', 'g')) as t from lines),
    often as (select domain, t from same where t <> '' group by domain, t having count(distinct scan_id) >= 4
        and count(distinct scan_id) >= 0.2 * (select count(*) from docs d where d.domain = same.domain)),
    hits as (select scan_id, cast(line_no as int) as line_no from same join often using (domain, t))"""

#: Texts once each, with the documents that have them; all windows of 320 characters.
_SPANS = """with t as (select text, min(doc_id) as rep, list(doc_id) as docs, count(*) as n from documents where text <> '' group by text),
    w as (select rep, i, md5_number(substr(text, i, 320)) as h from (select rep, text, unnest(generate_series(1, length(text) - 319)) as i from t where length(text) >= 320)),
    s as (select rep, i, h from w where h in (select h from w group by h having count(distinct rep) > 1))"""

SQL = {
    "p10_found": f"""{_SPANS}, m as (select rep, unnest(docs) as doc_id from t where length(text) >= 320), p as (select distinct a.rep as x, b.rep as y from (select distinct rep, h from s) a join (select distinct rep, h from s) b on a.h = b.h and a.rep < b.rep)
        select least(a.doc_id, b.doc_id) as doc_id_a, greatest(a.doc_id, b.doc_id) as doc_id_b from p join m a on a.rep = p.x join m b on b.rep = p.y union all select a.doc_id, b.doc_id from m a join m b on a.rep = b.rep and a.doc_id < b.doc_id""",
    "p10_coverage": f"""{_SPANS}, c as (select rep, sum(least(320, coalesce(following - i, 320))) as c from (select rep, i, lead(i) over (partition by rep order by i) as following from s) group by rep)
        select doc_id, rep as class_doc, n as n_copies, cast(length(text) as int) as n_chars, cast(case when n > 1 and length(text) >= 320 then length(text) else coalesce(c, 0) end as bigint) as shared_chars
        from (select unnest(docs) as doc_id, rep, n, text from t) left join c using (rep)""",
    "p1_found": """select domain, scan_id from (select domain, id as scan_id, row_number() over (partition by domain order by score desc, id) as n
        from (select distinct id, domain, score from scans) where domain <> '' and score is not null) where n <= 5""",
    "p5_found": f"with {_LINES} select scan_id, line_no from hits",
    "p7_percentiles": "with v as (select 'norm_score' as field_name, pattern_id as grp, norm_score as v from pattern_scores where norm_score is not null and not isnan(norm_score) union all "
    "select 'score', domain, cast(score as double) from (select distinct id, domain, score from scans) where score is not null and domain is not null), "
    "o as (select *, row_number() over (partition by field_name, grp order by v) as r, count(*) over (partition by field_name, grp) as n from v) "
    "select field_name, grp as \"group\", n, " + ", ".join(f"max(v) filter (where r = greatest(1, cast(ceil(round({q} * n, 9)) as bigint))) as {name}" for name, q in _QUANTILES.items()) + " from o group by all",
    "p5_cleaned_texts": f"""with {_LINES}, kept as (select scan_id, string_agg(line, chr(10) order by line_no) as t from same s where not exists (select 1 from hits h where h.scan_id = s.scan_id and h.line_no = s.line_no) group by scan_id)
        select d.scan_id, md5(coalesce(k.t, '')) as text_md5, cast(length(coalesce(k.t, '')) as int) as n_chars from docs d left join kept k using (scan_id)""",
}
