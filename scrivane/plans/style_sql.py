"""The style queries in SQL."""

from __future__ import annotations

from scrivane.functions.text import LINE_END, WS
from scrivane.operators.scoring import CATEGORIES
from scrivane.sources.documents import ENTITIES
from scrivane.plans.style_queries import MARKS, TAGS, TERMS, TEXT_TAGS, WORDS

_q = lambda s: s.replace("'", "''")
_T = "coalesce(text, '')"


def _words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda x: x <> '')"


def _n(t: str) -> str:
    return f"len({_words(t)})"


def _sub(t: str, term: str) -> str:
    return f"cast((length({t}) - length(replace({t}, '{_q(term)}', ''))) / length('{_q(term)}') as bigint)"


def _matches(t: str, pattern: str, options: str = "i") -> str:
    return f"len(regexp_extract_all({t}, '(?{options}){_q(pattern)}'))"


def _exact(t: str, w: str) -> str:
    return f"{_sub(t, f' {w} ')} + cast(starts_with({t}, '{w} ') as bigint)"


_STRIP = f"regexp_replace({_T}, '^{WS}+|{WS}+$', '', 'g')"
_SPLIT = rf"""string_split(regexp_replace({_STRIP}, '([.!?]){WS}+([A-Z"])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
#: Twice, as two ends that share a character are found one after the other.
_SENT = f"list_filter(list_transform({_SPLIT}, lambda s: {{'n': {_n('s')}, 'q': regexp_matches(s, '\\?{WS}*$')}}), lambda s: s.n >= 2)"
_VAR = lambda xs, least: f"case when len({xs}) >= {least} then greatest(0.0, 1 - coalesce(list_aggregate({xs}, 'stddev_samp') / list_aggregate({xs}, 'avg'), 0)) else 0.0 end"
_PARAS = rf"list_transform(list_filter(string_split_regex({_T}, '\n{WS}*\n'), lambda p: regexp_replace(p, '{WS}+', '', 'g') <> ''), lambda p: cast({_n('p')} as double))"
_SCANS = "(select distinct id, url, domain, file_path, word_count, score, label, categories, scanned_at, published_date, title, node from scans)"
_V = "case when isnan(norm_score) then null else norm_score end"
_EXCLUDED = r"(select distinct regexp_replace(lower(trim(regexp_replace(domain, '#.*$', ''))), '^www\.', '') as domain from dim_excluded where trim(regexp_replace(domain, '#.*$', '')) <> '')"
_LOW = f"lower({_T})"
_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_HOST = rf"nullif(regexp_replace(lower(trim({_AUTH})), '^www\.', ''), '')"


def _plain(h: str) -> str:
    """html_to_text in SQL; its one expression with a backreference is written out for each tag."""
    whole = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "head", "nav", "noscript", "template", "svg"))
    t = rf"regexp_replace({h}, '(?is)<!--.*?-->|{whole}', ' ', 'g')"
    t = rf"regexp_replace({t}, '[ \t\r\n]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|aside|header|footer|blockquote|pre|br|hr|td|th|dd|dt|dl|figure|main|form)\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^<>]*>', '', 'g')"
    for entity, char in ENTITIES.items():
        t = f"replace({t}, '{_q(entity)}', '{_q(char)}')"
    return rf"trim(regexp_replace({t}, '[ \t]*\n[ \t\n]*', chr(10), 'g'), ' ' || chr(10) || chr(9))"


_PLAIN = _plain("raw_html")


def _clamp(raw: str, low: float, high: float) -> str:
    return f"case when {raw} <= {low} then 0.0 when {raw} >= {high} then 1.0 else ({raw} - {low}) / {float(high - low)} end"


_PROBED = f"""p as (select doc_id, cast({_n(_T)} as bigint) as n_words, ({' + '.join(_sub(_LOW, t) for t in TERMS)}) as t, ({' + '.join(_exact(_LOW, w) for w in WORDS)}) as w, ({' + '.join(_matches(_T, m) for m in MARKS)}) as m from documents),
    r as (select doc_id, n_words, t / cast(greatest(n_words, 1) as double) * 1000 as terms, w / cast(greatest(n_words, 1) as double) * 1000 as words, m / cast(greatest(n_words, 1) as double) * 1000 as marks from p),
    n as (select *, {_clamp('terms', 5, 60)} as nt, {_clamp('words', 1, 50)} as nw, {_clamp('marks', 40, 160)} as nm from r)"""


def _placed(order: str, most: int, where: str = "true") -> str:
    return f"select id, domain, place from (select *, row_number() over (partition by domain order by {order}, url asc nulls last, id) as place from {_SCANS} where {where}) where place <= {most}"


_STALE = f"""select distinct s.url from {_SCANS} s join pattern_scores p on p.scan_id = s.id join dim_patterns c on c.id = p.pattern_id
    where s.url is not null and (p.pattern_version < c.version or (coalesce(c.hash, '') <> '' and coalesce(p.pattern_hash, '') <> c.hash))"""

SQL = {
    "word_count": f"select doc_id, cast({_n(_T)} as bigint) as n_words from documents",
    "freq_contains": f"select doc_id, {' + '.join(_sub(_LOW, t) for t in TERMS)} as n from documents",
    "freq_exact": f"select doc_id, {' + '.join(_exact(_LOW, w) for w in WORDS)} as n from documents",
    "regex_count": f"select doc_id, {' + '.join(_matches(_T, m) for m in MARKS)} as n from documents",
    "html_regex_count": f"select scan_id, {' + '.join(_matches('raw_html', m, 'is') for m in TAGS)} as n from fetch_results where raw_html is not null",
    "html_text_fallback": f"select scan_id, case when raw_html is not null then {' + '.join(_matches('raw_html', m, 'is') for m in TAGS)} else {' + '.join(_matches(_T, m, 'im') for m in TEXT_TAGS)} end as n from fetch_results",
    "bullet_density": rf"""select doc_id, case when lines = 0 then 0.0 else round(n / cast(lines as double), 6) end as ratio from (select doc_id, len(regexp_extract_all({_T}, '(?m)^{WS}*(?:[-*•·◦▪▸►✓✗]|[0-9]+[.)]{WS}){WS}*[^{WS[1:]}')) as n,
        len(list_filter(string_split_regex({_T}, '{LINE_END}'), lambda x: regexp_replace(x, '{WS}+', '', 'g') <> '')) as lines from documents)""",
    "header_ratio": f"select doc_id, round(len(regexp_extract_all({_T}, '(?m)^#{{1,6}}{WS}+[^{WS[1:]}')) / cast(greatest({_n(_T)}, 1) as double), 6) as ratio from documents",
    "paragraph_uniformity": f"select doc_id, round({_VAR('x', 3)}, 6) as value from (select doc_id, {_PARAS} as x from documents)",
    "emoji_density": rf"select doc_id, round(len(regexp_extract_all({_T}, '[\x{{1F600}}-\x{{1F64F}}\x{{1F300}}-\x{{1F5FF}}\x{{1F680}}-\x{{1F6FF}}\x{{1F1E0}}-\x{{1F1FF}}\x{{2702}}-\x{{27B0}}\x{{24C2}}-\x{{1F251}}]+')) / cast(greatest(length({_T}), 1) as double), 6) as ratio from documents",
    "sentence_split": f"select doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(list_sum(list_transform(s, lambda x: x.n)), 0) as bigint) as n_words from (select doc_id, {_SENT} as s from documents)",
    "sentence_burstiness": f"select doc_id, round({_VAR('x', 4)}, 6) as value from (select doc_id, list_transform({_SENT}, lambda s: cast(s.n as double)) as x from documents)",
    "avg_sentence_length": f"select doc_id, round(coalesce(list_avg(list_transform({_SENT}, lambda s: cast(s.n as double))), 0.0), 6) as value from documents",
    "question_rate": f"""select doc_id, round(share, 6) as share, case when k = 0 then 0.0 else round(least(1.0, greatest(0.0, 1 - share / 0.08), 0.7), 6) end as value
        from (select doc_id, len(s) as k, len(list_filter(s, lambda x: x.q)) / cast(greatest(len(s), 1) as double) as share from (select doc_id, {_SENT} as s from documents))""",
    "type_token_ratio": f"""select doc_id, case when len(w) < 50 then 0.0 else round(greatest(0.0, 1 - list_avg(list_transform(generate_series(0, len(w) - 50, 25), lambda i: len(list_distinct(w[i + 1 : i + 50])) / 50.0))), 6) end as value
        from (select doc_id, list_transform({_words(_LOW)}, lambda x: trim(x, '.,!?;:"''()[]')) as w from documents)""",
    "stylistic_index": f"""with {_PROBED}, c as (select *, (nt * 0.8 + nw * 0.4) / (0.8 + 0.4) as ph, nm * 0.5 / 0.5 as pu from n), i as (select *, greatest(0, least(100, cast(round_even((ph * 0.2 + pu * 0.15) * 100, 0) as bigint))) as s from c)
        select doc_id, n_words, round(terms, 6) as terms, round(words, 6) as words, round(marks, 6) as marks, round(ph, 6) as phrases, round(pu, 6) as punctuation, s as score, case when s <= 15 then 'LIKELY HUMAN' when s >= 30 then 'LIKELY AI' else 'UNCERTAIN' end as label from i""",
    "pattern_scores_long": f"""with {_PROBED} select doc_id, 'probe_terms' as pattern_id, 'phrases' as category, round(nt, 6) as norm_score, 1 as pattern_version from n
        union all select doc_id, 'probe_words', 'phrases', round(nw, 6), 1 from n union all select doc_id, 'probe_marks', 'punctuation', round(nm, 6), 1 from n""",
    "normalize_clamp": """with p as (select id, cast(json_extract_string(params, '$.low') as double) as low, cast(json_extract_string(params, '$.high') as double) as high from dim_patterns)
        select pattern_id, count(*) as n, round(avg(case when raw_value <= low then 0.0 when raw_value >= high then 1.0 else (raw_value - low) / (high - low) end), 6) as avg_norm from pattern_scores s join p on p.id = s.pattern_id group by pattern_id""",
    "category_weighted_mean": "select scan_id, " + ", ".join(f"round(coalesce(sum(norm_score * p.weight) filter (where s.category = '{c}') / sum(p.weight) filter (where s.category = '{c}'), 0.0) + 1e-9, 6) + 0.0 as {c}" for c in CATEGORIES) + " from pattern_scores s join dim_patterns p on p.id = s.pattern_id where norm_score is not null and not isnan(norm_score) group by scan_id",
    "label_assignment": f"select id, case when score <= 15 then 'LIKELY HUMAN' when score >= 30 then 'LIKELY AI' else 'UNCERTAIN' end as computed from {_SCANS} where score is not null",
    "model_similarity": f"""with o as (select scan_id, pattern_id, max(norm_score) as v from pattern_scores where norm_score is not null and not isnan(norm_score) group by all), m as (select distinct model_id from dim_model_profiles),
        s as (select scan_id, model_id, 1 - avg(abs(v - expected)) as similarity from o join dim_model_profiles using (pattern_id) group by all)
        select i.scan_id, m.model_id, round(coalesce(s.similarity, 0.0) + 1e-9, 6) + 0.0 as similarity from (select distinct scan_id from o) i cross join m left join s on s.scan_id = i.scan_id and s.model_id = m.model_id""",
    "rank_results": f"select url, score, place from (select url, score, row_number() over (order by score desc nulls last, url) as place from (select url, max(score) as score from {_SCANS} where url is not null group by url)) where place <= 200",
    "delta_vector": f"""with l as (select * from {_SCANS} where domain <> '' and word_count > 100 and score is not null), h as (select *, row_number() over (partition by domain order by score desc, url asc nulls last, id) as n from l),
        w as (select *, row_number() over (partition by domain order by score, url asc nulls last, id) as n from l) select h.domain, {', '.join(f'round(h.categories.{c} - w.categories.{c} + 1e-9, 6) + 0.0 as {c}' for c in CATEGORIES)} from h join w on w.domain = h.domain where h.n = 1 and w.n = 1""",
    "leaderboard": f"select id, domain, score, label from {_SCANS} order by score desc nulls last, url asc nulls last, id limit 50",
    "leaderboard_label_filter": f"select id, domain, score, label from {_SCANS} where label = 'UNCERTAIN' order by score desc nulls last, url asc nulls last, id limit 50",
    "leaderboard_page2": f"select id, domain, score, label from {_SCANS} order by score desc nulls last, url asc nulls last, id limit 50 offset 50",
    "domain_stats": f"""select domain, count(*) as scans, round_even(avg(score), 1) as avg_score, max(score) as max_score, min(score) as min_score, max(scanned_at) as latest, cast(sum(case when label = 'LIKELY HUMAN' then 1 else 0 end) as bigint) as likely_human,
        cast(sum(case when label = 'UNCERTAIN' then 1 else 0 end) as bigint) as uncertain, cast(sum(case when label = 'LIKELY AI' then 1 else 0 end) as bigint) as likely_ai from {_SCANS} group by domain""",
    "domain_leaderboard": f"""select *, row_number() over (order by avg_score desc nulls last, domain) as place from (select domain, count(*) as scans, round(avg(score), 1) as avg_score, max(score) as max_score, max(scanned_at) as latest
        from {_SCANS} where domain <> '' group by domain order by avg_score desc nulls last, domain limit 100)""",
    "leaderboard_percentile": f"""with b as (select domain, round(avg(score), 1) as a from {_SCANS} where domain <> '' group by domain)
        select domain, cast(round((select count(*) from b x where x.a <= b.a) / cast((select count(*) from b) as double) * 100) as bigint) as percentile from b where a is not null""",
    "quiet_domains": f"select domain, round(avg(score), 1) as avg_score from {_SCANS} where domain <> '' group by domain having avg(score) <= 25",
    "corpus_percentile": f"select round_even(sum(case when score <= 25 then 1 else 0 end) / cast(count(*) as double), 3) as percentile from {_SCANS}",
    "score_percentiles": f"select distinct score, round_even((select count(*) from {_SCANS} x where x.score <= s.score) / cast((select count(*) from {_SCANS}) as double), 3) as percentile from {_SCANS} s where score is not null",
    "global_stats": f"""select count(*) as scans, count(distinct domain) as domains, round(avg(score), 1) as avg_score, cast(sum(case when label = 'LIKELY HUMAN' then 1 else 0 end) as bigint) as likely_human,
        cast(sum(case when label = 'UNCERTAIN' then 1 else 0 end) as bigint) as uncertain, cast(sum(case when label = 'LIKELY AI' then 1 else 0 end) as bigint) as likely_ai from {_SCANS}""",
    "pattern_stats": f"select pattern_id, min(category) as category, round(avg({_V}), 6) as avg_score, count(*) as occurrences from pattern_scores group by pattern_id",
    "category_report": f"select category, pattern_id, round(avg({_V}), 6) as avg_score, count(*) as n from pattern_scores group by rollup (category, pattern_id)",
    "pattern_stats_catalog": f"select s.*, p.name, p.detection_type, p.version, p.severity from (select pattern_id, min(category) as category, round(avg({_V}), 6) as avg_score, count(*) as occurrences from pattern_scores group by pattern_id) s left join dim_patterns p on p.id = s.pattern_id",
    "scan_status": f"select domain, first(label order by t desc nulls last, label desc nulls last) as status, first(t order by t desc nulls last, label desc nulls last) as \"at\" from (select domain, label, max(word_count) as t from {_SCANS} group by domain, label) group by domain",
    "outcome_counts": f"select label as status, count(*) as domains, cast(coalesce(sum(word_count), 0) as bigint) as saved from {_SCANS} group by label",
    "badges": f"""select domain, case when a is null then 'style null' else printf('style %.1f', a) end as text, case when a >= 65 then 'red' when a >= 35 then 'yellow' else 'green' end as colour
        from (select domain, cast(round_even(avg(score), 1) as double) as a from {_SCANS} where domain <> '' group by domain)""",
    "html_to_text": f"select scan_id, cast(length(t) as int) as n_chars, cast({_n('t')} as bigint) as n_words from (select scan_id, {_PLAIN} as t from fetch_results where raw_html is not null)",
    "word_freq_variance": r"""with w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]+'), lambda x: regexp_full_match(x, '[a-z]+'))) as word from documents),
        z as (select word, log10(count(*) * (1e9 / (select count(*) from w))) as zipf from w group by word), k as (select doc_id, case when zipf > 0 then zipf end as z from w join z using (word) where length(word) >= 4)
        select doc_id, round_even(stddev_samp(z), 4) as zipf_raw from k group by doc_id having count(*) >= 30 and count(z) >= 20""",
    "pattern_version_summary": "select pattern_id, cast(max(pattern_version) as bigint) as max_version, count(distinct scan_id) as scan_count from pattern_scores group by pattern_id",
    "pattern_version_status": """select p.id as pattern_id, count(distinct scan_id) as scan_count, case when max(pattern_version) is null then 'new' when max(pattern_version) < p.version then 'STALE' else 'ok' end as status
        from dim_patterns p left join pattern_scores s on s.pattern_id = p.id group by p.id, p.version""",
    "stale_urls": _STALE,
    "new_urls_anti_join": "select distinct url from documents where url is not null and url not in (select url from scans where url is not null)",
    "work_list": f"{_STALE} union select url from documents where url is not null and not contains(url, '/tag/') and not contains(url, '/author/') and url not in (select url from scans where url is not null)",
    "domain_trend": f"select id, domain, published_date, score from {_SCANS} where domain <> '' and published_date is not null",
    "trend_last_120": f"select id, domain, published_date from (select *, row_number() over (partition by domain order by published_date desc, url asc nulls last, id) as n from {_SCANS} where domain <> '' and published_date is not null) where n <= 120",
    "monthly_trend": "select domain, strftime(landed, '%Y-%m') as month, count(*) as scans, round(avg(score), 6) as avg_score from (select id, domain, score, min(landed_at) as landed from scans group by id, domain, score) group by domain, month",
    "domain_scans_recent": _placed("scanned_at desc nulls last", 20),
    "domain_scans_highest": _placed("score desc nulls last", 20),
    "domain_scans_lowest": _placed("score asc nulls last", 20),
    "domain_extremes": f"select id, domain, 'highest' as side, place from ({_placed('score desc', 5, 'word_count > 100 and score is not null')}) union all select id, domain, 'lowest', place from ({_placed('score', 5, 'word_count > 100 and score is not null')})",
    "category_avgs_recent20": f"select domain, count(*) as scans, {', '.join(f'round(avg(categories.{c}), 6) as {c}' for c in CATEGORIES)} from (select *, row_number() over (partition by domain order by scanned_at desc nulls last, url asc nulls last, id) as n from {_SCANS}) where n <= 20 group by domain",
    "upsert_latest": """select url, first(domain order by landed_at asc nulls first, domain asc nulls first) as domain, first(file_path order by landed_at asc nulls first, file_path asc nulls first) as file_path,
        first(score order by landed_at desc nulls last, score desc nulls last, id desc) as score, first(title order by landed_at desc nulls last, title desc) filter (where title is not null) as title,
        first(published_date order by landed_at desc nulls last, published_date desc) filter (where published_date is not null) as published_date,
        first(id order by landed_at desc nulls last, score desc nulls last, id desc) as scan, strftime(max(landed_at), '%Y-%m-%d %H:%M:%S.%f') as at from scans where url is not null group by url""",
    "replace_children": """with f as (select scan_id, max(pattern_version) as v from pattern_scores where pattern_version < 2 and scan_id is not null group by scan_id)
        select scan_id, count(*) as n, max(pattern_id) as last, cast(sum(pattern_version) as bigint) as versions from pattern_scores where scan_id not in (select scan_id from f) group by scan_id union all select scan_id, 1, 'rescan', v from f""",
    "delete_domain": f"select 'scans' as part, domain as key, count(*) as n from {_SCANS} where domain <> '' group by domain union all select 'scores', pattern_id, count(*) from pattern_scores where scan_id not in (select id from scans where domain = '') group by pattern_id",
    "excluded_domains": f"select domain from {_EXCLUDED}",
    "delete_excluded": f"select domain, case when gone then n else 0 end as deleted, case when gone then 0 else n end as kept from (select domain, count(*) as n, coalesce(domain in (select domain from {_EXCLUDED}), false) as gone from {_SCANS} group by domain)",
    "url_authority": f"select doc_id, {_AUTH} as authority from documents where url is not null",
    "host_normalize": f"select doc_id, {_HOST} as host from documents",
    "trending_domains": f"""select host as domain, count(*) as stories from (select doc_id, {_HOST} as host from (select doc_id, url from documents where url is not null order by doc_id limit 500)) where host is not null and host not in (select domain from {_EXCLUDED})
        group by host having count(*) >= 2 order by count(*) desc, min(doc_id) limit 25""",
    "skip_pattern_filter": "select scan_id from fetch_results where url is not null and not contains(url, '/2024/') and not contains(url, 'status')",
    "article_urls": f"""with u as (select distinct url, regexp_extract(url, '^(https?://[^/?#]*)', 1) as base from {_SCANS} where url is not null),
        k as (select *, ends_with(url, '.html') or ends_with(url, '.htm') or ends_with(url, '/') or contains(regexp_replace(substr(url, length(base) + 1), '^/+', ''), '/') as keep from u)
        select url from k where keep or base in (select base from k group by base having count(*) filter (where keep) < 3)""",
    "min_words_filter": f"select doc_id from documents where {_n(_T)} >= 50",
    "sitemap_locs": "select trim(url) as url from documents where url is not null",
    "score_json_roundtrip": f"select id, {', '.join(f'round(categories.{c}, 6) as {c}' for c in CATEGORIES)} from {_SCANS}",
}
