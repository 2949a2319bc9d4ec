"""Operators for training data against brute force, on small fixtures with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivane.llm import eval_leaks, main_body, packing, percentiles, shared_spans, site_lines, template_residue
from scrivane.llm.queries import VOCABULARY
from scrivane.llm.top_items import LoserTree, merge_runs, merge_top, sorted_runs, top_items


# Top items


def test_loser_tree_sorts():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        at, out, tree = [0] * k, [], LoserTree([r[0] if r else None for r in runs])
        while (x := tree.heads[w := tree.tree[0]]) is not None:
            out.append(x)
            at[w] += 1
            tree.replace(w, runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_merge_seeks_past_a_group():
    runs = [[("a", -i, i) for i in range(9, 0, -1)] + [("b", -1, 1)], [("a", -20, 0), ("a", -9, 9), ("c", 0, 0)], []]
    assert [r[:3] for r in merge_runs(runs, 2)] == [("a", -20, 0), ("a", -9, 9), ("b", -1, 1), ("c", 0, 0)]


@pytest.mark.parametrize("parts", [1, 7])
def test_top_items(spark, parts):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", rng.randrange(6), i) for i in range(3000)]
    rows += rows[:200] + [(None, 1, 1), ("", 3, 9000), ("only", None, 9001), ("x", 1, None)]
    df = spark.createDataFrame(rows, "g string, s int, i long").withColumn("bucket", F.lit("clash")).repartition(parts)
    want = defaultdict(set)
    for g, s, i in rows:
        if None not in (g, s, i):
            want[g].add((-s, i))
    want = {(g, i, -s, n) for g, v in want.items() for n, (s, i) in enumerate(sorted(v)[:5], 1)}
    got = [tuple(r) for r in top_items(df, "g", "s", "i", 5).collect()]
    assert set(got) == want and len(got) == len(want)
    loads = sorted_runs(df.filter("i % 2 = 0"), "g", "s", "i", 5).unionByName(sorted_runs(df.filter("i % 2 = 1"), "g", "s", "i", 5))
    assert {tuple(r) for r in merge_top(loads, 5).collect()} == want
    assert top_items(df.limit(0), "g", "s", "i", 5).collect() == []
    d = top_items(df.select("g", F.when(F.col("i") == 3, float("nan")).otherwise(F.col("s").cast("double")).alias("s"), "i"), "g", "s", "i", 2)
    assert all(r.score == r.score for r in d.collect())


# Template residue


RESIDUE = [
    ("{{ topic }}", 1), ("The slow recipe by %%city%%", 1), ("Untitled-8", 1), ("undefined | undefined", 1), ("[your site url]", 1), ("HTTP 404", 1), ("Access denied", 1), ("NaN of undefined", 1), ("Lorem ipsum dolor sit amet. Enim", 1), ("asdf blah qwer test", 1),
    ("Hier steht Text. Hier steht Text. Hier steht Text. Hier", 1), ("Exercitation voluptate", 1), ("  PAGE NOT FOUND", 1), ("Norwick is down for maintenance", 1), ("You need to enable JS to run this app.", 1), ("INSERT author name", 1), ("${TOPIC} | Marevek", 1), ("__CITY__", 1),
    ("Access denied to Lumuvek: a walker writes", 0), ("How Braholt renders {{ name }} in templates", 0), ("What ${var} means in the Zaniquay shell", 0), ("Lorem ipsum: where Tarris found its filler text", 0), ("Untitled: the painter Lumnix and 151 works", 0), ("Page not found: an essay on Cornix", 0),
    ("Should a blog need JavaScript? Wesford says no", 0), ("Insert coin: the arcades of Pelmobel", 0), ("[Review] Ashanix in 205 plates", 0), ("Error handling in 100 days", 0), ("75% of Norvek, 20% of the fun", 0), ("", 0), (None, 0), ("Notes on testing", 0), ("x" * 50_000, 0),
]
TEXTS = [
    ("Menu\nHello %%first_name%%, we sorted the canal.\nFooter", 1), ("A\nShell beginners in Brausted often confuse ${city} with %city%, so the course takes long.", 0), ("In the Holerin engine a template line such as `Hello {{ name }}` is filled in.", 0), ("Nav\nThis was written by {{ PAGE_TITLE }}.", 1),
    ("Search\nSeite nicht gefunden\nFehler 429", 1), ("Title\nThe team rewrote the message \"404 Not Found\" 93 times before readers stopped complaining.", 0), ("Real text.\nCeci est un faux texte. Il part. Ceci est un faux texte. Il part. Ceci est un faux texte. Il part.", 1), ("Untitled document\nNothing else.", 0), (None, 0), ("", 0),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, t) for i, (t, _) in enumerate(RESIDUE)] * 2, "id long, title string, template string")
    got = {r.record for r in template_residue.residue(df, "id", {"title": True}).collect()}
    assert got == {i for i, (_, y) in enumerate(RESIDUE) if y}
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id long, text string")
    found = template_residue.residue(df, "id", {"text": False})
    assert {r.record for r in found.collect()} == {i for i, (_, y) in enumerate(TEXTS) if y} and found.count() == sum(y for _, y in TEXTS)
    assert template_residue.residue(df.limit(0), "id", {"text": False}).collect() == []


def test_aligned_records_tell_mentions_from_slots(spark):
    same = [f"Why the sign {{{{ box }}}} hangs at gate {w}" for w in ("one", "two", "three")]
    said = [f"In {n} the sign {{{{ box }}}} hangs at gate {k}" for k, n in enumerate(("Oslo", "Rome", "Bern"))]
    slot = [f"In {n} the crate {{{{ {v} }}}} stays at gate {k}" for k, (n, v) in enumerate((("Oslo", "city"), ("Rome", "topic"), ("Bern", "author")))]
    df = spark.createDataFrame(list(enumerate(same + said + slot)), "id long, title string")
    assert {r.record for r in template_residue.residue(df, "id", {"title": True}).collect()} == {0, 1, 2, 6, 7, 8}


def test_residue_does_not_depend_on_the_number_of_lines(spark):
    """One unfilled template leaves the same field in all records."""
    for n in (1, 2, 3, 40):
        rows = [(i, f"Thanks, {{{{ first_name }}}}, for reading Amber {'ABCDEFGH'[i % 8]}eekly {i}") for i in range(n)]
        rows += [(100 + i, f"How {w}sted renders {{{{ name }}}} in templates") for i, w in enumerate(("Mar", "Tel", "Vor", "Kel")[:n])]
        df = spark.createDataFrame(rows, "id long, text string")
        assert {r.record for r in template_residue.residue(df, "id", {"text": False}).collect()} == set(range(n))


def test_slots_and_notations_of_any_kind(spark):
    """Fields in notations that stand in no list; a blank where other records have a word; one name in all records is wording."""
    marks = ["§§{}§§", "<<{}>>", "^^{}^^", "{{{{{}}}}}", "&&{}&&"]
    fields = [f"Recipes sent by {m.format(n)} to us" for m, n in zip(marks, ("cook", "town", "team", "city", "editor"))]
    plain = [f"Recipes sent by {n} to us" for n in ("Anna", "Bert", "Carl")]
    blank = ["Recipes sent by () to us"]
    spoken = [f"How {n} prints {{{{ name }}}} on paper" for n in ("Oslo", "Rome", "Bern", "Kiel")]
    rows = [(i, f"h{i % 4}", t) for i, t in enumerate(fields + blank + plain + spoken + ["**bold** words (see) [1] and a==b==c"])]
    df = spark.createDataFrame(rows, "id long, host string, title string").repartition(3)
    assert {r.record for r in template_residue.residue(df, "id", {"title": True}, "host").collect()} == set(range(6))


def test_titles_that_programs_give(spark):
    """Letter for letter at several hosts, closed at every position; not so the titles of an open template."""
    given = [(i, f"h{i}", "Klik om te beginnen") for i in range(4)]
    open_ = [(10 + 10 * k + i, f"h{i}", f"Notes on {w}") for k, w in enumerate("waiting sorting baking sailing mending reading".split()) for i in range(4)]
    one_host = [(90 + i, "h1", "Onze eigen pagina") for i in range(4)]
    df = spark.createDataFrame(given + open_ + one_host, "id long, host string, title string").repartition(3)
    assert {r.record for r in template_residue.residue(df, "id", {"title": True}, "host").collect()} == set(range(4))


def test_messages_and_copy_in_any_wording(spark):
    """Between furniture: a message in place of the article, and copy laid to fit. Furniture beside articles is neither, nor is a short article."""
    menu, foot = "Home\nTopics\nWe bake small files, and by reading on you take them all", "Printed in Oslo on paper that was paper before it was this paper"
    article = lambda i: f"The mill {i} stood by the river {i * 7} years, and {'abcdefghij'[i % 10]}{i} nobody minded much that it was {'klmnopqrst'[i // 10 % 10]}{i} crooked."
    long = lambda i: " ".join(article(i + 100 * k) for k in range(4))
    messages = [f"{menu}\nDe bakker is even weg\nKom over {i} minuten terug\n{foot}" for i in range(7)]
    copy = "Hic stat verbum. Post veniet melius."
    laid = [f"{menu}\n{long(i)}\n" + " ".join([copy] * (i % 3 + 1)) + f"\n{foot}" for i in range(20, 29)]
    articles = [f"{menu}\n{long(i)}\n{foot}" for i in range(40, 80)]
    short = [f"{menu}\nBread {i}" for i in range(90, 92)]
    df = spark.createDataFrame(list(enumerate(messages + laid + articles + short)), "id long, text string").repartition(3)
    found = template_residue.residue_by_rule(df, "id", {"text": False}).distinct().collect()
    assert {r.id for r in found} == set(range(16)) and {r.rule for r in found} == {"message", "unit"}
    brief = spark.createDataFrame([(i, f"{menu}\n{article(i)}\n{foot}") for i in range(30)], "id long, text string")
    assert template_residue.residue(brief, "id", {"text": False}).count() == 0
    titles = spark.createDataFrame([(100 + i, "Hic stat verbum alium quod " + " ".join("facile manet hodie".split()[:i]), None) for i in range(3)] + [(200 + i, None, f"{article(i)}\nHic stat verbum alium quod facile manet hodie semper apud nos.") for i in range(6)], "id long, title string, text string")
    assert {r.record for r in template_residue.residue(titles, "id", {"title": True, "text": False}).collect()} == {100, 101, 102, 200, 201, 202, 203, 204, 205}


def test_repeated_error_pages_in_any_wording(spark):
    """Error pages by their repeated template, also in long lines; one of its kind, one without evidence and a long text aren't."""
    gone = "Menu\nOur hamsters dropped the page {}, so it could not be found by anyone at {}.\nGo home"
    long = "We are unable to show this " + "very " * 50 + "fine page {} to you today."
    bread = "Bread {}\nKnead the dough and let it rest."
    article = "The mill {} was unavailable. " + "It stood by the river and nobody minded. " * 20
    texts = [t.format(i, "Oslo") for t in (gone, long) for i in range(4)] + ["Sorry, the stove is unavailable."] + [t.format(i) for t in (bread, article) for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "id long, text string").repartition(3)
    assert {r.record for r in template_residue.residue(df, "id", {"text": False}).collect()} == set(range(8))


def test_messages_do_not_depend_on_repeated_texts(spark):
    """Deliveries of the same texts under other numbers: a message is one however many copies there are."""
    article = lambda i: " ".join(f"The mill {'abcdefghij'[i % 10]}{k} stood by the river {'klmnopqrst'[i // 10]}{i} years, and {'uvwxyz'[k]}{i} nobody minded much that it was crooked." for k in range(4))
    texts = [f"Home\nDe bakker is even weg\nKom over {i} minuten terug" for i in range(7)] + [f"Home\n{article(i)}" for i in range(20)]
    for copies in (1, 3):
        df = spark.createDataFrame([(100 * c + i, t) for c in range(copies) for i, t in enumerate(texts)], "id long, text string").repartition(3)
        found = template_residue.residue_by_rule(df, "id", {"text": False}).filter("rule = 'message'").select("id").distinct()
        assert {r.id for r in found.collect()} == {100 * c + i for c in range(copies) for i in range(7)}


def test_copy_whose_lines_begin_with_other_names(spark):
    """Lines of one template that begin differently: titles cut off from any of them count."""
    names = "Anna Bert Carl Dora Emil Fred Gert Hans".split()
    line = "{} bakt morgen weer brood voor alle buren en vrienden van hier."
    rows = [(100 + i, None, line.format(n)) for i, n in enumerate(names)]
    rows += [(10 * k + i, " ".join(line.format(n).split()[: 4 + i]), None) for k, n in enumerate(names) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, title string, text string").repartition(3)
    found = template_residue.residue_by_rule(df, "id", {"title": True, "text": False}).filter("rule = 'cut'")
    assert {r.id for r in found.collect()} == {r[0] for r in rows}


def test_slots_of_long_titles(spark):
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 26]}" for i in range(60)]
    given = [(i, f"h{i}", " ".join(words)) for i in range(4)]
    df = spark.createDataFrame(given, "id long, host string, title string")
    assert {r.record for r in template_residue.residue(df, "id", {"title": True}, "host").collect()} == set(range(4))
    assert template_residue.with_gaps(words) == [template_residue.with_gap(words, i) for i in range(60)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_run_one_at_a_time(spark, monkeypatch):
    """What the rules found is read from tables, so no plan holds all rules; keys that go to the rows as a broadcast or meet them sorted give the same."""
    names = "Anna Bert Carl Dora Emil Fred Gert Hans".split()
    line = "{} bakt morgen weer brood voor alle buren en vrienden van hier."
    rows = [(100 + i, f"h{i}", None, f"{line.format(n)}\nMenu") for i, n in enumerate(names)]
    rows += [(10 * k + i, f"h{k}", " ".join(line.format(n).split()[: 4 + i]), None) for k, n in enumerate(names) for i in range(3)]
    rows += [(200 + i, f"h{i}", "Klik om te beginnen", f"Menu\nDe bakker is even weg\nKom over {i} minuten terug") for i in range(7)]
    rows += [(300 + i, f"h{i}", f"Recipes sent by {n} to us", None) for i, n in enumerate(("§§cook§§", "^^town^^", "Anna", "Bert"))]
    rows += [(400 + i, f"h{i}", None, "Our hamsters dropped the page, so it could not be found.\nGo home" if i < 3 else "Hic stat verbum. Post veniet melius. " * i) for i in range(6)]
    rows += [(500 + i, "h", None, f"Menu\nThe mill {i} stood by the river " + "and ground bread corn " * 15) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, host string, title string, text string").repartition(3)
    got = []
    for held in (template_residue.HELD_KEYS, 0):
        monkeypatch.setattr(template_residue, "HELD_KEYS", held)
        found = template_residue.residue_by_rule(df, "id", {"title": True, "text": False}, "host")
        assert not any(x in _plan(found) for x in ("Join", "Exchange", "Aggregate"))
        got.append({tuple(r) for r in found.collect()})
    assert got[0] == got[1] and {r for _, _, r in got[0]} >= {"cut", "title", "slot", "page", "unit", "message"}


def test_copies_of_keys_are_not_broadcast(spark, monkeypatch):
    """Keys go to the rows as they are; the copies that salts need are sorted, however small the table is that they are made from."""
    rows, keys = spark.range(1000).withColumn("key", F.col("id") % 7), spark.createDataFrame([(k, k) for k in range(5)], "key long, value long")
    want = {(i, i % 7) for i in range(1000) if i % 7 < 5}
    for held, there, not_there in ((5, "BroadcastHashJoin", "explode"), (4, "SortMergeJoin", "Broadcast")):
        monkeypatch.setattr(template_residue, "HELD_KEYS", held)
        met = template_residue._met(rows, keys, ["key"])
        assert there in _plan(met) and not_there not in _plan(met) and {(r.id, r.value) for r in met.collect()} == want
        assert template_residue._met(rows, keys, ["key"], "left_anti").count() == 1000 - len(want)
        assert template_residue._met(rows, keys, ["key"], "left_semi").count() == len(want)


# Main body


def _page(side_first: bool, n: int) -> tuple[str, str]:
    words = ["harbour", "engine", "orchard", "kettle", "river", "market", "ledger", "pantry"]
    head = f"How we mended the {words[n % 8]}"
    paras = [f"The {words[(n + k) % 8]} was quiet that year, and {n * 7 + k} people of the town had walked past it. Nobody saw why the {words[(n * 3 + k) % 8]} failed." for k in range(4)]
    side = [f"Notes on the {words[(n + k) % 7]} of {words[k]}" for k in range(3)]
    box = "<div class='rail'><ul><li>Most read</li>" + "".join(f"<li><a href='/x'>{s}</a></li>" for s in side) + "</ul></div>"
    html = f"<html><head><title>x</title></head><body><div id='menu'><ul><li>Home</li><li>About</li></ul></div>{box if side_first else ''}<div class='post'><h1>{head}</h1><div class='byline'>Posted by Ann Bell on {n}.5.2024</div>{''.join(f'<p>{p}</p>' for p in paras[:2])}<div class='promo'>Members read without adverts. Join for {n} crowns.</div>{''.join(f'<p>{p}</p>' for p in paras[2:])}</div>{'' if side_first else box}<div id='end'><p>All rights reserved.</p></div></body></html>"
    side_lines = ["Most read", *side]
    lines = ["Home", "About", *(side_lines if side_first else []), head, f"Posted by Ann Bell on {n}.5.2024", *paras[:2], f"Members read without adverts. Join for {n} crowns.", *paras[2:], *([] if side_first else side_lines), "All rights reserved."]
    return "\n".join(lines), html


def test_main_body(spark):
    rows, want = [], set()
    for n in range(24):
        text, html = _page(n % 2 == 0, n)
        lines = text.split("\n")
        head = next(i for i, x in enumerate(lines) if x.startswith("How we mended"))
        main = {head, head + 2, head + 3, head + 5, head + 6}
        want |= {(n, i + 1) for i in range(len(lines)) if i not in main}
        rows.append((n, "a.x" if n < 22 else None, lines[head] if n % 3 else None, text, html if n % 4 else None, "clash"))
    rows += [(90, "b.x", None, None, None, ""), (91, "b.x", None, "", "", ""), (92, "b.x", None, "\n\n", "<p>other</p>", "")]
    df = spark.createDataFrame(rows, "scan long, host string, name string, body string, html string, text string")
    assert {tuple(r) for r in main_body.furniture_lines(df, "scan", "host", "name", "body", "html").collect()} == want
    assert main_body.furniture_lines(df.limit(0), "scan", "host", "name", "body", "html").collect() == []


def test_wording_of_few_pages_counts_among_many(spark):
    """Furniture of a host of three pages settles its page without markup, whether there are few other pages or very many."""
    page = lambda n: (["Kettle post", f"On the {n} pans", "By hand of the smith", "The pan was mended in a day, and then it was used again.", "Ask the smith for a ladle", "PRINTED AT THE OLD MILL", "Printed at the old mill"])
    mark = lambda x: f"<body><div class='top'>{x[0]}</div><div class='post'><h1>{x[1]}</h1><div class='by'>{x[2]}</div><p>{x[3]}</p><div class='ask'>{x[4]}</div></div><div class='end'>{x[5]}</div><div class='foot'>{x[6]}</div></body>"
    rows = [(n, "small.x", page(n)[1], "\n".join(page(n)), mark(page(n)) if n else None) for n in range(3)]
    small = spark.createDataFrame(rows, "scan long, host string, name string, body string, html string")
    many = spark.range(100, 60_100).select(F.col("id").alias("scan"), F.lit("big.x").alias("host"), F.lit(None).cast("string").alias("name"), F.lit("One line that is all.").alias("body"), F.lit(None).cast("string").alias("html"))
    want = {(n, k) for n in range(3) for k in (1, 3, 5, 6, 7)}
    for df in (small, small.unionByName(many)):
        assert {tuple(r) for r in main_body.furniture_lines(df, "scan", "host", "name", "body", "html").filter("scan < 100").collect()} == want


def test_constant_slots_within_the_main_body(spark):
    """A host that names a byline has a prompt in a plain paragraph on every page; standing intros, subheadings and copies of one article are content."""
    rows, want = [], set()
    for n in range(8):
        own = [f"{w} number {'abcdefgh'[n]} was carried over the hill at dawn, and nobody could say afterwards why it had to go that way." for w in ("Kettle", "Ladle", "Anvil")]
        lines = [f"About {'abcdefgh'[n]}", "By Ann Bell", "Every week we look at one thing.", own[0], "Background", own[1], "Tell a friend about these letters if you liked this one.", own[2]]
        tags = ["h1", "div class='by'", "p", "p", "h2", "p", "p", "p"]
        rows.append((n, "a.x", lines[0], "\n".join(lines), "<body><div class='post'>" + "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in zip(tags, lines)) + "</div></body>"))
        want |= {(n, 2), (n, 7)}
    copy = ["One text", "By Ann Bell", "The mill stood still that day.", "Then it went on."]
    for n in range(20, 24):
        rows.append((n, "b.x", copy[0], "\n".join(copy), "<body><div class='post'>" + "".join(f"<{t}>{x}</{t.split()[0]}>" for t, x in zip(["h1", "div class='by'", "p", "p"], copy)) + "</div></body>"))
        want.add((n, 2))
    df = spark.createDataFrame(rows, "scan long, host string, name string, body string, html string").repartition(3)
    assert {tuple(r) for r in main_body.furniture_lines(df, "scan", "host", "name", "body", "html").collect()} == want


def test_wrappers_of_long_names_are_not_held_whole(spark, monkeypatch):
    """Few groups with names of megabytes go to the pages in a join; the driver never has them together."""
    rows = [(n, f"{n % 2}.x", t.split("\n")[4 if n % 2 else 8], t, h.replace("class='post'", f"class='post {'ab'[n % 2] * 3_000_000}'")) for n in range(4) for t, h in [_page(n % 2 == 0, n)]]
    df = spark.createDataFrame(rows, "scan long, host string, name string, body string, html string")
    lines = lambda df: {tuple(r) for r in main_body.furniture_lines(df, "scan", "host", "name", "body", "html").collect()}
    want = lines(df.withColumn("html", F.regexp_replace("html", " [ab]{9,}", "")))
    monkeypatch.setattr(main_body.F, "broadcast", lambda _: pytest.fail("wrappers are broadcast"))
    assert lines(df) == want


def test_page_blocks():
    blocks = main_body.page_blocks(_page(False, 1)[1])
    assert [b[2] for b in blocks][2:6] == ["h1", "div.byline", "p", "p"] and len({b[0] for b in blocks}) == 4
    assert main_body.page_blocks("") == [] and main_body.page_blocks("<b>x")[0][3] == "x" and main_body.page_blocks("a < b")[0][3] == "a < b"


# Site lines


def test_repeated_lines(spark):
    rows = [(i, "a", f"Share this\n\nbody {chr(97 + i)}x\n  share   THIS \nPage {i}\n" + "long " * 3000) for i in range(5)] + [(i, "b", "Share this\nbody") for i in (10, 11)] + [(20, None, "x"), (21, "a", None), (22, "a", "")] + [(30 + i, "c", f"rare {'x' if i < 4 else 'y' * i}") for i in range(25)]
    df = spark.createDataFrame(rows, "doc long, site string, text string").withColumn("n_docs", F.lit("clash")).repartition(6)

    def brute():
        sites, places = Counter(), defaultdict(lambda: defaultdict(list))
        for doc, site, text in rows:
            if site is None or text is None:
                continue
            sites[site] += 1
            for no, line in enumerate(text.split("\n"), 1):
                if t := site_lines.line_template(line):
                    places[site, t][doc].append(no)
        return {(d, n) for (s, _), p in places.items() if len(p) >= 4 and len(p) >= 0.2 * sites[s] for d, ns in p.items() for n in ns}

    lines = site_lines.repeated_lines(df, "doc", "site", "text")
    got = [tuple(r) for r in lines.collect()]
    assert set(got) == brute() and len(got) == len(set(got)) and (0, 5) in brute()
    kept = {r.doc: r.text for r in site_lines.without_lines(df, "doc", "text", lines).collect()}
    assert kept[0] == "\nbody ax" and kept[10] == "Share this\nbody" and kept[21] is None and kept[22] == "" and len(kept) == len(rows)
    assert site_lines.repeated_lines(df.limit(0), "doc", "site", "text").collect() == []


# Percentiles


def _exact(values, q):
    return sorted(values)[percentiles.rank_of(q, len(values)) - 1]


@pytest.mark.parametrize("local", [10, 4_096])
def test_percentiles(spark, local):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.exponential(size=900)] + [("ties", float(v)) for v in rng.integers(0, 3, 300)] + [(f"g{i % 30}", float(i)) for i in range(90)] + [("inf", float("inf")), ("inf", 1.0), (None, 1.0), ("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("vals", F.lit("clash")).repartition(5)
    by = defaultdict(list)
    for k, v in rows:
        if k is not None and v is not None and v == v:
            by[k].append(v)
    qs = [0, 0.1, 0.5, 0.99, 1]
    got = {r.group: (r.n, r["values"]) for r in percentiles.percentiles(df, "k", "v", qs, local).collect()}
    assert got == {k: (len(v), [_exact(v, q) for q in qs]) for k, v in by.items()}
    assert percentiles.percentiles(df.limit(0), "k", "v", qs, local).collect() == []


def test_infinite_values_in_large_groups(spark):
    by = {"both": [float("-inf")] * 30 + [float(i) for i in range(200)] + [float("inf")] * 40, "low": [float("-inf")] * 90 + [1.0], "high": [float("inf")] * 90 + [1.0], "ends": [float("-inf")] * 50 + [float("inf")] * 50}
    df = spark.createDataFrame([(k, v) for k, vs in by.items() for v in vs], "k string, v double").repartition(5)
    qs = [0, 0.1, 0.2, 0.5, 0.9, 1]
    for local in (10, 4_096):
        got = {r.group: (r.n, r["values"]) for r in percentiles.percentiles(df, "k", "v", qs, local).collect()}
        assert got == {k: (len(v), [_exact(v, q) for q in qs]) for k, v in by.items()}


def test_summaries_merge_within_their_bound(spark):
    rng = np.random.default_rng(4)
    loads = [[("k", float(v)) for v in rng.normal(m, 1, n)] for m, n in ((0, 700), (2, 1300), (5, 40))]
    parts = [percentiles.summary(spark.createDataFrame(x, "k string, v double"), "k", "v", 50, 100) for x in loads]
    merged = percentiles.merge_summaries(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    merged = percentiles.merge_summaries(merged, 50)
    assert merged.select(F.size("points")).first()[0] <= 51
    qs = [0.01, 0.25, 0.5, 0.9, 1.0]
    r = percentiles.read_summary(merged, qs).first()
    every = np.sort([v for x in loads for _, v in x])
    assert r.n == len(every)
    for q, v in zip(qs, r["values"]):
        assert abs(np.searchsorted(every, v, "right") - percentiles.rank_of(q, len(every))) <= 2 * len(every) / 50 + 3


# Packing


def test_plan_is_whole_and_fits():
    rng = np.random.default_rng(5)
    for capacity, n in ((10, 50), (64, 400), (256, 3000)):
        counts = np.bincount(rng.integers(1, capacity + 1, n), minlength=capacity + 1)
        plan, bins = packing.plan_containers(counts, capacity)
        used, fill = np.zeros(capacity + 1, int), defaultdict(int)
        for length, first, items, each, start in plan:
            assert first == used[length]
            used[length] += items
            for b in range(items // each):
                fill[start + b] += length * each
        total = int((counts * np.arange(capacity + 1)).sum())
        assert (used == counts).all() and len(fill) == bins and max(fill.values()) <= capacity and bins <= -(-total // capacity) * 1.35 + 1
    assert packing.plan_containers(np.zeros(5, int), 4) == ([], 0)


def test_complements():
    index = packing.ComplementIndex(np.array([0, 0, 2, 0, 1, 1, 0, 0, 0]))
    assert index.single(5, {}) == (5,) and index.single(5, {5: 1}) is None and sorted(index.pair(4, {})) == [2, 2] and index.pair(4, {2: 1}) is None
    assert sorted(index.triple(8, {})) == [2, 2, 4] and index.triple(12, {}) is None and index.longest(8, {5: 1}) == 4


def test_pack_texts(spark):
    texts = ["word " * n for n in (3, 10, 40, 100, 7, 7, 7)] + ["", None, "naïve café 漢字 😀", "word " * 3, "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string").withColumn("bin", F.lit("clash")).repartition(3)
    rows = packing.pack_texts(df, "doc_id", "body", {"small": 16, "same": 16, "large": 64}, VOCABULARY).collect()
    with open(VOCABULARY, "rb") as f:
        enc = packing._encoding(f.read())
    for kind, cap in (("small", 16), ("same", 16), ("large", 64)):
        fill, pieces = Counter(), defaultdict(list)
        for r in rows:
            if r.container == kind:
                pieces[r.doc].append((r.piece, r.n_tokens))
                fill[r.bin] += r.n_tokens
        assert all(n <= cap for b, n in fill.items() if b)
        for i, t in enumerate(texts):
            n = len(enc.encode_ordinary(t or ""))
            assert sum(x for _, x in pieces[i]) == n and [p for p, _ in sorted(pieces[i])] == list(range(len(pieces[i]))) and (n > cap or len(pieces[i]) == 1)
    assert packing.pack_texts(df.limit(0), "doc_id", "body", {"s": 16}, VOCABULARY).collect() == [] and packing.pack_texts(df, "doc_id", "body", {}, VOCABULARY).collect() == []
    with pytest.raises(ValueError):
        packing.pack_texts(df, "doc_id", "body", {"s": 0}, VOCABULARY)


# Leaks


def test_leaks(spark):
    rng = random.Random(6)
    vocab = [a + b + c for a in "bdfgklm" for b in ("ar", "el", "on", "is") for c in ("ta", "ne", "ru", "so")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(40)] + [(90, ""), (91, None), (0, "dup")]
    items = items[:-1]
    w = [t.split() for _, t in items[:40]]
    fill = lambda n: " ".join(rng.choice(["the", "river", "went", "by", "and", "so", "we"]) for _ in range(n))
    changed = w[3][:16]
    changed[4], changed[11] = "zzz", "yyy"
    three = w[3][:16]
    three[4], three[8], three[11] = "zzz", "xxx", "yyy"
    docs = [
        (1, f"{fill(50)} {items[0][1]} {fill(20)}", {0}), (2, fill(30) + " " + " ".join(w[1][5:21]), {1}), (3, fill(9) + " " + " ".join(w[2][5:18]) + " " + fill(9), set()), (4, " ".join(changed), {3}), (5, " ".join(three), set()),
        (6, "<p>" + "</p>\n<b>".join(x.upper() for x in w[6]) + "!</b> &amp; " + fill(5), {6}), (7, " ".join(w[7][:8] + ["new"] + w[7][8:17]), {7}), (8, None, set()), (9, "", set()), (10, fill(20000) + items[8][1] + " " + items[9][1], {8, 9}), (11, fill(400), set()), (1, items[0][1], {0}),
    ]
    df = spark.createDataFrame([d[:2] for d in docs], "id long, body string").withColumn("words", F.lit("clash")).repartition(3)
    it = spark.createDataFrame(items, "item long, q string")
    got = [tuple(r) for r in eval_leaks.leaked_items(df, "id", "body", it, "item", "q").collect()]
    assert set(got) == {(d, i) for d, _, s in docs for i in s} and len(got) == len(set(got))
    assert eval_leaks.leaked_items(df.limit(0), "id", "body", it, "item", "q").collect() == [] and eval_leaks.leaked_items(df, "id", "body", it.limit(0), "item", "q").collect() == []


def test_alignment_is_not_drawn_off_by_repeats():
    item = [f"w{i % 11}" if i % 5 == 0 else f"u{i}" for i in range(30)]
    for a in range(14):
        part = item[a : a + 16]
        part[5] = part[9] = "zz"
        assert eval_leaks.aligned(item, ["w0", "w5", *part, "w10", "w0"])
    assert not eval_leaks.aligned(item, item[3:16]) and not eval_leaks.aligned([], ["a"]) and eval_leaks.aligned(["a", "b"], ["x", "a", "b"])


def test_retrieval_recall(spark):
    """Candidates of the latent space against all pairs that alignment finds, on passages with up to two of sixteen words changed."""
    rng = random.Random(7)
    vocab = [a + b + c for a in "bdfgklmnprst" for b in ("ar", "el", "on", "is", "um") for c in ("ta", "ne", "ru", "so", "vi")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(28))) for i in range(150)]
    docs = []
    for i in range(300):
        words = items[i % 150][1].split()
        a = rng.randrange(12)
        own = words[a : a + 16]
        for k in rng.sample(range(1, 15), 2):
            own[k] = rng.choice(vocab) + "q"
        docs.append((i, "so we went " + " ".join(own) + " by the river and so on"))
    got = {tuple(r) for r in eval_leaks.leaked_items(spark.createDataFrame(docs, "id long, t string"), "id", "t", spark.createDataFrame(items, "item long, q string"), "item", "q").collect()}
    want = {(d, i) for d, t in docs for i, q in items if eval_leaks.aligned(q.split(), eval_leaks.words_of(t))}
    assert len(want) >= 300 and len(got & want) >= 0.9 * len(want) and got <= want


# Shared spans


def _pairs(docs, least):
    seen, out = defaultdict(set), set()
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            seen[t[i : i + least]].add(d)
    for s in seen.values():
        out |= set(combinations(sorted(s), 2))
    return out


def _covered(docs, least):
    """Characters of every document that stand in a window which another document has."""
    texts = {d: t for d, t in docs if t}
    has = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            has[t[i : i + least]].add(d)
    return {d: len({j for i in range(len(t) - least + 1) if len(has[t[i : i + least]]) > 1 for j in range(i, i + least)}) for d, t in texts.items()}


def test_coverage_of_a_span_in_many_documents(spark):
    """No pairs: one span in all documents, at places and with neighbours of its own; some have it twice, or parts of it."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdef gh") for _ in range(n))
    span = text(150)
    docs = [(i, text(rng.randrange(90)) + span[rng.randrange(3) * 20 : 150 - rng.randrange(3) * 20] + text(rng.randrange(90)) + (span if i % 9 == 0 else "")) for i in range(60)] + [(60, text(40) + "tick tock " * 30), (61, "ick tock t" * 12), (62, text(100) * 2)]
    df = spark.createDataFrame(docs, "id long, body string").repartition(4)
    spans = shared_spans.SharedSpans(df, "id", "body", 64)
    assert {r.doc: r.shared_chars for r in spans.coverage().collect()} == _covered(docs, 64)


def test_shared_spans(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é漢") for _ in range(n))
    s1, s2, s3 = text(64), text(63), text(200)
    copy = text(150)
    docs = [
        (1, text(300) + s1 + text(100)), (2, s1), (3, text(40) + s2 + text(40)), (4, s2 + text(90)), (5, text(10) + s3 + text(5) + s1), (6, s3[20:150]), (7, copy), (8, copy), (9, copy), (10, text(33) + copy[30:120]), (11, None), (12, ""),
        (13, "ab" * 400), (14, "xyz" + "ab" * 60 + text(80)), (15, "ab" * 20), (16, "short"), (17, "short"), (18, text(20_000) + s1[:64]), (19, "\U0001f600" * 100), (20, "a" + "\U0001f600" * 80),
    ]
    df = spark.createDataFrame(docs + [docs[0]], "id long, body string").withColumn("doc", F.lit("clash")).repartition(4)
    spans = shared_spans.SharedSpans(df, "id", "body", 64)
    got = [tuple(r) for r in spans.pairs().collect()]
    assert set(got) == _pairs(docs, 64) and len(got) == len(set(got))
    for r in spans.spans.collect():
        by = dict(docs)
        a, b = by[r.doc_a], by[r.doc_b]
        assert a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length] and r.length >= 64
        assert r.start_a == 0 or r.start_b == 0 or a[r.start_a - 1] != b[r.start_b - 1]
    cover = {r.doc: r for r in spans.coverage().collect()}
    assert set(cover) == {d for d, t in docs if t} and cover[7].n_copies == 3 and cover[7].shared_chars == 150 and cover[2].shared_chars == 64 and cover[6].shared_chars == 130 and cover[16].shared_chars == 0 and cover[16].n_copies == 2
    assert cover[5].shared_chars >= 194 and cover[3].shared_chars == 0
    assert {d: r.shared_chars for d, r in cover.items()} == _covered(docs, 64)
    empty = shared_spans.SharedSpans(df.limit(0), "id", "body", 64)
    assert empty.pairs().collect() == [] and empty.coverage().collect() == []


def test_anchor_guarantee():
    rng = random.Random(9)
    hasher = shared_spans.AnchorHash(16)
    span = "".join(rng.choice("abc") for _ in range(48))
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(90))) + span
        b = span + "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        (va, pa), (vb, pb) = shared_spans.anchors([a, b], hasher, 33)
        at = {(v, p - len(a) + 48) for v, p in zip(va.tolist(), pa.tolist())} & {(v, p) for v, p in zip(vb.tolist(), pb.tolist())}
        assert at, (a, b)


@pytest.mark.parametrize("least", [64, 65])
def test_spans_of_periodic_stretches(spark, least):
    """Stretches of all phases, a little longer than the least span, against long ones; pairs, spans and covered characters as brute force has them."""
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = []
    for period in (1, 2, 7, 20, 31, 32, 33):
        root = text(period) * 40
        for _ in range(7):
            a = rng.randrange(period)
            docs.append(text(rng.randrange(40)) + root[a : a + least + rng.randrange(-3, 2 * period)] + text(rng.randrange(40)))
        docs += [text(9) + (text(period) * 40)[:300] + text(9), text(5) + root[:400][-300:] + text(5), root[:150] + "|" + root[3:200]]
    docs = list(enumerate(docs))
    found = shared_spans.SharedSpans(spark.createDataFrame(docs, "id long, body string").repartition(3), "id", "body", least)
    assert {tuple(r) for r in found.pairs().collect()} == _pairs(docs, least)
    seen = defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - least + 1):
            seen[t[i : i + least]].add(d)
    for r in found.coverage().collect():
        t, held = docs[r.doc][1], set()
        for i in range(len(t) - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                held |= set(range(i, i + least))
        assert r.shared_chars == len(held), (r, t)
    want = set()
    for (da, a), (db, b) in combinations(docs, 2):
        if any(da in s and db in s for s in seen.values() if len(s) > 1):
            for i in range(len(a) - least + 1):
                j = -1
                while (j := b.find(a[i : i + least], j + 1)) >= 0:
                    if i == 0 or j == 0 or a[i - 1] != b[j - 1]:
                        want.add((da, db, i, j, shared_spans.common_span(a, b, i, j)[1]))
    assert {tuple(r) for r in found.spans.collect()} == want
