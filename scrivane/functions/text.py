"""Column expressions on texts. All run in the JVM; none raises under ANSI rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space and as line ends for words and lines.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Expressions for bullets, headings, pictographs, sentence ends and the characters stripped from tokens.
BULLET = r"^\s*(?:[-*•·◦▪▸►✓✗]|\d+[.)]\s)\s*\S"
HEADING = r"^#{1,6}\s+\S"
PICTOGRAPHS = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
SENTENCE_END = r'(?<=[.!?])\s+(?=[A-Z"])'
TOKEN_EDGE = ".,!?;:\"'()[]"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WS + "+"))).cast("bigint")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def count_substring(text: Column, term: Column | str) -> Column:
    """Occurrences that don't overlap. The test for any keeps texts without the term from being copied."""
    t = lit(term)
    return F.when(F.contains(text, t), F.try_divide(F.length(text) - F.length(F.replace(text, t, F.lit(""))), F.length(t)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def count_terms(low: Column, terms: list[str], exact: bool = False) -> Column:
    """Occurrences of all terms in lower-case text; a term that is listed twice counts twice. exact: between blanks, or at the start before one."""
    zero = F.lit(0).cast("bigint")
    if not terms:
        return zero
    array = F.array(*(F.lit(t.lower()) for t in terms))
    if exact:
        return F.aggregate(array, zero, lambda n, t: n + count_substring(low, F.concat(F.lit(" "), t, F.lit(" "))) + F.startswith(low, F.concat(t, F.lit(" "))).cast("bigint"))
    return F.aggregate(array, zero, lambda n, t: n + count_substring(low, t))


def term_automaton(terms: tuple[str, ...]):
    """All terms in one automaton; None where the library for it is missing."""
    try:
        import ahocorasick
    except ImportError:
        return None
    a = ahocorasick.Automaton()
    for t in set(terms):
        a.add_word(t, (t, len(t)))
    a.make_automaton()
    return a


_AUTOMATA: dict = {}


def term_groups(groups: list[tuple[list[str], bool]]):
    """A function of a lower-case text: how often the terms of each group (terms, exact) stand in it, as count_terms gives it, by one pass for all of them."""
    key = tuple((tuple(terms), exact) for terms, exact in groups)
    if key not in _AUTOMATA:
        weights: dict[str, list[int]] = {}
        starts: list[tuple[str, int]] = []
        for g, (terms, exact) in enumerate(groups):
            for t in (x.lower() for x in terms):
                weights.setdefault(f" {t} " if exact else t, []).append(g)
                if exact:
                    starts.append((f"{t} ", g))
        _AUTOMATA.clear()
        _AUTOMATA[key] = term_automaton(tuple(weights)) if weights else None, weights, starts
    automaton, weights, starts = _AUTOMATA[key]

    def count(low: str) -> list[int]:
        n = [0] * len(groups)
        until: dict[str, int] = {}
        for end, (term, size) in automaton.iter(low) if automaton else ():
            if end - size >= until.get(term, -1):  # occurrences of one term that overlap count once
                until[term] = end
                for g in weights[term]:
                    n[g] += 1
        for term, g in starts:
            if low.startswith(term):
                n[g] += 1
        return n

    return count


def term_counter(groups: list[tuple[list[str], bool]]):
    """A column function: lower-case text -> array with the count of each group of (terms, exact), as count_terms gives it.

    One pass over a text finds all terms of all groups, where count_terms makes one pass for every term. Batches go to Python as Arrow
    columns. Without the automaton library the counts are those column expressions.
    """
    if term_automaton(("a",)) is None:
        return lambda low: F.array(*(count_terms(low, t, e) for t, e in groups))

    @F.pandas_udf("array<bigint>")
    def count(low: pd.Series) -> pd.Series:
        of = term_groups(groups)
        return pd.Series([of(t or "") for t in low])

    return count


def guard_runs(pattern: str) -> str:
    """Makes an unbounded repeated group at a pattern's end possessive: the same matches, without a stack frame for each round."""
    return re.sub(r"\)(\+|\*|\{\d+,\})$", r")\1+", pattern)


_BOUNDED = re.compile(r"\[\^((?:[^\]\\]|\\.)+)\](\{\d+,\d+\})(?=(\[[^\]\\^-]+\]|[,;:.!?]))")


def keep_runs(pattern: str) -> str:
    """Makes a bounded run of other characters than c possessive where some c must follow: giving back characters could never let it follow."""

    def change(m: re.Match) -> str:
        excluded = set(m[1].replace("\\n", "\n"))
        return m[0] + "+" if m[3] != "." and set(m[3].strip("[]")) <= excluded else m[0]

    return _BOUNDED.sub(change, pattern)


def java_regex(pattern: str, flags: str) -> str:
    """A pattern of the library in Java's dialect. Up to three characters are taken literally."""
    if len(pattern) <= 3:
        return f"(?{flags})" + re.sub(r"([^\w\s])", r"\\\1", pattern)
    return f"(?{flags})" + guard_runs(keep_runs(pattern))


def _top_level(pattern: str, wanted: str) -> int:
    """Where an item of ``wanted`` (a character, or a class of them) stands outside of classes and groups; -1 if nowhere, or if there are alternatives outside groups."""
    depth, i, found = 0, 0, -1
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            end = i + 1
            while pattern[end] != "]" or end == i + 1:
                end += 2 if pattern[end] == "\\" else 1
            inside = pattern[i + 1 : end]
            if not depth and found < 0 and inside and set(inside) <= set(wanted) and pattern[end + 1 : end + 2] not in ("?", "*", "{"):
                found = i
            i = end + 1
            continue
        if c == "{":
            i = pattern.find("}", i) + 1
            continue
        depth += (c == "(") - (c == ")")
        if not depth and c == "|":
            return -1
        if not depth and found < 0 and c in wanted and c not in "?.!" and pattern[i + 1 : i + 2] not in ("?", "*", "{"):
            found = i
        i += 1
    return found


_REPEATED = re.compile(r"^\(\?:((?:[^()|])+)\)\{(\d+),\}$")


def needed_part(pattern: str) -> str | None:
    """What follows a punctuation mark that a pattern must have, from that mark on: no text without a match of it has one of the pattern.

    It can begin only at the mark, where the whole pattern is tried at almost every letter. A repeated group counts as written out.
    """
    if m := _REPEATED.match(pattern):
        at = _top_level(m[1], ".!?;,")
        return m[1][at:] + m[1] * (int(m[2]) - 1) if at > 0 else None
    if "(?<" in pattern or pattern.startswith("(?"):
        return None
    at = _top_level(pattern, ";,")
    return pattern[at:] if at > 0 and len(pattern) > 12 else None


def count_matches(text: Column, patterns: list[str], flags: str = "iuUd") -> Column:
    total = F.lit(0).cast("bigint")
    for p in patterns:
        n = F.regexp_count(text, F.lit(java_regex(p, flags))).cast("bigint")
        part = needed_part(p)
        total = total + (n if part is None else F.when(text.rlike(f"(?{flags})" + keep_runs(part)), n).otherwise(F.lit(0).cast("bigint")))
    return total


def sentences(text: Column) -> Column:
    """Pieces of two words at least, cut behind . ! ? before a capital or quotation mark."""
    return F.filter(F.transform(F.split(strip(text), "(?U)" + SENTENCE_END), strip), lambda s: word_count(s) >= 2)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\n\s*\n"), lambda p: strip(p) != "")


def lengths(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: word_count(p).cast("double"))


def mean(xs: Column) -> Column:
    """0 for an empty array."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    return F.aggregate(xs, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s")), lambda a: a["s"] / F.greatest(a["n"], F.lit(1.0)))


def variation(xs: Column) -> Column:
    """Sample standard deviation over the mean, of whole numbers; 0 below two values. One pass, as xs must not be written out in a lambda over itself."""
    start = F.struct(*(F.lit(0.0).alias(c) for c in "nsq"))
    spread = lambda a: F.sqrt(F.greatest(F.lit(0.0), (a["q"] - a["s"] * a["s"] / a["n"]) / (a["n"] - 1)))
    return F.aggregate(xs, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.when((a["n"] >= 2) & (a["s"] > 0), F.try_divide(spread(a), a["s"] / a["n"])).otherwise(F.lit(0.0)))


def window_type_ratio(tokens: Column, window: int = 50, step: int = 25) -> Column:
    """Mean share of different tokens in windows of fixed length; NULL if there is none. tokens must be a column, as it is read for every window."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(step))
    return F.when(n >= window, mean(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tokens, i + 1, window))).cast("double") / window)))


def authority(url: Column) -> Column:
    """What stands between :// and the path, as written; '' if there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without www.; NULL if there is none."""
    h = F.regexp_replace(F.lower(F.trim(authority(url))), r"^www\.", "")
    return F.when(h != "", h)


def base_url(site: Column) -> Column:
    """Scheme and authority; https:// if no scheme is given."""
    full = F.when(site.rlike("^https?://"), site).otherwise(F.concat(F.lit("https://"), site))
    return F.regexp_extract(full, r"^(https?://[^/?#]*)", 1)


def clean_domain(text: Column) -> Column:
    """A submitted domain without scheme and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^https?://", ""), "/+$", "")


def shorten(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def score_bar(score: Column, width: int = 10) -> Column:
    filled = F.bround(score * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))
