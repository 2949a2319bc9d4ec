"""Counts for expressions that are runs of bounded length between punctuation marks, as the engine for expressions would give them.

Such an expression can begin at almost every letter, and the engine tries each; here the marks are found first, and what stands around
them is settled by distances. An expression counts here if its text has one of the shapes below; every other is left to the engine.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable

#: The characters that expressions of the library take as white space, and as one of A to Z in any case.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = re.compile("[A-Za-z\u0131\u017f]")
_RUN = r"\[\^((?:[^\]\\]|\\.)+)\]\{(\d+),(\d+)\}"
_SENTENCES = re.compile(rf"^\(\?:\[A-Z\]{_RUN}\[([^\]\\]+)\]\[ \\t\]\)\{{(\d+),\}}$")


def _plain(excluded: str) -> str:
    return excluded.replace(r"\n", "\n")


def _any(chars: str) -> re.Pattern:
    return re.compile("[" + re.escape(chars) + "]")


def short_sentences(excluded: str, least: int, most: int, ends: str, times: int) -> Callable[[str], int]:
    """A letter, least to most other characters, an end and a blank, times or more in a row."""
    stop, closing = _any(excluded), frozenset(ends)

    def count(t: str) -> int:
        at = [m.start() for m in stop.finditer(t)]
        n, pos, k, size = 0, 0, 0, len(t)

        def ends_at(i: int) -> bool:
            return i < len(at) and t[at[i]] in closing and at[i] + 1 < size and t[at[i] + 1] in " \t"

        while k < len(at):
            e = at[k]
            if not ends_at(k):
                k += 1
                continue
            lo = max(pos, at[k - 1] + 1 if k else 0, e - most - 1)
            m = _LETTER.search(t, lo, e - least) if e - least > lo else None
            if not m:
                k += 1
                continue
            units, last = 1, k
            while True:
                s = at[last] + 2
                if not (s < size and _LETTER.match(t, s)):
                    break
                j = last + 1
                while j < len(at) and at[j] < s + 1:
                    j += 1
                if not ends_at(j) or not least <= at[j] - s - 1 <= most:
                    break
                units, last = units + 1, j
            if units >= times:
                n += 1
                pos = at[last] + 2
                k = last + 1
            else:
                k += 1
        return n

    return count


def _next(at: list[int], i: int) -> int:
    """The first mark from i on, or -1."""
    k = bisect_left(at, i)
    return at[k] if k < len(at) else -1


def _behind_blanks(t: str, i: int) -> tuple[int, int]:
    """(end of the white space at i, place behind its last line end, or i)."""
    j = i
    while j < len(t) and t[j] in _SPACE:
        j += 1
    return j, max(i, t.rfind("\n", i, j) + 1)


def _fits(end: int, first: int, last: int, least: int, most: int) -> bool:
    """Whether a run of least to most characters that ends here may begin somewhere from first to last."""
    return max(end - last, least) <= min(end - first, most)


def parts_in_row(excluded: str, least: int, most: int, mark: str, ends: str) -> Callable[[str], int]:
    """Three runs, the first after a letter, with a mark behind the first two and an end behind the third."""
    stop, closing = _any(excluded), frozenset(ends)

    def count(t: str) -> int:
        if t.count(mark) < 2:
            return 0
        at = [m.start() for m in stop.finditer(t)]
        n = pos = 0
        for k, c in enumerate(at):
            if t[c] != mark or c < pos:
                continue
            lo = max(pos, at[k - 1] + 1 if k else 0, c - most - 1)
            if c - least <= lo or not _LETTER.search(t, lo, c - least):
                continue
            j, first = _behind_blanks(t, c + 1)
            d = _next(at, j)
            if d < 0 or t[d] != mark or not _fits(d, first, j, least, most):
                continue
            j, first = _behind_blanks(t, d + 1)
            e = _next(at, j)
            if e >= 0 and t[e] in closing and _fits(e, first, j, least, most):
                n, pos = n + 1, e + 1
        return n

    return count


_KINDS: dict[str, bool] = {}


def _is_word(c: str) -> bool:
    if c not in _KINDS:
        kind = unicodedata.category(c)
        _KINDS[c] = kind[0] in "LM" or kind in ("Nd", "Pc", "Nl") or c in "\u200c\u200d"
    return _KINDS[c]


def enumerations(least: int, most: int, joint: str, ends: str) -> Callable[[str], int]:
    """Two runs between commas, the joint, and a run before an end; the first begins at the edge of a word."""
    stop, last_stop, closing = _any(",\n"), _any(",.\n"), frozenset(ends)
    joined = re.compile(rf",[{_SPACE}]+{joint}[{_SPACE}]", re.I | re.A)

    def edge(t: str, lo: int, hi: int) -> bool:
        return any(_is_word(t[i]) != (i > 0 and _is_word(t[i - 1])) for i in range(lo, hi))

    def count(t: str) -> int:
        n = pos = 0
        at = None
        for m in joined.finditer(t):
            if at is None:
                at, at3 = [x.start() for x in stop.finditer(t)], [x.start() for x in last_stop.finditer(t)]
            d = m.start()
            k = bisect_left(at, d) - 1
            while k >= 0 and at[k] > d - most - 200 and t[at[k]] == "\n":  # a line end may stand in the blanks behind the comma
                k -= 1
            if k < 0 or t[at[k]] != "," or at[k] < pos:
                continue
            c = at[k]
            j, first = _behind_blanks(t, c + 1)
            if j < c + 2 or _next(at, j) != d or not _fits(d, max(first, c + 2), j, least, most):
                continue
            j, first = _behind_blanks(t, m.end() - 1)
            e = _next(at3, j)
            if e < 0 or t[e] not in closing or not _fits(e, max(first, m.end()), j, least, most):
                continue
            lo = max(pos, at[k - 1] + 1 if k else 0, c - most)
            if edge(t, lo, c - least + 1):
                n, pos = n + 1, e + 1
        return n

    return count


def run_counter(expression: str) -> Callable[[str], int] | None:
    """A function that counts an expression's matches in a text; None for expressions of other shapes."""
    if (m := _SENTENCES.match(expression)) and set(m[4]) | {"\n"} == set(_plain(m[1])):
        return short_sentences(_plain(m[1]), int(m[2]), int(m[3]), m[4], int(m[5]))
    runs = list(re.finditer(_RUN, expression))
    if len(runs) == 3 and len({(r[2], r[3]) for r in runs}) == 1:
        least, most, ends = int(runs[0][2]), int(runs[0][3]), re.search(r"\[([^\]\\]+)\]$", expression)
        bare = re.sub(_RUN, "#", expression)
        excluded = [_plain(r[1]) for r in runs]
        if ends and (m := re.fullmatch(r"\[A-Z\]#([;:])\\s\*#\1\\s\*#\[[^\]]+\]", bare)) and len(set(excluded)) == 1 and set(ends[1]) | {m[1], "\n"} == set(excluded[0]):
            return parts_in_row(excluded[0], least, most, m[1], ends[1])
        if ends and (m := re.fullmatch(r"\\b#,\\s\+#,\\s\+([a-z]+)\\s\+#\[[^\]]+\]", bare)) and excluded == [",\n", ",\n", ",.\n"] and set(ends[1]) == set(".,"):
            return enumerations(least, most, m[1], ends[1])
    return None
