"""All of a text's measures that need its words, in one pass in Python over Arrow batches.

The same values as the column expressions give (detectors are built from those where they stand alone); there, each measure splits the text again and
calls a lambda for every word, which cost more than everything else together. Sums are taken in the same order, so that results are equal to the last bit.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F

from scrivane.functions.runs import run_counter
from scrivane.functions.text import BLANKS, TOKEN_EDGE, term_groups

_WHITE = re.escape("\t\n\x0b\x0c\r \x85\xa0                　")
_SENTENCE = re.compile(rf'(?<=[.!?])[{re.escape(BLANKS)}]+(?=[A-Z"])')
_PARAGRAPH = re.compile(rf"\n[{_WHITE}]*\n")
MEASURES = "phrases array<bigint>, runs array<bigint>, n_words bigint, uniformity double, burstiness double, sentence_length double, question_share double, n_sentences int, type_ratio double"


def variation(xs: list[int]) -> float:
    n, s, q = len(xs), float(sum(xs)), float(sum(x * x for x in xs))
    if n < 2 or s <= 0:
        return 0.0
    return math.sqrt(max(0.0, (q - s * s / n) / (n - 1))) / (s / n)


def type_ratio(low: str, window: int = 50, step: int = 25) -> float:
    tokens = [w.strip(TOKEN_EDGE) for w in low.split()]
    if len(tokens) < window:
        return 0.0
    total, n = 0.0, 0
    for i in range(0, len(tokens) - window + 1, step):
        total += len(set(tokens[i : i + window])) / window
        n += 1
    return max(0.0, 1.0 - total / n)


def of_words(text: str, low: str) -> tuple:
    paragraphs = [n for p in _PARAGRAPH.split(text) if (n := len(p.split()))]
    sentences = [(n, s.endswith("?")) for s in _SENTENCE.split(text.strip(BLANKS)) if (n := len(s.split())) >= 2]
    own = [n for n, _ in sentences]
    return (
        len(text.split()), 1.0 - min(variation(paragraphs), 1.0) if len(paragraphs) >= 3 else 0.0, max(0.0, 1.0 - variation(own)) if len(own) >= 4 else 0.0, float(sum(own)) / max(len(own), 1),
        sum(a for _, a in sentences) / max(len(sentences), 1), len(sentences), type_ratio(low),
    )


def measurer(groups: list[tuple[list[str], bool]], expressions: list[str]):
    """A column function: (text, lower-case text) -> the struct MEASURES, with the counts of each group of (terms, exact) and of each expression of runs."""

    @F.pandas_udf(MEASURES)
    def measure(text: pd.Series, low: pd.Series) -> pd.DataFrame:
        phrases, counters = term_groups(groups), [run_counter(x) for x in expressions]
        rows = [(phrases(small), [c(t) for c in counters], *of_words(t, small)) for t, small in zip(text, low)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return measure
