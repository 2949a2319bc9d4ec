"""From pattern results to category scores, index, label and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.patterns.library import CATEGORIES, Pattern
from scrivane.session import broadcast_small

#: Thresholds and names of labels.
HUMAN_MOST, AI_LEAST = 15, 30
HUMAN, BETWEEN, AI = "LIKELY HUMAN", "UNCERTAIN", "LIKELY AI"
#: Models that may be compared at once; more are refused.
MOST_MODELS = 10_000


def clamp(raw: Column, low: Column | float, high: Column | float) -> Column:
    """0 up to low, 1 from high on, linear between; with low equal to high a step. The bounds are numbers or columns."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(raw <= low, 0.0).when(raw >= high, 1.0).otherwise(F.try_divide(raw - low, high - low))


def category_scores(patterns: list[Pattern], score_of) -> Column:
    """A struct of the weighted means by category; one without patterns has 0. Terms are added in the library's order."""
    means = []
    for c in CATEGORIES:
        own = [p for p in patterns if p.category == c]
        total = sum(p.weight for p in own)
        means.append((reduce(lambda a, b: a + b, (score_of(p) * p.weight for p in own)) / total if total else F.lit(0.0)).alias(c))
    return F.struct(*means)


def index_of(categories: Column, weights: dict[str, float]) -> Column:
    """0 to 100, half to even."""
    total = reduce(lambda a, b: a + b, (categories[c] * weights.get(c, 0.0) for c in CATEGORIES))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(total * 100).cast("int")))


def label_of(index: Column) -> Column:
    return F.when(index <= HUMAN_MOST, HUMAN).when(index >= AI_LEAST, AI).otherwise(BETWEEN)


def category_means(long: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted means by category from the long form (keys, category, norm_score, weight), one column each."""
    by = long.groupBy(*keys).pivot("category", list(CATEGORIES)).agg(F.try_divide(F.sum(F.col("norm_score") * F.col("weight")), F.sum("weight")))
    return by.na.fill(0.0, list(CATEGORIES))


def model_similarity(long: DataFrame, profiles: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """(keys, model_id, similarity): 1 less the mean distance from a profile over the patterns both have; 0 for none.

    profiles: (model_id, pattern_id, expected); it doesn't grow with the documents.
    """
    met = long.join(broadcast_small(profiles), "pattern_id")
    near = met.groupBy(*keys, "model_id").agg(F.bround(1 - F.avg(F.abs(F.col("norm_score") - F.col("expected"))), digits).alias("similarity"))
    models = [r[0] for r in profiles.select("model_id").distinct().limit(MOST_MODELS + 1).collect()]
    if len(models) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    every = long.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(m) for m in models))).alias("model_id"))
    return every.join(near, [*keys, "model_id"], "left").select(*keys, "model_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def similarity_map(similar: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_match): the models' similarities as a map."""
    return similar.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", "similarity")))).alias("model_match"))  # a few models


def delta_vector(a: Column, b: Column, digits: int = 3) -> Column:
    """The differences by category."""
    return F.struct(*(F.bround(a[c] - b[c], digits).alias(c) for c in CATEGORIES))
