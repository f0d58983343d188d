"""Similarity of two functions as column expressions, and the choice of a unique best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and margins of the matching rungs.
FUZZY_THRESHOLD, FUZZY_MARGIN = 0.55, 0.05
ANCHOR_MIN, ANCHOR_THRESHOLD, ANCHOR_MARGIN = 2, 0.5, 0.25
VECTOR_MIN, VECTOR_THRESHOLD, VECTOR_MARGIN = 4, 0.7, 0.05
RECURSION_WEIGHT, MIN_AGREEMENT, AGREEMENT_MARGIN = 2.0, 1.0, 1.0
CONFIDENCE_MARGIN = 5
SLACK = 1e-9


def _by_name(counts: Column) -> Column:
    return F.map_from_entries(counts)


def cosine(a: Column, b: Column) -> Column:
    """Of two counted lists; 0 when either is empty. Sums of whole numbers, so their order does not matter."""
    of_b = _by_name(b)
    dot = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["count"] * F.coalesce(F.try_element_at(of_b, e["mnemonic"]), F.lit(0)))
    norm = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e["count"] * e["count"])
    both = norm(a) * norm(b)
    return F.when(both > 0, dot / (F.sqrt(norm(a)) * F.sqrt(norm(b)))).otherwise(0.0)


def closeness(x: Column, y: Column) -> Column:
    return 1.0 - F.abs(x - y) / F.greatest(x + y, F.lit(1))


def similarity(a: str, b: str) -> Column:
    """Instruction mix, block count and out-degree of the functions in struct columns a and b."""
    f = lambda side, c: F.col(f"{side}.{c}")
    no_order = (F.size(f(a, "trigrams")) == 0) | (F.size(f(b, "trigrams")) == 0)
    return weighed_similarity(a, b, cosine(f(a, "mnemonics"), f(b, "mnemonics")), cosine(f(a, "trigrams"), f(b, "trigrams")), no_order)


def weighed_similarity(a: str, b: str, mix: Column, order: Column, no_order: Column) -> Column:
    """The same from the cosines of the functions' mnemonics and trigrams."""
    f = lambda side, c: F.col(f"{side}.{c}")
    weighed = F.when(no_order, 0.60 * mix).otherwise(0.35 * mix + 0.25 * order)
    return weighed + 0.25 * closeness(f(a, "bb_count"), f(b, "bb_count")) + 0.15 * closeness(f(a, "out_degree"), f(b, "out_degree"))


def jaccard(a: Column, b: Column, of_two_empty: float = 0.0) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(of_two_empty)).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / union)


def vector_cosine(a: Column, b: Column) -> Column:
    """Of two lists of (hash, weight)."""
    of_b = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["weight"] * F.coalesce(F.try_element_at(of_b, e["hash"]), F.lit(0.0)))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def confidence_pct(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def baseline_similarity(a: str, b: str) -> Column:
    f = lambda side, c: F.col(f"{side}.{c}")
    return weighed_baseline(a, b, cosine(f(a, "mnemonics"), f(b, "mnemonics")), jaccard(f(a, "trigram_set"), f(b, "trigram_set"), 1.0))


def weighed_baseline(a: str, b: str, mix: Column, shared: Column) -> Column:
    """The same from the cosine of the functions' mnemonics and the Jaccard of their trigram sets."""
    f = lambda side, c: F.col(f"{side}.{c}")
    return (
        0.40 * mix + 0.30 * shared
        + 0.15 * closeness(f(a, "bb_count"), f(b, "bb_count")) + 0.10 * closeness(f(a, "out_degree"), f(b, "out_degree")) + 0.05 * closeness(f(a, "in_degree"), f(b, "in_degree"))
    )


def best_unique(scores: DataFrame, side: str, other: str, threshold: float, margin: float, strict: bool = False) -> DataFrame:
    """(pair_id, side, other, score) where the best other reaches the threshold and leads the next one by the margin.

    With strict, being better than every other is enough. All of it is partial aggregation: a function with
    very many candidates costs no task more than others.
    """
    key = ["pair_id", side]
    top = scores.groupBy(*key).agg(F.max_by(other, F.struct("score", other)).alias("_best"), F.max("score").alias("_top"))
    rest = scores.join(top, key).where(F.col(other) != F.col("_best")).groupBy(*key).agg(F.max("score").alias("_next"))
    ranked = top.join(rest, key, "left")
    clear = F.col("_next").isNull() | ((F.col("_top") > F.col("_next")) if strict else (F.col("_top") - F.col("_next") >= margin))
    return ranked.where((F.col("_top") >= threshold) & clear).select("pair_id", side, F.col("_best").alias(other), F.col("_top").alias("score"))


def reciprocal(scores: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(pair_id, a_id, b_id, score) of the pairs that are each other's unique best."""
    there = best_unique(scores, "a_id", "b_id", threshold, margin)
    back = best_unique(scores, "b_id", "a_id", threshold, margin).select("pair_id", "a_id", "b_id")
    return there.join(back, ["pair_id", "a_id", "b_id"])
