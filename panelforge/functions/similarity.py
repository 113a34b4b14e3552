"""Similarities and scores. Weights are data: one weighted sum serves every score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import _c, is_close

# Weights and thresholds of the scores.
SCORE_V1 = {"facility_score": 0.50, "contingency_score": 0.25, "voltage_match": 0.15, "zone_overlap": 0.10}
SCORE_V2 = {
    "pano": {"facility_score": 0.45, "contingency_score": 0.30, "voltage_match": 0.15, "token_overlap": 0.05, "zone_overlap": 0.05},
    "dayzer": {"facility_score": 0.65, "voltage_match": 0.15, "token_overlap": 0.10, "interface_match": 0.10},
}
NAME_SCORE = {"fuzzy": 0.60, "token_jaccard": 0.25, "numeric_jaccard": 0.15}
TOPOLOGY = {"profile_similarity": 0.45, "neighbour_similarity": 0.35, "degree_similarity": 0.20}
COMPOSITE = {"distance_score": 0.30, "voltage_score": 0.25, "name_score": 0.25, "topology_score": 0.20}
LABELS_V1 = [(0.70, "high"), (0.45, "medium")]
LABELS_V2 = [(0.85, "high"), (0.70, "medium")]
LABELS_SUPERVISED = [(0.90, "high"), (0.75, "medium_high"), (0.50, "uncertain")]
CUTS = [(0.50, "reject"), (0.75, "uncertain"), (0.90, "medium_high")]


def _zero(cond: Column, x: Column) -> Column:
    return F.when(cond, F.lit(0.0)).otherwise(x)


def dice(a: Column | str, b: Column | str) -> Column:
    """2 |A & B| / (|A| + |B|) of two token sets; an empty side is 0."""
    a, b = _c(a), _c(b)
    return _zero((F.size(a) == 0) | (F.size(b) == 0), 2.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)))


def jaccard(a: Column | str, b: Column | str, both_empty: float = 1.0) -> Column:
    """|A & B| / |A | B|; both empty is ``both_empty``, one empty 0."""
    a, b = _c(a), _c(b)
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).otherwise(F.coalesce(share, F.lit(0.0)))


def jaccard_of_sizes(a: Column | str, b: Column | str, common: Column | str) -> Column:
    """The same of the sizes of two sets and the number of elements that they share."""
    a, b, n = _c(a), _c(b), _c(common)
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise(F.coalesce(n / F.nullif(a + b - n, F.lit(0)), F.lit(0.0)))


def profile_similarity(a: list[Column], b: list[Column]) -> Column:
    """Sum of minima over sum of maxima of two count profiles; both empty is 0.5."""
    low = sum((F.least(x, y) for x, y in zip(a[1:], b[1:])), F.least(a[0], b[0]))
    high = sum((F.greatest(x, y) for x, y in zip(a[1:], b[1:])), F.greatest(a[0], b[0]))
    return F.when(high == 0, F.lit(0.5)).otherwise(low / F.nullif(high, F.lit(0).cast("double")))


def voltage_match(a: Column | str, b: Column | str) -> Column:
    return F.coalesce((_c(a) == _c(b)).cast("double"), F.lit(0.0))


def voltage_near(a: Column | str, b: Column | str, within: float = 5.0) -> Column:
    return F.coalesce((F.abs(_c(a) - _c(b)) <= within).cast("double"), F.lit(0.0))


def overlap_flag(a: Column | str, b: Column | str) -> Column:
    """1 if two token sets meet, else 0 (two empty ones do not)."""
    return F.arrays_overlap(_c(a), _c(b)).cast("double")


def weighted_score(df: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of weight * column; a column that is missing or null counts 0."""
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items() if c in df.columns]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def label_at_least(x: Column | str, steps: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first threshold that x reaches."""
    out = F
    for least, label in steps:
        out = out.when(_c(x) >= least, F.lit(label))
    return out.otherwise(F.lit(rest))


def label_up_to(x: Column | str, steps: list[tuple[float, str]] = CUTS, rest: str = "high") -> Column:
    """Right-closed bins: the label of the first bound that x does not pass; null stays null."""
    out = F.when(_c(x).isNull(), F.lit(None).cast("string"))
    for most, label in steps:
        out = out.when(_c(x) <= most, F.lit(label))
    return out.otherwise(F.lit(rest))


def is_ambiguous(best: Column | str, second: Column | str, least: float, gap: float = 0.05) -> Column:
    """The best score is low, or close to the second best (missing: 0)."""
    return (_c(best) < least) | (_c(best) - F.coalesce(_c(second), F.lit(0.0)) < gap)


def voltage_band(kv: Column | str) -> Column:
    return F.when(_c(kv).isNull(), "unknown").when(_c(kv) >= 300, "ehv").when(_c(kv) >= 100, "hv").otherwise("lv")


def same_band(a: Column | str, b: Column | str) -> Column:
    return _c(a).isNotNull() & _c(b).isNotNull() & (voltage_band(a) == voltage_band(b))


def voltage_score(a: Column | str, b: Column | str) -> Column:
    """1 equal, 0.25 unknown, 0.65 in one band, else 0."""
    return F.when(is_close(a, b), 1.0).when((_c(a) - _c(b)).isNull(), 0.25).when(same_band(a, b), 0.65).otherwise(0.0)


def distance_score(km: Column | str, radius: float) -> Column:
    return F.coalesce(F.exp(-_c(km) / radius), F.lit(0.0))


def degree_similarity(a: Column | str, b: Column | str) -> Column:
    return 1 - F.abs(_c(a) - _c(b)) / F.greatest(F.lit(1), _c(a), _c(b))


def evidence_conflict(voltage: Column | str, km: Column | str, name: Column | str, topology: Column | str) -> Column:
    return (_c(voltage) < 0.65) | F.coalesce(_c(km) > 50, F.lit(False)) | ((_c(name) < 0.25) & (_c(topology) < 0.45))


def propagation_score(composite: Column | str, forward: Column, reverse: Column, support: Column) -> tuple[Column, Column]:
    """(consistency, score): shares of supporting neighbours, and the composite score lifted by them, within 0 and 1."""
    consistency = 0.65 * forward + 0.35 * reverse
    boost = F.when(support >= 2, 0.10).when(support == 1, 0.05).otherwise(0.0)
    return consistency, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.72 * _c(composite) + 0.28 * consistency + boost))


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from difflib import SequenceMatcher

    for a, b in batches:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def fuzzy_ratio(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks ratio of two strings (order matters); null counts as ''. Run it on distinct pairs."""
    return F.pandas_udf(_ratios, "double")(_c(a), _c(b))


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty strings are 1."""
    longest = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(_c(a), _c(b)) / F.nullif(longest, F.lit(0)))
