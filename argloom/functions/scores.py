"""Numeric expressions: clips, gates, ratios, overlaps and their conventions for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def soft_gate(x: Column, threshold: float, steepness: float = 20.0) -> Column:
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), steepness * (x - threshold)))
    return 1 / (1 + F.exp(-z))


def impact(x: Column) -> Column:
    p = F.greatest(x, F.lit(0.0))
    return p * p / (1 + p * p)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def degradation(clean: Column, perturbed: Column) -> Column:
    """Relative degradation, clipped to [-1, 1]; 0 if the clean score is not above 0."""
    return F.when(clean <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - perturbed / clean)))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap of two spans over their hull."""
    overlap = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull <= 0, 1.0).otherwise(overlap / hull)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes ``x0, y0, x1, y1``; two empty boxes give 1."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda box: F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    inter = side(0) * side(1)
    union = area(a) + area(b) - inter
    return F.when(union <= 0, 1.0).otherwise(inter / union)


def modal_strength(scope: Column, component: Column, status: Column) -> Column:
    """Strength of a statement by scope, then component, then status; the first rule that holds."""
    return (
        F.when((scope == "universal") & (status == "analytic"), 1.0)
        .when(scope == "essential", 0.9)
        .when(scope.isin("localized_universal", "localized_existential"), 0.85)
        .when(scope == "statistical", 0.75)
        .when(scope == "existential", 0.55)
        .when(component == "axiom", 1.0)
        .when(component == "evidence", 0.85)
        .when((component == "hypothesis") & (status == "analytic"), 0.75)
        .when(status == "speculative", 0.35)
        .otherwise(0.6)
    )


def token_saving(state_chars: Column, question_chars: Column, options: Column) -> Column:
    return F.floor(state_chars / 4) + F.floor(question_chars / 4) + 8 * options + 50
