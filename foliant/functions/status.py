"""Bands and badges: small CASE expressions over one or two columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import config


def confidence_band(confidence: Column, violations: Column) -> Column:
    return (
        F.when(violations > 0, "red").when(confidence < 0.7, "orange").when(confidence < 0.9, "yellow").otherwise("green")
    )


def threshold_status(value: Column, good: float, warn: float | None, inverse: bool = False, inclusive: bool = True,
                     labels: tuple[str, str, str] = ("Good", "Monitor", "Critical")) -> Column:
    """Good/Monitor/Critical by two limits; ``warn=None`` leaves out the last level."""
    def ok(limit):
        if inverse:
            return value <= limit if inclusive else value < limit
        return value >= limit if inclusive else value > limit

    case = F.when(ok(good), labels[0])
    if warn is None:
        return case.otherwise(labels[1])
    return case.when(ok(warn), labels[1]).otherwise(labels[2])


def doc_type_rating(success_rate: Column) -> Column:
    return F.when(success_rate > 0.9, "Excellent").when(success_rate > 0.8, "Good").otherwise("Needs Attention")


def trend_sign(change: Column) -> tuple[Column, Column]:
    """Direction and signed percentage text of a change given as a fraction."""
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    pct = F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1f", change * 100), F.lit("%"))
    return direction, pct


def routing_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.85, "auto_approve").when(confidence >= 0.70, "manual_review")
        .when(confidence >= 0.60, "high_priority").otherwise("critical")
    )


def infer_field_type(name: Column) -> Column:
    n, out = F.lower(name), None
    for kind, words in config.FIELD_KINDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | n.contains(w)
        out = (F if out is None else out).when(hit, kind)
    return out.otherwise("text")
