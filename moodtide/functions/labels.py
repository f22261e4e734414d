"""Label, percentage and probability expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import LABEL_CODES, POLARITY_THRESHOLD


def polarity_label(polarity: Column, threshold: float = POLARITY_THRESHOLD) -> Column:
    """Positive above the threshold, negative below its negative, else neutral."""
    return (
        F.when(polarity > threshold, "positive").when(polarity < -threshold, "negative").otherwise("neutral")
    )


def polarity_confidence(polarity: Column) -> Column:
    """Distance from zero; a high value for a neutral post means it is nearly not neutral."""
    return F.abs(polarity)


def label_code(label: Column) -> Column:
    """Class code of a label in any letter case, null for an unknown one."""
    out = F.lit(None).cast("int")
    for name, code in LABEL_CODES.items():
        out = F.when(F.lower(label) == name, F.lit(code)).otherwise(out)
    return out


def code_label(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in LABEL_CODES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def argmax(probabilities: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def probability_struct(probabilities: Column) -> Column:
    return F.struct(*[probabilities[code].alias(name) for name, code in LABEL_CODES.items()])


def percentage(part: Column, total: Column, digits: int | None = 2) -> Column:
    """Share in percent, half-even rounded, zero when there is nothing to share."""
    raw = part / total * 100
    rounded = raw if digits is None else F.bround(raw, digits)
    return F.when(total > 0, rounded).otherwise(F.lit(0.0))


def js_round(value: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(value + 0.5).cast("long")
