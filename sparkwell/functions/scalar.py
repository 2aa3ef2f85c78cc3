"""Scalar expressions of the analytics and ranking operators; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much an interaction of each kind says about preference.
WEIGHTS = {"save": 3, "click": 2, "view": 1}
# The least base score of grades 3, 2 and 1.
GRADES = ((1.5, 3), (1.0, 2), (0.4, 1))
ALPHA = 40
COLD_START = 5


def interaction_weight(kind: Column) -> Column:
    """3, 2 or 1 for save, click and view; 0 for anything else."""
    c = F
    for name, w in WEIGHTS.items():
        c = c.when(kind == name, w)
    return c.otherwise(0)


def confidence(weighted_score: Column, alpha: int = ALPHA) -> Column:
    return 1 + alpha * weighted_score


def cold_flag(count: Column, threshold: int = COLD_START) -> Column:
    return F.when(count < threshold, 1).otherwise(0)


def year_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy")


def week_text(ts: Column) -> Column:
    """Week of the year as two digits, weeks beginning on Monday, days before the first Monday in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.lpad(week.cast("string"), 2, "0")


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole in double precision; 0 where whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1)


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade.cast("double")) - 1


def percent_text(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def contains_ignoring_case(text: Column, term: Column) -> Column:
    return F.contains(F.lower(text), F.lower(term))


def matches_ignoring_case(text: Column, pattern: str) -> Column:
    """Regular-expression search; null counts as no match."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def preview(text: Column, size: int = 150) -> Column:
    return F.translate(F.substring(text, 1, size), "\n", " ")


def grade(base: Column) -> Column:
    c = F
    for least, g in GRADES:
        c = c.when(base >= least, g)
    return c.otherwise(0)


def hashed_id(raw: Column, prefix: str = "DOC-") -> Column:
    return F.concat(F.lit(prefix), F.upper(F.substring(F.md5(raw), 1, 12)))


def padded_id(prefix: str, width: int, number: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\S+"))


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """template with each {slot} replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a: Column, least: float = 1e-12) -> Column:
    """a divided by its length (at least a tiny one, so a zero vector stays zero)."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)
