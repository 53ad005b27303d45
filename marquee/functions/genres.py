"""Genre handling and watch weighting (P-17, P-18, P-21, P-22, P-23)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sigmoid watch weight 1 / (1 + e^(-k (minutes - x0))).
WATCH_K = 0.05
WATCH_X0 = 40.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def std_genre(c) -> Column:
    """P-17: trim, lower, space and ``-`` → ``_``."""
    return F.translate(F.lower(F.trim(_c(c))), " -", "__")


def _ordered_clean(arr: Column) -> Column:
    cleaned = F.transform(F.filter(arr, lambda g: g.isNotNull()), std_genre)
    return F.array_distinct(F.filter(cleaned, lambda g: g != ""))


def genres_from_array(c) -> Column:
    """P-18: NULL → []; skip NULL elements; standardise; drop empties; ordered dedupe."""
    return _ordered_clean(F.coalesce(_c(c), F.array().cast("array<string>")))


def genres_from_string(c) -> Column:
    """P-21: split on commas or whitespace, then as P-18."""
    x = _c(c)
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(
        _ordered_clean(F.split(x, r"[,\s]+", -1)))


def watch_weight(minutes) -> Column:
    """P-22: sigmoid of minutes watched, NULL → 0."""
    m = _c(minutes).cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-WATCH_K) * (m - F.lit(WATCH_X0)))),
                      F.lit(0.0))


def watch_weight_py(minutes) -> float:
    """Scalar twin of :func:`watch_weight` for tests."""
    if minutes is None:
        return 0.0
    return 1.0 / (1.0 + math.exp(-WATCH_K * (minutes - WATCH_X0)))


def genre_indicator(genres, genre) -> Column:
    """P-23 wide form: 1 when ``genre`` is in the list, else 0."""
    return F.array_contains(_c(genres), genre).cast("int")
