"""Small scalar expressions (P-24 … P-32)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the serving layer and the offline evaluation.
NEW_USER_ID_LIMIT = 1000          # user id below this → segment "new"
DEFAULT_PREDICTION = 3.0          # rating predicted when the model has none
RATING_MIN, RATING_MAX = 1.0, 5.0
# (min rated count, cf weight, cb weight), checked top-down; otherwise (0, 1).
HYBRID_WEIGHT_TIERS = ((20, 0.8, 0.2), (10, 0.6, 0.4), (1, 0.4, 0.6))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_segment(user_id) -> Column:
    """P-24."""
    return F.when(_c(user_id) < NEW_USER_ID_LIMIT, F.lit("new")).otherwise(F.lit("returning"))


def hybrid_alpha_beta(n_rated) -> tuple[Column, Column]:
    """P-25: (cf weight, cb weight) from the number of rated movies."""
    n = F.coalesce(_c(n_rated), F.lit(0))
    alpha = F.lit(0.0)
    beta = F.lit(1.0)
    for lo, a, b in reversed(HYBRID_WEIGHT_TIERS):
        alpha = F.when(n >= lo, F.lit(a)).otherwise(alpha)
        beta = F.when(n >= lo, F.lit(b)).otherwise(beta)
    return alpha, beta


def clip_prediction(p) -> Column:
    """P-27: default 3.0, clipped to [1, 5]."""
    return F.least(F.greatest(F.coalesce(_c(p).cast("double"), F.lit(DEFAULT_PREDICTION)),
                              F.lit(RATING_MIN)), F.lit(RATING_MAX))


def title_or_unknown(title, movie_id) -> Column:
    """P-28."""
    return F.coalesce(_c(title), F.concat(F.lit("Unknown Title ("), _c(movie_id).cast("string"), F.lit(")")))


def format_metadata_plot(plot) -> Column:
    """P-29: plot text before ``::``, or ``N/A``."""
    p = _c(plot)
    return F.when(p.isNull() | (p == ""), F.lit("N/A")).otherwise(F.split_part(p, F.lit("::"), F.lit(1)))


def latency_ms(seconds) -> Column:
    """P-32."""
    return F.round(_c(seconds) * 1000.0, 2)


def vectors_float32(c) -> Column:
    """P-31."""
    return _c(c).cast("array<float>")
