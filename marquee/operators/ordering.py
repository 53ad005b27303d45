"""Global ordering helpers that stay distributed.

``row_number()`` over an unpartitioned window and ``offset`` on a big input
both funnel every row into one task.  ``ordered_index`` instead range-sorts,
writes the tagged rows once so partition contents are fixed, counts rows
per partition (one row per partition), and adds each partition's starting
offset to the row's position inside it.  Percentiles need no order at all:
positions are found by counting (``exact_percentiles``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ordered_index(df: DataFrame, order: list[Column | str], name: str = "idx", keep: list[str] | None = None) -> DataFrame:
    """Add a 0-based, gap-free position ``name`` following ``order`` (total order
    expected: include tie-break columns).  Of the columns ``keep`` alone is written if given.

    The range-sorted rows are tagged with their partition id and in-partition
    position in the same pass and written once to the shared checkpoint
    folder; per-partition counts (one row per partition) give each
    partition's starting offset.
    """
    tagged = df.orderBy(*order).select(*(keep or ["*"]), F.spark_partition_id().alias("_pid"),
                                       F.monotonically_increasing_id().alias("_mid"))
    with_pos = materialize(tagged, "ordered")
    counts = with_pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # One row per partition: bounded by the partition count, safe to broadcast.
    offsets = counts.select("_pid", "_first",
                            (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                            .alias("_off"))
    return (with_pos.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_off", "_first"))


# Accuracy of the quantile sketch that proposes cuts, and how far (as a share of the
# rows in a range) the outer cuts lie from the wanted position.
ACCURACY = 10_000
SPREAD = 2 / ACCURACY


def _values_at(vals: DataFrame, n: int, wanted: list[int]) -> dict[int, float]:
    """Values of column ``v`` at 0-based positions of its ascending order (NaN last).

    Selection by narrowing ranges: a quantile sketch of a range's rows proposes three
    cuts around each position, one aggregate counts the rows below and up to each cut,
    and a position is either on a cut or goes on with the open range between two cuts.
    Cuts are values of the range, so every round makes it smaller, as a rule to about a
    thousandth; a few counts per position reach the driver, and nothing is shuffled but
    one row per task.
    """
    v = F.col("v")
    found: dict[int, float] = {}
    ranges = {(None, None, 0, n): wanted}  # bounds (exclusive), rows below, end -> positions
    while ranges:
        sketches = []
        for (lo, hi, below, end), positions in ranges.items():
            inside = (v > lo if lo is not None else F.lit(True)) & (v < hi if hi is not None else F.lit(True))
            shares = {(p - below + 0.5) / (end - below) + d for p in positions for d in (-SPREAD, 0.0, SPREAD)}
            sketches.append(F.percentile_approx(F.when(inside, v), sorted({min(1.0, max(0.0, x)) for x in shares}), ACCURACY))
        cuts = [sorted(set(q), key=lambda c: (c != c, c)) for q in vals.agg(*sketches).first()]
        counts = vals.agg(*(F.count_if(x) for cut in cuts for c in cut for x in (v < F.lit(c), v <= F.lit(c)))).first()
        counted = iter(counts)
        narrower: dict[tuple, list[int]] = {}
        for ((lo, hi, below, end), positions), cut in zip(ranges.items(), cuts, strict=True):
            edges = [(c, next(counted), next(counted)) for c in cut]
            for p in positions:
                under = [e for e in edges if e[2] <= p]
                over = [e for e in edges if e[1] > p]
                on = [e for e in edges if e[1] <= p < e[2]]
                if on:
                    found[p] = on[0][0]
                    continue
                first = (under[-1][0], under[-1][2]) if under else (lo, below)
                last = (over[0][0], over[0][1]) if over else (hi, end)
                narrower.setdefault((first[0], last[0], first[1], last[1]), []).append(p)
        ranges = narrower
    return found


def exact_percentiles(df: DataFrame, col: str, ps: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation (``numpy.percentile`` /
    ``percentile_cont``), by distributed selection of the at most 2·len(ps) values at
    the interpolation positions; None for each without values.  ``df`` is read
    several times, one column of it.
    """
    vals = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = vals.count()
    if n == 0:
        return [None for _ in ps]
    ends = [(int(p * (n - 1) // 1), min(int(p * (n - 1) // 1) + 1, n - 1)) for p in ps]
    at = _values_at(vals, n, sorted({i for pair in ends for i in pair}))
    return [at[lo] + (p * (n - 1) - lo) * (at[hi] - at[lo]) for p, (lo, hi) in zip(ps, ends, strict=True)]
