"""Best-fit packing of token pieces by minimum bin slack.

Which lengths share a sequence depends only on how many pieces have each
length, so the plan is made from the length histogram: at most ``capacity``
rows, whatever the corpus.  For each bin the largest length left is taken, and
a bitset subset-sum over the lengths left finds the fullest feasible filling of
the rest; the same filling is repeated as often as the counts allow, then
removed.  A plan has at most 90 distinct lengths per filling (1 + ... + 91
exceeds 4096), hence a bounded number of rows, which are broadcast.

Spark numbers the pieces of each length (salted, so one frequent length is
spread over many tasks) and looks each number up in the plan.

Edge cases: null text counts as empty (one end token); rows may repeat and are
packed each; only documents longer than ``capacity`` are cut; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bpe

CAPACITY = 4096
END_ID = 1
ROWS_PER_SALT = 20_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of available lengths with the largest sum of at most ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        many, take = min(counts[length], room // length), 1
        while many > 0:  # 1, 2, 4, ... copies cover every multiplicity
            take = min(take, many)
            after = reach | ((reach << (length * take)) & mask)
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            many -= take
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        filling = fullest({n: c for n, c in rest.items() if c}, capacity - largest)
        filling[largest] = filling.get(largest, 0) + 1
        times = min(left[n] // m for n, m in filling.items())
        out.append((filling, times))
        for n, m in filling.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def plan_rows(fillings: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, times, first sequence, offset), sorted: number
    ``k`` of a length's row is copy ``(k - first) // times`` in sequence
    ``first sequence + (k - first) % times``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in fillings:
        offset = 0
        for length, many in sorted(filling.items(), reverse=True):
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + many * times
            offset += length * many
        sequence += times
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``doc_id``, ``piece``, ``start``,
    ``length``, ``ids_crc32``; written, so that numbering is stable)."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(hist.values())
    rows = spark.sparkContext.broadcast(plan_rows(plan(hist, capacity)))

    salts = max(64, total // (ROWS_PER_SALT * max(1, len(hist))))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("at", F.row_number().over(order) - 1).join(firsts, ["length", "salt"]) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("at")).alias("number"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        wide = np.int64(1) << 44  # more pieces than any length can have
        keys = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = table[np.searchsorted(keys, length * wide + number, side="right") - 1] if len(length) else table[:0]
            k = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(row[:, 3] + k % np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + k // np.maximum(row[:, 2], 1) * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, entries: int | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece.  ``entries`` bounds a
    worker's word table (see ``bpe``)."""
    cut = materialize(bpe.pieces(docs, capacity, end_id, id_col, text_col, vocab_path, entries), "pieces")
    return place(cut, capacity)
