"""Removal of repeated byte strings by distributed prefix doubling.

A position is a byte at which a string of ``LENGTH`` bytes starts.  Positions
are ranked by strings that grow from round to round, and a position leaves as soon
as its string is unique (its longer strings are unique too) or once its whole string
is known to repeat:

1. ``GRAM`` bytes: each position's string is named by its least gram
   (leftmost of equal ones).  Equal strings have the same gram at the same
   offset, so one row stands for the whole run of positions with that gram, and
   only places at multiples of ``GRAM`` bytes from that gram need ranks.
2. Doubling over those places, from ``START`` grams: Spark sorts the distinct pairs
   (rank[i], rank[i + h]) for the offsets h of ``OFFSETS`` (the last overlaps), the
   place of a pair in that order is the rank of the longer string, and pairs of one
   position leave.  At the end every cut of ``GRAM`` positions has the rank of the
   352 bytes its positions share.
3. The ends, ``LENGTH - n + 1`` bytes for n in ``NODES``: the positions left in a run
   are cut at offsets divisible by n; the string that all positions of a cut share,
   named under its rank before, is its name.  A cut whose whole stretch repeats is
   settled for all its positions.  The last n is 1: single positions and whole strings.

In every round Spark groups (aggregating before its shuffle) and re-joins the
names; the first names and those of the ends are 64-bit fingerprints of strings
inside a group of equal grams, ranks are exact.
Counts are written before they are joined back, so that AQE can split a name
that very many positions share.  Bytes travel only with texts that share a
gram with another position.

Edge cases: null text counts as empty; texts shorter than ``LENGTH`` lose
nothing; long texts are read in overlapping segments; rows may repeat (equal
texts of at least ``LENGTH`` bytes repeat each other and lose everything);
strings never cross rows; an empty table gives an empty result; columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import sliced

LENGTH, GRAM = 400, 32
NODES = (GRAM, 8, 1)
START, OFFSETS = 2, (2, 4, 3)  # in grams: 64 bytes, then 128, 256 and 352
SEGMENT = 1 << 20  # positions of a long text read at once
SLICE = 1 << 21
_AT = 22  # low bits of a gram's sort key that hold its place in the slice

_RNG = np.random.default_rng(77)
_BYTE = _RNG.integers(0, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xC2B2AE3D27D4EB4F | 1
_POWERS: list[np.ndarray] = []


def _mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Fingerprints of all substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not _POWERS or len(_POWERS[0]) < n + 1:
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64)
                          for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWERS[0][:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
        own = (self.total[end] - self.total[start]) * _POWERS[1][start]
        return _mix(own + _mix(np.atleast_1d(np.asarray(salt, dtype=np.uint64)) + np.uint64(1)))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[:len(h) - (width - done)], h[width - done:]) if width > done else h


def runs(segments: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of positions with one least gram: segment, first position, lowest and highest
    offset of the gram, names of the gram and of the run's whole stretch."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments])
    first = np.cumsum(size) - size
    prefix = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = prefix.of(at, at + GRAM, 0)
    low = np.uint64((1 << _AT) - 1)
    best = _least((gram & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1)
    owner = np.searchsorted(first, np.arange(len(best)), side="right") - 1
    good = np.arange(len(best)) + LENGTH <= first[owner] + size[owner]
    pos = np.flatnonzero(good)
    anchor = (best[pos] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(pos) else np.zeros(0, np.int64)
    start, stop = pos[new], pos[np.concatenate([new[1:], [len(pos)]]) - 1] if len(pos) else pos[new]
    anchor = anchor[new]
    high = anchor - start
    return (owner[start], start - first[owner[start]], anchor - stop, high, gram[anchor],
            prefix.of(start, stop + LENGTH, high.astype(np.uint64) * np.uint64(LENGTH) + (anchor - stop).astype(np.uint64)))


def _segments(text: bytes) -> Iterator[tuple[int, bytes]]:
    for at in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
        yield at, text[at:at + SEGMENT + LENGTH - 1]


def _groups(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Segments (text, start, bytes) in groups of about ``SLICE`` bytes."""
    held, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at, part in _segments(text):
            held.append((k, at, part))
            size += len(part)
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _text_key():
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sliced(batch, "text"):
            k1, k2 = (part.column(c).to_numpy() for c in ("k1", "k2"))
            for group in _groups([t.as_py().encode() for t in part.column("text")]):
                owner, start, low, high, gram, stretch = runs([g[2] for g in group])
                text = np.array([g[0] for g in group])[owner]
                begin = np.array([g[1] for g in group])[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[text]), pa.array(k2[text]), pa.array(start + begin), pa.array(low.astype(np.int32)),
                     pa.array(high.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(stretch.view(np.int64))],
                    names=["k1", "k2", "start", "low", "high", "gram", "stretch"])


RUN = ["gram", "stretch", "low", "high"]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run and place (in grams from its gram) the names of the two neighbouring strings
    of ``START`` grams there: the pairs of the first round."""
    h = START * GRAM
    more = sum(OFFSETS[1:])  # places of the first pairs behind the last cut
    for whole_batch in batches:
        for batch in sliced(whole_batch, "bytes"):
            rows = batch.column("bytes").to_pylist()
            prefix = Prefix(np.frombuffer(b"".join(rows), np.uint8))
            size = np.array([len(b) for b in rows])
            run, many, gram, low, high = (batch.column(c).to_numpy() for c in ("run", "many", "gram", "low", "high"))
            per = (high // GRAM - low // GRAM + 1 + more).astype(np.int64)
            at = np.repeat(np.arange(len(rows)), per)
            place = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per) - (high // GRAM)[at]
            begin = (np.cumsum(size) - size + high)[at] + place * GRAM
            salt = gram.view(np.uint64)[at] + place.astype(np.uint64)
            names = [prefix.of(begin + k * h, begin + (k + 1) * h, salt + np.uint64(k * START)).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(run[at]), pa.array(many[at]), pa.array(place.astype(np.int32)), *map(pa.array, names)],
                names=["run", "many", "place", "first", "second"])


def _reranked(pairs: DataFrame) -> DataFrame:
    """``run``, ``many``, ``place`` and ``rank`` of the strings that repeat: the place of
    their pair among the sorted distinct pairs.  Strings of settled runs alone leave too."""
    ranks = materialize(pairs.groupBy("first", "second").agg(F.sum("many").alias("n"), F.min("many").alias("least"))
                        .where("n > 1 and least = 1").select("first", "second").orderBy("first", "second")
                        .withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return pairs.join(ranks, ["first", "second"]).select("run", "many", "place", "rank")


def _by_run(ranked: DataFrame) -> DataFrame:
    """One row per run: its at most 24 places and their ranks."""
    return ranked.groupBy("run").agg(F.max("many").alias("many"), F.collect_list(F.struct("place", "rank")).alias("ranks"))


def _doubled(bytes_of: DataFrame) -> DataFrame:
    """Per run its cuts whose shared string repeats (``place``, ``rank``), by prefix doubling."""
    pairs = materialize(bytes_of.select("run", "many", "gram", "low", "high", "bytes").mapInArrow(
        _places, "run long, many int, place int, first long, second long"), "rank-pairs")
    for h in OFFSETS[1:]:
        pairs = materialize(_by_run(_reranked(pairs)).withColumn("at", F.map_from_entries("ranks")).select(
            "run", "many", F.explode("ranks").alias("r"), "at").select(
            "run", "many", "r.place", F.col("r.rank").alias("first"),
            F.try_element_at("at", F.col("r.place") + F.lit(h)).alias("second")).where("second is not null"), "rank-pairs")
    return _by_run(_reranked(pairs)).select("run", "ranks")


_CUT = "run long, lo int, hi int, many int, core long, whole long"


def _cutter(node: int):
    """Per run and range of offsets left (``ranges``: lo, hi, many, core): the cuts at multiples of
    ``node``, with the name of the string all positions of the cut share and that of
    its whole stretch.  ``core`` is the rank or name of the range's own shared string; the
    ranges of the first node are its cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in sliced(whole_batch, "bytes"):
                rows = batch.column("bytes").to_pylist()
                prefix = Prefix(np.frombuffer(b"".join(rows), np.uint8))
                size = np.array([len(b) for b in rows])
                gram, high, name = (batch.column(c).to_numpy() for c in ("gram", "high", "run"))
                anchor = np.cumsum(size) - size + high  # the gram's place
                ranges = batch.column("ranges")
                owner = np.repeat(np.arange(len(rows)), ranges.value_lengths().to_numpy())
                flat = ranges.flatten()
                lo, hi, many, before = (flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "many", "core"))
                per = hi // node - lo // node + 1
                at = np.repeat(np.arange(len(lo)), per)
                j = lo[at] // node + np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
                lo, hi, many, owner = np.maximum(lo[at], j * node), np.minimum(hi[at], j * node + node - 1), many[at], owner[at]
                top = np.minimum(j * node + node - 1, LENGTH - GRAM)
                salt = gram.view(np.uint64)[owner] + j.astype(np.uint64)
                here = anchor[owner]
                core = before[at] if node == NODES[0] else prefix.of(
                    here - j * node, here - top + LENGTH, salt + before.view(np.uint64)[at]).view(np.int64)
                # the stretch of the cut's own positions; equal only with the same offsets
                whole = prefix.of(here - hi, here - lo + LENGTH, salt + ((lo << 40) + (hi << 20)).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[owner]), *(pa.array(c.astype(np.int32)) for c in (lo, hi, many)), pa.array(core),
                     pa.array(whole.view(np.int64))], names=["run", "lo", "hi", "many", "core", "whole"])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


_CLEANED = "k1 long, k2 long, n_removed long, n_spans long, kept binary"


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its repeated positions joined to byte runs, and what is left."""
    for batch in batches:
        out = []
        for k1, k2, text, found in zip(*(batch.column(c) for c in ("k1", "k2", "text", "found")), strict=True):
            data = text.as_py().encode()
            spans: list[tuple[int, int]] = []
            for row in found.as_py():
                origin = row["start"] + row["high"]
                ranges = [(row["low"], row["high"])] if row["many"] > 1 else [(c["lo"], c["hi"]) for c in row["ranges"]]
                spans += [(origin - hi, origin - lo + LENGTH) for lo, hi in ranges]
            spans = _union(spans)
            kept, at = [], 0
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            out.append((k1.as_py(), k2.as_py(), sum(e - s for s, e in spans), len(spans), b"".join([*kept, data[at:]])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (*[pa.int64()] * 4, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         names=["k1", "k2", "n_removed", "n_spans", "kept"])


def cleaned_texts(src: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``n_removed``, ``n_spans``, ``kept`` of every text that may lose bytes.
    ``src``: ``k1``, ``k2`` (keys of the text) and ``text``."""
    found = materialize(src.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text").mapInArrow(
        _find_runs, "k1 long, k2 long, start long, low int, high int, gram long, stretch long"), "runs")
    # runs whose gram another run has
    grams = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    found = materialize(found.join(grams, "gram").groupBy("k1", "k2", "start", *RUN).agg(F.count(F.lit(1)).alias("n")), "runs")
    kinds = found.groupBy(*RUN).agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at")) \
        .select(F.monotonically_increasing_id().alias("run"), *RUN, F.least(F.col("n"), F.lit(2)).cast("int").alias("many"), "at")
    kinds = materialize(kinds, "run-kinds")
    texts = materialize(src.where(F.octet_length("text") >= LENGTH).groupBy("k1", "k2").agg(F.first("text").alias("text"))
                        .join(found.select("k1", "k2").distinct(), ["k1", "k2"]), "texts")

    # bytes of one run of each kind; a gram whose kinds are all settled decides nothing more
    open_grams = materialize(kinds.groupBy("gram").agg(F.min("many").alias("least")).where("least = 1").select("gram"), "open-grams")
    wanted = kinds.join(open_grams, "gram").select(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2"), F.struct(
        "run", *RUN, "many", F.col("at.start").alias("start")).alias("r")).groupBy("k1", "k2").agg(F.collect_list("r").alias("rs"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("run", pa.int64()), ("gram", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("many", pa.int32()),
                            ("bytes", pa.binary())])
        for batch in batches:
            for part in sliced(batch, "text"):
                out = []
                for text, rs in zip(part.column("text"), part.column("rs"), strict=True):
                    data = text.as_py().encode()
                    out += [{k: r[k] for k in ("run", "gram", "low", "high", "many")} |
                            {"bytes": data[r["start"]:r["start"] + r["high"] - r["low"] + LENGTH]} for r in rs.as_py()]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    bytes_of = materialize(texts.join(wanted, ["k1", "k2"]).select("text", "rs").mapInArrow(
        stretches, "run long, gram long, low int, high int, many int, bytes binary"), "stretches")

    left = bytes_of.join(_doubled(bytes_of), "run").withColumn("ranges", F.transform("ranks", lambda r: F.struct(
        F.greatest("low", -r["place"] * GRAM).alias("lo"), F.least("high", -r["place"] * GRAM + (GRAM - 1)).alias("hi"),
        "many", r["rank"].alias("core"))))
    settled = []
    for node in NODES:
        cuts = materialize(left.select("run", "gram", "high", "bytes", "ranges").mapInArrow(_cutter(node), _CUT), "cuts")
        if node != NODES[0]:  # those of the first node are ranked
            # a cut whose shared string no other cut has is unique in all its positions
            cores = materialize(cuts.groupBy("core").agg(F.sum("many").alias("n")).where("n > 1").select("core"), "cores")
            cuts = cuts.join(cores, "core")
        if node == 1:
            settled.append(cuts.where("many = 1").select("run", "lo", "hi"))
            break
        cuts = materialize(cuts, "cuts")
        wholes = materialize(cuts.groupBy("whole").agg(F.sum("many").alias("n"), F.min(F.struct("run", "lo")).alias("one")), "wholes")
        cuts = materialize(cuts.join(wholes, "whole").select(
            "run", "lo", "hi", "many", "core", (F.col("n") > 1).alias("settled"), (F.struct("run", "lo") == F.col("one")).alias("stands")), "cuts")
        settled.append(cuts.where("settled and many = 1").select("run", "lo", "hi"))
        # the rest goes on with those it may still share a string with; of equal settled cuts one stands for all
        open_cores = materialize(cuts.where("not settled and many = 1").select("core").distinct(), "open-cores")
        ranges = cuts.where("stands").join(open_cores, "core").select("run", F.struct(
            "lo", "hi", F.when(F.col("settled"), F.lit(2)).otherwise(F.col("many")).alias("many"), "core").alias("r")) \
            .groupBy("run").agg(F.collect_list("r").alias("ranges"))
        left = bytes_of.join(ranges, "run")
    ranges = settled[0]
    for more in settled[1:]:
        ranges = ranges.unionByName(more)
    ranges = ranges.groupBy("run").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    marks = materialize(kinds.select("run", *RUN, "many").join(ranges, "run", "left")
                        .where("many > 1 or ranges is not null"), "marks")
    per_text = found.join(marks, RUN).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "low", "high", "many", "ranges")).alias("found"))
    return materialize(texts.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "found").mapInArrow(_clean, _CLEANED), "cleaned")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left)
    or null where nothing was removed, with ``kept_sha256``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .select("doc_id", "text", *_text_key())
    changed = cleaned_texts(src)
    rows = src.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    return rows.join(changed, ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "kept",
        F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"))


