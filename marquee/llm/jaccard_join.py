"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

All shingles are hashed into segments, so a set X falls into parts X_1..X_m.  Two
sets X, Y with Jaccard similarity of ``PERCENT`` or more differ in at most U
elements (U = floor((1 - s) / s * size of the smaller)), and each differing element
spoils one segment.  A size band fixes m and one of two ways to index:

* exact segments: equal parts share the key (segment, part).  A linked pair
  shares at least m - U keys; m exceeds U, and the excess is spent on leaving
  out the costliest keys: ordered by how many sets have them (rarest first),
  each set is indexed under its first U + 1 keys only.  Two key sets with m - U
  common keys out of m have one in these prefixes, so nothing is lost, and empty
  or common parts (the shingles of a passage that many documents share) go
  first.
* one-deletion neighbourhoods (small bands, where parts would be too short to
  be selective): a part is also indexed without each one of its elements, so a
  segment is spoilt only by two differing elements and m = U // 2 + 1 segments
  do.

``allocation`` picks the way and m of each band by cost: keys emitted per set
plus an estimate of the keys too short to be selective that a set would be
indexed under.  A pair is found in the band of its smaller set: every set is
indexed in its own band and, where a partner may lie there, in the band below.

Sets that are equal are one node.  Nodes that share an index key are candidates;
``clusters.links`` verifies them on whole sets and returns components.

Edge cases: null text counts as empty; a text of fewer than ``WORDS`` words is
one shingle; without words a document is linked with nothing; rows may repeat
and are linked like any equal texts; a null id is never a component's smallest
(its row gets that of its component, or null); long texts are hashed in pieces;
an empty table gives an empty result; columns other than the id and the text
are not read.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import clusters
from .bpe import sliced
from .near_dup import _text_key, mix, sets_of, shingle_sets

WORDS = 4
PERCENT = 85
RATIO = 1.6  # of the sizes of neighbouring bands; more than 1 / similarity
FILTER_BITS = 1 << 26  # of the filter of keys that several sets have: 8 MB
WEAK = 2  # parts of fewer elements are not selective
SLICE_BYTES = 1 << 20  # of the texts whose sets and keys a worker holds at once
WEAK_COST = 50.0  # of a weak key that a set is indexed under, in keys emitted


def first_size(band: int) -> int:
    """Smallest set size of a band."""
    return math.ceil(RATIO ** band)


@lru_cache(maxsize=4096)
def band_of(size: int) -> int:
    band = max(0, int(math.log(size) / math.log(RATIO)) - 1)
    while first_size(band + 1) <= size:
        band += 1
    return band


def differing(size: int, percent: int = PERCENT) -> int:
    """Most elements in which a set of this size and a similar one of at least its size differ."""
    return size * (100 - percent) // percent


def _weak(per: float) -> float:
    """Share of the parts with fewer than ``WEAK`` elements when they have ``per`` on average."""
    return math.exp(-per) * sum(per ** k / math.factorial(k) for k in range(WEAK))


@lru_cache(maxsize=4096)
def allocation(band: int, percent: int = PERCENT) -> tuple[int, bool]:
    """Number of segments of a band and whether parts are indexed with one-deletion neighbourhoods."""
    low, high = first_size(band), first_size(band + 1) - 1
    u = differing(high, percent)
    if not u:
        return 1, False
    best = (u // 2 + 1 + high, u // 2 + 1, True)  # a key for every part and for every element left out
    for spare in range(1, u + 2):
        m = u + spare
        kept = max(_weak(size / m) * m - (m - differing(size, percent) - 1) for size in (low, high))
        best = min(best, (m + WEAK_COST * max(0.0, kept), m, False))
    return best[1], best[2]


def _salt(band: int) -> np.uint64:
    return np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))


def part_keys(own: np.ndarray, band: int, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """Keys of a set's parts in a band (with those of parts less one element); a key stands for
    band, segment and content."""
    m, deletions = allocation(band, percent)
    hashed = mix(own + _salt(band))
    segment = (hashed >> np.uint64(32)) % np.uint64(m)
    content = mix(hashed ^ np.uint64(0xD1B54A32D192ED03))
    total = np.zeros(m, np.uint64)
    np.add.at(total, segment, content)
    which = mix(np.arange(m, dtype=np.uint64) + _salt(band) * np.uint64(3))
    keys = mix(total + which)
    if deletions:
        keys = np.unique(np.concatenate([keys, mix(total[segment] - content + which[segment])]))
    return keys, deletions


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """Bands in which a set is indexed: its own, and the one below if a similar set may lie there;
    none for sets so small that only equal ones are similar."""
    if not differing(size, percent):
        return []
    own = band_of(size)
    return [own - 1, own] if own and -(-size * percent // 100) < first_size(own) else [own]


_SIGNED = ("row long, doc_id long, k1 long, k2 long, n_shingles long, digest binary, "
           "keys array<struct<own: boolean, keep: int, keys: array<long>>>")


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: set size, set digest and its keys by band, with the number of keys that
    it is indexed under (null: all); written."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", *_text_key("text"), "text")
    band = pa.struct([("own", pa.bool_()), ("keep", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def keyed(own: np.ndarray) -> list[dict]:
        out = []
        for k in bands(len(own), percent) if len(own) else []:
            keys, deletions = part_keys(own, k, percent)
            out.append({"own": k == band_of(len(own)), "keep": None if deletions else differing(len(own), percent) + 1, "keys": keys.view(np.int64)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                sets = shingle_sets([t.as_py().encode() for t in part.column("text")], words)
                with np.errstate(over="ignore"):
                    keys = [keyed(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("row", "doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(band))], names=["row", "doc_id", "k1", "k2", "n_shingles", "digest", "keys"])

    return materialize(src.mapInArrow(run, _SIGNED), "signatures")


def _possible(of: DataFrame, shared: DataFrame) -> DataFrame:
    """``place``, ``key`` of the keys that may be among ``shared``: those whose bit is set in a filter of
    ``FILTER_BITS``.  At most FILTER_BITS / 64 rows reach the driver, whatever the table; a full filter
    lets every key pass."""
    slot = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = shared.select(F.shiftright(slot, 6).alias("slot"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")) \
        .groupBy("slot").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    known = of.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            place = np.repeat(batch.column("place").to_numpy(), lists.value_lengths().to_numpy())
            slot = key & (FILTER_BITS - 1)
            keep = (known.value[slot >> 6] >> (slot & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(place[keep]), pa.array(key[keep])], names=["place", "key"])

    return of.select("place", "keys").mapInArrow(run, "place long, key long")


def index(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``node`` of the keys that several nodes are indexed under, or may be.
    ``nodes``: ``node``, ``keys``."""
    of = nodes.select("node", F.explode("keys").alias("b")).select(
        (F.col("node") * 2 + F.when(F.col("b.own"), 1).otherwise(0)).alias("place"), "node", "b.keep", "b.keys")
    keys = of.select("place", F.explode("keys").alias("key"))
    # keys that one node has alone come first in the order of rarity, but never meet another
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    met = materialize(_possible(of, shared).join(shared, "key"), "met-keys")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("n", "key"))
    many = F.count(F.lit(1)).over(Window.partitionBy("place"))
    placed = met.select("place", "key", rank.alias("rank"), many.alias("many")).join(
        of.select("place", "node", "keep", F.size("keys").alias("m")), "place")
    return materialize(placed.where("keep is null or m - many + rank <= keep").select(F.col("key").alias("bucket"), "node"), "index")


def representatives(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``node``, ``k1``, ``k2``, ``keys`` of the row that stands for each class of equal sets.  Rows that
    another stands for are found by their digests alone and left out: their ids are few next to the
    classes, so that rows with all their keys are shuffled only where there are many copies."""
    copies = materialize(rows.select("row", "digest").join(classes.where("n > 1").select("digest", "node"), "digest")
                         .where("row <> node").select("row"), "copies")
    return rows.where("n_shingles > 0").join(copies, "row", "left_anti").select(F.col("row").alias("node"), "k1", "k2", "keys")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links of
    similarity ``percent`` / 100 or more, itself included)."""
    rows = signatures(docs, id_col, text_col, words, percent)
    classes = materialize(rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    nodes = materialize(representatives(rows, classes), "nodes")
    comps = materialize(clusters.links(index(nodes), sets_of(docs, nodes, text_col, words), percent), "components")
    linked = classes.join(comps, "node", "left").select("digest", "least", F.coalesce("comp", "node").alias("comp"))
    least = materialize(linked.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    named = materialize(linked.join(least, "comp").select("digest", "component_id"), "named")
    return rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
