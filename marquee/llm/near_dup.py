"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``BANDS`` small keys (``ROWS`` minhashes each) are made per
document; every pair (i, j) of a key from the first and a key from the second
is a table key, so ``BANDS`` squared tables of ``2 * ROWS`` rows cost only
``2 * BANDS * ROWS`` minhashes.  At similarity 0.75 all tables miss a pair with
probability 2 * (1 - 0.75 ** ROWS) ** BANDS, about 4e-5.

Documents with the same shingle set are one node.  Keys that only one node has
are dropped before pairs are formed (a table key can only be shared if both
halves are).  Candidates are verified on whole sets by ``clusters.links``.

Edge cases: null text counts as empty; a text of fewer than five words is one
shingle; without words a document is linked with nothing; rows may repeat and
are linked like any equal texts; long texts are hashed in pieces; an empty
table gives an empty result; columns other than the id and the text are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import clusters
from .bpe import sliced

WORDS = 5
SIMILAR = 75  # hundredths
BANDS, ROWS = 20, 3
PIECE = 1 << 21

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_MIX = [int(x) | 1 for x in _RNG.integers(1, 2 ** 63, WORDS + ROWS + 2, dtype=np.int64)]
_XOR = _RNG.integers(0, 2 ** 63, 2 * BANDS * ROWS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2 ** 63, 2 * BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]).cumprod(dtype=np.uint64)
                      for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (stretch without ASCII white space)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:len(data)])])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a long text, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _sets(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    h = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        h = h + words[j:n - k + 1 + j] * np.uint64(_MIX[j])
    return np.unique(mix(h))


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``width`` words; words lower-cased in A-Z."""
    out: list[np.ndarray] = []
    short: list[bytes] = []

    def flush():
        if short:
            joined = b" ".join(short)
            first = np.cumsum([0] + [len(t) + 1 for t in short])
            words, start = word_hashes(np.frombuffer(joined.lower(), np.uint8))
            cut = np.searchsorted(start, first)
            out.extend(_sets(words[a:b], width) for a, b in zip(cut, cut[1:]))
            short.clear()

    held = 0
    for text in texts:
        if len(text) > PIECE:
            flush()
            held = 0
            parts = [word_hashes(np.frombuffer(p.lower(), np.uint8))[0] for p in _pieces(text)]
            out.append(_sets(np.concatenate(parts), width))
            continue
        short.append(text)
        held += len(text) + 1
        if held > PIECE:
            flush()
            held = 0
    flush()
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 2 * BANDS) keys of non-empty sets; each key knows its collection and band."""
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    values = np.concatenate(sets)
    keys = np.empty((len(sets), 2 * BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(2 * BANDS):
            key = np.full(len(sets), np.uint64(band + 1) * np.uint64(_MIX[-1]))
            for r in range(ROWS):
                t = band * ROWS + r
                least = np.minimum.reduceat((values ^ _XOR[t]) * _MUL[t], first)
                key = mix(key + least * np.uint64(_MIX[WORDS + r]))
            keys[:, band] = key
    return keys


_SIGNED = "row long, doc_id long, k1 long, k2 long, n_shingles long, digest binary, first array<long>, second array<long>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its set size, set digest and half keys; written."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", *_text_key("text"), "text")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_shingles", pa.int64()),
                        ("digest", pa.binary()), ("first", pa.list_(pa.int64())), ("second", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                sets = shingle_sets([t.as_py().encode() for t in part.column("text")])
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: dict[int, np.ndarray] = {}
                if some:
                    keys = dict(zip(some, half_keys([sets[i] for i in some]).view(np.int64), strict=True))
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("row", "doc_id", "k1", "k2")), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([keys[i][:BANDS] if i in keys else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([keys[i][BANDS:] if i in keys else None for i in range(len(sets))], pa.list_(pa.int64()))], schema=schema)

    return materialize(src.mapInArrow(run, _SIGNED), "signatures")


def _text_key(text):
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")


def buckets(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``node`` of the table keys that several nodes may share; written.
    ``nodes``: ``node``, ``first``, ``second``."""
    halves = nodes.select("node", F.lit(0).alias("side"), F.explode("first").alias("key")) \
        .unionByName(nodes.select("node", F.lit(1).alias("side"), F.explode("second").alias("key")))
    shared = materialize(halves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-halves")
    both = halves.join(shared, "key").groupBy("node").agg(  # at most 2 * BANDS keys a node
        F.collect_list(F.when(F.col("side") == 0, F.col("key"))).alias("first"),
        F.collect_list(F.when(F.col("side") == 1, F.col("key"))).alias("second"))
    tables = both.select("node", "second", F.explode("first").alias("a")).select("node", "a", F.explode("second").alias("b")) \
        .select(F.xxhash64("a", "b").alias("bucket"), "node")
    return materialize(tables, "tables")


def sets_of(docs: DataFrame, nodes: DataFrame, text_col: str = "text", width: int = WORDS):
    """Function that adds ``size`` and ``elements`` to rows with a ``node``: the whole shingle set of one
    copy of the node's text.  ``nodes``: ``node``, ``k1``, ``k2``."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(*_text_key("text"), "text") \
        .groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def with_sets(wanted: DataFrame) -> DataFrame:
        kept = wanted.columns

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in sliced(batch, "text"):
                    sets = shingle_sets([t.as_py().encode() for t in part.column("text")], width)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([len(s) for s in sets], pa.int64()),
                                                      pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "size", "elements"])

        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema) + ", size long, elements binary"
        return texts.join(nodes.select("node", "k1", "k2").join(wanted, "node"), ["k1", "k2"]).select(*kept, "text").mapInArrow(shingle, ddl)

    return with_sets


def links(docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """``node``, ``comp`` of the linked nodes.  ``nodes``: ``node``, ``k1``, ``k2`` (key of one of its
    texts), ``first``, ``second``."""
    return clusters.links(buckets(nodes), sets_of(docs, nodes, text_col), SIMILAR)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row ``doc_id``, ``k1``, ``k2``, ``n_shingles``, ``digest`` (of its set, null if empty) and
    ``component_id`` (null where no row of its component has an id)."""
    rows = signatures(docs, id_col, text_col)
    classes = materialize(rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = materialize(rows.join(classes.select(F.col("node").alias("row")), "row")
                        .select(F.col("row").alias("node"), "k1", "k2", "first", "second"), "nodes")
    comps = materialize(links(docs, nodes, text_col), "components")
    linked = classes.join(comps, "node", "left").select("digest", "least", F.coalesce("comp", "node").alias("comp"))
    least = materialize(linked.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    named = materialize(linked.join(least, "comp").select("digest", "comp", "component_id"), "named")
    return rows.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")) \
        .join(named, "digest", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and
    ``kept`` (whether that is its own)."""
    own = F.coalesce("component_id", "doc_id")
    return _found(docs, id_col, text_col).select("doc_id", "n_shingles", own.alias("component_id"),
                                                 F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with the
    smallest id (rows without one stay only if no row has one) and, of several texts under that id,
    the one of the smallest text key.  Rows that repeat both stay together; rows without words
    are linked with nothing and stay."""
    found = _found(docs, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("one")
    kept = found.where("comp is not null").groupBy("comp").agg(best).select("one.doc_id", "one.k1", "one.k2") \
        .unionByName(found.where("comp is null").select("doc_id", "k1", "k2").distinct())
    kept = materialize(kept.toDF("kept_id", "kept_k1", "kept_k2"), "kept")
    k1, k2 = (k for k in _text_key(F.coalesce(docs[text_col], F.lit(""))))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["kept_id"]) & (k1 == kept["kept_k1"]) & (k2 == kept["kept_k2"]), "left_semi")
