"""Alignment of two tokenizations of the same texts by lockstep merging.

Both tokenizers cut the bytes of ``" " + text``.  The offsets at which tokens of
both end cut the two sequences into groups; the two tokens that end there are a
link.  Texts are taken in chunks of about ``CHUNK`` bytes.  One NumPy state
vector holds an A and a B pointer for every stretch of a chunk (a document is
one stretch, a long one several: the first token that ends behind a given byte
is found by bisection, so a stretch can start anywhere).  In each step all
pointers move past the smaller of their two ends, equal ends emit a link and a
cut, and finished stretches leave the vector.

How often an (A id, B id) pair is linked in the corpus is summed in Spark from
each chunk's distinct pairs; the totals come back to the chunk as a list no
longer than its own pairs, so a pair that every text has weighs one row per
chunk.

Edge cases: null or empty text, and texts whose joined token bytes differ from
``" " + text`` for either tokenizer (a normaliser changed them), have no tokens:
all counts 0 and an empty ``groups_sha256``; special-token strings in a text are
plain text; texts are encoded word by word (cut before a blank that follows
another character, where no token of either vocabulary goes across) through a
bounded table of known words; a text without blanks is one word; rows may
repeat, each is a document of its own; ties for a B id's highest count all count as best; null ids are
kept; an empty table gives an empty result; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import Recent, _byte_symbols, sliced

CHUNK = 2 << 20
KNOWN = 300_000  # words in one generation of a worker's table
STRETCH = 1024  # bytes of a text that one pair of pointers covers
_CUT = re.compile(r"(?<=\S)(?= )")


class Vocabularies:
    """The two tokenizers of a worker with the bytes of their tokens."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = {s: b for b, s in enumerate(_byte_symbols())}
        strings = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(strings.values()) + 1)
        for s, i in strings.items():
            self.a_bytes[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in v], dtype=np.int64) for v in (self.a_bytes, self.b_bytes))
        # no A token holds a blank behind another character (its pattern), and if no B token does,
        # texts fall apart before every blank that follows one
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = self.b.piece_to_id("▁")
        self.known = Recent(self._word, KNOWN)
        # what stands for a token in a group: not last / last of its side
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        self.shown = [b"%d%c" % (i, sign) for n, ends in ((n_a, b",|"), (n_b, b",;")) for sign in ends for i in range(n)]
        self.first_b = 2 * n_a

    def _word(self, word: str) -> tuple[bytes, bytes] | None:
        """Ids of a part of a text that starts with a blank, as packed integers; none where the
        tokens' bytes are not the part's."""
        a = self.a.encode(word, add_special_tokens=False).ids
        b = self.b.encode(word[1:]) if len(word) > 1 else [self.blank]
        data = word.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return np.array(a, np.int32).tobytes(), np.array(b, np.int32).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B; none where the tokens' bytes are not the text's."""
        words = _CUT.split(" " + text) if self.cuttable else [" " + text]
        found = list(map(self.known.__getitem__, words)) if text else [None]
        if None in found:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return tuple(np.frombuffer(b"".join([f[side] for f in found]), np.int32) for side in (0, 1))


_LOADED: dict[tuple, Vocabularies] = {}


def loaded(a_spec: str, b_model: bytes) -> Vocabularies:
    key = hashlib.sha1(a_spec.encode()).digest(), hashlib.sha1(b_model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabularies(a_spec, b_model)
    return _LOADED[key]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the A and B tokens that end together, in order.  Stretch k holds the ends in
    (low[k], high[k]]; all stretches advance at once."""
    i, i_stop, j, j_stop = (np.searchsorted(ends, at, side="right") for ends in (end_a, end_b) for at in (low, high))
    live = (i < i_stop) & (j < j_stop)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        if not live.all():
            i, i_stop, j, j_stop = i[live], i_stop[live], j[live], j_stop[live]
        if not len(i):
            break
        a, b = end_a[i], end_b[j]
        same = a == b
        links_a.append(i[same])
        links_b.append(j[same])
        i = i + (a <= b)
        j = j + (b <= a)
        live = (i < i_stop) & (j < j_stop)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def align(pairs: list[tuple[np.ndarray, np.ndarray]], vocab: Vocabularies, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """Links of several documents laid end to end: A and B ids, A and B index of each link, and
    how many links lie before each document."""
    a, b = (np.concatenate([np.zeros(0, np.int32), *side]) for side in zip(*pairs, strict=True))
    end_a, end_b = np.cumsum(vocab.a_size[a]), np.cumsum(vocab.b_size[b])
    size = np.array([int(vocab.a_size[p[0]].sum()) for p in pairs])
    stop = np.cumsum(size)
    per = -(-size // stretch)
    owner = np.repeat(np.arange(len(size)), per)
    low = (stop - size)[owner] + stretch * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
    high = np.minimum(low + stretch, stop[owner])
    i, j = lockstep(end_a, end_b, low, high)
    before = np.searchsorted(end_a[i], np.concatenate([[0], stop]), side="right")
    return a, b, i, j, before


def group_codes(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, vocab: Vocabularies) -> np.ndarray:
    """The tokens in the order of their groups, A side before B side, as indexes of ``shown``."""
    codes = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[i], last_b[j] = True, True
    at = np.arange(len(a))
    behind = np.concatenate([[0], j + 1])  # B tokens before each group
    codes[at + behind[np.searchsorted(i, at)]] = a + np.where(last_a, len(vocab.a_bytes), 0)
    at = np.arange(len(b))
    codes[at + (i + 1)[np.searchsorted(j, at)]] = vocab.first_b + b + np.where(last_b, len(vocab.b_bytes), 0)
    return codes


def groups_text(codes: np.ndarray, vocab: Vocabularies) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3`` in parts."""
    for at in range(0, len(codes), 1 << 20):
        part = b"".join(map(vocab.shown.__getitem__, codes[at:at + (1 << 20)].tolist()))
        yield part if at + (1 << 20) < len(codes) else part[:-1]


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("groups_sha256", pa.string()), ("kinds", pa.int32())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(_DOC)),
                    ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
_CHUNK_DDL = ("chunk long, pairs array<long>, counts array<long>, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, "
              "n_links: long, groups_sha256: string, kinds: int>>, at array<int>, times array<int>")


def _chunk_row(chunk: int, ids: list, texts: list[str], vocab: Vocabularies, stretch: int = STRETCH) -> dict:
    """One chunk: its distinct linked id pairs with counts, and per document which of them (``at``)
    it has how often (``times``)."""
    pairs = list(map(vocab.encode, texts))
    a, b, i, j, before = align(pairs, vocab, stretch)
    codes = group_codes(a, b, i, j, vocab)
    key, local, counts = np.unique(a[i].astype(np.int64) << 32 | b[j], return_inverse=True, return_counts=True)
    owner = np.searchsorted(before[1:], np.arange(len(i)), side="right")
    own, times = np.unique(owner * max(1, len(key)) + local, return_counts=True)
    kinds = np.bincount(own // max(1, len(key)), minlength=len(texts))
    docs, first = [], 0
    for k, (x, y) in enumerate(pairs):
        sha = hashlib.sha256()
        for part in groups_text(codes[first:first + len(x) + len(y)], vocab):
            sha.update(part)
        first += len(x) + len(y)
        n = int(before[k + 1] - before[k])
        docs.append({"doc_id": ids[k], "n_a": len(x), "n_b": len(y), "n_groups": n, "n_links": n,
                     "groups_sha256": sha.hexdigest() if n else "", "kinds": int(kinds[k])})
    return {"chunk": chunk, "pairs": key, "counts": counts, "docs": docs, "at": (own % max(1, len(key))).astype(np.int32),
            "times": times.astype(np.int32)}


def chunks(docs: DataFrame, a_spec: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """One row per chunk of documents; written."""
    spec = docs.sparkSession.sparkContext.broadcast((a_spec, b_model))
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(*spec.value)
        for batch in batches:
            for part in sliced(batch, "text", chunk_bytes):
                yield pa.RecordBatch.from_pylist([_chunk_row(part.column("row")[0].as_py(), part.column("doc_id").to_pylist(),
                                                             part.column("text").to_pylist(), vocab, stretch)], schema=_CHUNK)

    return materialize(src.mapInArrow(run, _CHUNK_DDL), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, ``n`` and ``best`` (whether it is its B id's highest count) over all chunks; written."""
    counted = materialize(rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
                          .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")), "pair-counts")
    side = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # at most one row per id of B's vocabulary
    top = counted.groupBy(side.alias("b")).agg(F.max("n").alias("most"))
    return materialize(counted.withColumn("b", side).join(F.broadcast(top), "b")
                       .select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-bests")


_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                     ("groups_sha256", pa.string())])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its links whose pair is best, and the counts of all its links."""
    for batch in batches:
        for row in range(batch.num_rows):
            docs = batch.column("docs")[row].values
            value = lambda c: batch.column(c)[row].values  # noqa: B023, E731
            found = value("found") if batch.column("found")[row].is_valid else None
            size = 0 if found is None else len(found)
            n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
            if size:
                place = found.field("at").to_numpy()
                n[place] = found.field("n").to_numpy()
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
            at, times = value("at").to_numpy(), value("times").to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(docs)), docs.field("kinds").to_numpy())
            sums = [np.zeros(len(docs), np.int64) for _ in range(2)]
            for out, values in zip(sums, (best, n), strict=True):
                np.add.at(out, owner, times * values[at])
            yield pa.RecordBatch.from_arrays(
                [*(docs.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), docs.field("groups_sha256")],
                schema=_RESULT)


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
                     b_path: str | None = None, chunk_bytes: int = CHUNK, stretch: int = STRETCH) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``,
    ``groups_sha256`` per row.  ``a_path``: a byte-level BPE file; ``b_path``: a sentencepiece model."""
    if not (a_path and b_path):
        import public_tokenizers

        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        rows = chunks(docs, a.read(), b.read(), id_col, text_col, chunk_bytes, stretch)
    known = pair_counts(rows)
    wanted = rows.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    found = wanted.join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "best")).alias("found"))
    return rows.select("chunk", "docs", "at", "times").join(found, "chunk", "left").select("docs", "at", "times", "found") \
        .mapInArrow(_sum_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
