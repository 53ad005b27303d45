"""BPE encoding and decoding of whole texts.

A word's symbols form a doubly linked list; a heap holds every adjacent pair
that has a merge, ordered by merge rank and then position.  Popping an entry
whose pair has changed meanwhile skips it.  Decoding joins the vocabulary
strings of the ids.

The vocabulary is a public JSON file (``vocab_path``), read on the driver and
broadcast: its size is fixed by the file.  Words repeat, so each Python worker
keeps a bounded table of the words it has met (two generations of at most
``CACHE_ENTRIES`` or of the ``entries`` asked for: a full one becomes the old one,
and what is used again is carried over).  A smaller table takes less memory and
more time; ids are the same.

Edge cases: null text counts as empty and has no ids; special-token strings
inside a text become their ids, as the public library does by default; very
long words cost n log n; letters and digits are those of the ``regex`` module's
Unicode version, so characters added in the very last version may be split
otherwise than an older library splits them; an empty table gives an empty result; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_ENTRIES = (1 << 20) * 2 // 3  # what a hash table of 2^20 places holds before it doubles
CACHED_LENGTH = 64
# White space of Unicode, as str.split takes it, but for these four control characters.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    table = {b: chr(b) for b in own}
    return [table.get(b) or chr(next(others)) for b in range(256)]


class Recent(dict):
    """Values by key, made by ``make`` when missing; at most two generations are kept."""

    def __init__(self, make, entries: int | None = None):
        super().__init__()
        self.make, self.old, self.entries = make, {}, entries

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > CACHED_LENGTH:
                return got
        if len(self) >= (self.entries or CACHE_ENTRIES):
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str, entries: int | None = None):
        conf = json.loads(spec)
        model = conf["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in vocab.items()}
        # a pair of ids as one integer -> merge rank; the suffix ends a word
        # only, so a merged string is the plain concatenation
        self.ranks: dict[int, int] = {}
        self.merged = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        symbols = _byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.final = [vocab.get(s + suffix) for s in symbols]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = conf["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pattern = regex.compile(split)
        self._known = Recent(self._chunk, entries)

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: merge the pair of lowest rank, leftmost first, until none has a merge."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        rank_of, merged = self.ranks.get, self.merged
        heap = []  # rank * n + position: lowest rank first, then leftmost
        left = ids[0] if ids else 0
        for at in range(1, n):
            right = ids[at]
            rank = rank_of(left << 32 | right)
            if rank is not None:
                heap.append(rank * n + at - 1)
            left = right
        if not heap:
            return ids
        heapq.heapify(heap)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        while heap:
            rank, at = divmod(heapq.heappop(heap), n)
            here, right = ids[at], nxt[at]
            if here is None or right >= n or rank_of(here << 32 | ids[right]) != rank:
                continue  # stale: one of the two symbols has changed
            ids[at], ids[right] = new, _ = merged[rank], None
            nxt[at] = after = nxt[right]
            if after < n:
                prv[after] = at
                rank = rank_of(new << 32 | ids[after])
                if rank is not None:
                    heapq.heappush(heap, rank * n + at)
            before = prv[at]
            if before >= 0:
                rank = rank_of(ids[before] << 32 | new)
                if rank is not None:
                    heapq.heappush(heap, rank * n + before)
        return [i for i in ids if i is not None]

    def _word(self, word: str) -> bytes:
        return array.array("I", self.word_ids(word.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a stretch without white space: normalise, lower, split, merge.  A
        word is a stretch of its own, so both share one table."""
        if chunk.isascii():
            lowered = chunk.lower()
            words = [lowered] if chunk.isalpha() else self._pattern.findall(lowered)
        else:
            # a capital sigma has one lower form here, wherever it stands
            words = self._pattern.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        if len(words) == 1 and words[0] == chunk:
            return self._word(chunk)
        return b"".join(map(self._known.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        # no pattern of the vocabulary crosses white space, so stretches between are independent
        chunks = [c for c in _SPACE.split(text) if c] if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self._known.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self._special or "<|" not in text or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at:m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, one blank between (the file names no decoder)."""
        return " ".join(map(self.strings.__getitem__, array.array("I", ids)))


_LOADED: dict[str, Bpe] = {}


def loaded(spec: str, entries: int | None = None) -> Bpe:
    """The worker's encoder for a vocabulary and table size; kept between tasks."""
    key = f"{hashlib.sha1(spec.encode()).hexdigest()}:{entries}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec, entries)
    return _LOADED[key]


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary(spark: SparkSession, vocab_path: str | None):
    with open(vocab_path or default_vocab(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` per row."""
    spec = vocabulary(docs.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for part in sliced(batch, "text"):
                ids = [bpe.encode(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return _sources(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


SLICE_BYTES = 4 << 20


def sliced(batch: pa.RecordBatch, col: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` (else ``SLICE_BYTES``) bytes of text each, a single row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * (size or SLICE_BYTES) / max(1, batch.column(col).nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def pieces(docs: DataFrame, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
           vocab_path: str | None = None, entries: int | None = None) -> DataFrame:
    """Token pieces of at most ``capacity``: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``; ``end_id`` follows the last token of each document.  ``entries``
    bounds a worker's word table."""
    spec = vocabulary(docs.sparkSession, vocab_path)
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value, entries)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py()) + end
                key = doc_id.as_py()
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return _sources(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")
