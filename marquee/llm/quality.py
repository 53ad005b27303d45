"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_BYTES`` bytes each, all of the
text).  Every passage is encoded from its own bytes; gated attention learned
from the document labels weighs the encodings; the weighted sum is scored.

    h = tanh(E x);  a = w . (tanh(V h) * sigmoid(U h));  z = sum softmax(a) h
    score = sigmoid(c . z + c0)

Training uses at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes and ``TRAIN_PASSAGES`` passages together (those of the
smallest hash of the id; of several texts under one id the smallest), so what
reaches the driver has a fixed size; the features of the sample are computed in
tasks and the small model is fitted in numpy.  Scoring covers every whole text:
texts are read in slices of ``SLICE`` bytes and leave two numbers per passage.  No id, language, source or label enters a score.

Edge cases: null text counts as empty (one empty passage); several labels of
one document: the largest; a null id is never a training row and not held
out; rows may repeat and are scored each; without usable labels every score
is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import free_name

PASSAGE_BYTES = 512
TRAIN_DOCS = 4000
TRAIN_BYTES = 1 << 20
TRAIN_PASSAGES = 40_000
THRESHOLD = 0.3
FOLDS = 5
SLICE = PASSAGE_BYTES * 1024
GRAM, BINS = 6, 512


def _class_table() -> np.ndarray:
    """Twelve classes of bytes: blank, line end, lower, upper, digit, six groups of signs, beyond ASCII."""
    table = np.full(256, 10, dtype=np.int32)
    groups = [b" ", b"\n\r\t\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)),
              b".", b",;:'\"-", b"!?", b"|/\\_<>[]{}()", b"@#$%^&*+=~`"]
    for k, group in enumerate(groups):
        table[list(group)] = k
    table[128:] = 11
    return table


CLASSES = 12
_CLASS = _class_table()
WIDTH = CLASSES * CLASSES + 3


def features(data: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Features of ``n`` passages; byte i of ``data`` belongs to passage ``passage[i]``:
    shares of pairs of byte classes, share of distinct grams, logarithms of the length."""
    size = np.bincount(passage, minlength=n).astype(np.float64)
    kinds = _CLASS[data]
    same = passage[1:] == passage[:-1]
    pair = passage[:-1] * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
    counts = np.bincount(pair[same], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    grams = np.zeros(max(0, len(data) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        grams = grams * np.uint64(1_000_003) + data[k:k + len(grams)].astype(np.uint64)
    grams ^= grams >> np.uint64(17)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    whole = passage[GRAM - 1:] == passage[:len(grams)] if len(grams) else np.zeros(0, bool)
    slot = passage[:len(grams)] * BINS + (grams >> np.uint64(55)).astype(np.int32)
    filled = np.zeros(n * BINS, dtype=bool)
    filled[slot[whole]] = True
    room = np.maximum(size - GRAM + 1, 0)
    expected = BINS * (1 - np.exp(-room / BINS))
    distinct = np.where(room > 0, filled.reshape(n, BINS).sum(1) / np.maximum(expected, 1e-9), 1.0)
    return np.column_stack([np.sqrt(counts / np.maximum(size - 1, 1)[:, None]), distinct, distinct ** 2,
                            np.log1p(size) / 6.0])


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of at most about ``SLICE`` bytes: data, passage of each byte, text of each passage."""
    parts, owner, held = [], [], 0

    def flush():
        size = np.array([len(p) for p in parts], dtype=np.int64)
        per = np.maximum(1, -(-size // PASSAGE_BYTES))
        first = np.cumsum(per) - per
        start = np.repeat(np.cumsum(size) - size, size)
        passage = (np.repeat(first, size) + (np.arange(size.sum()) - start) // PASSAGE_BYTES).astype(np.int32)
        return np.frombuffer(b"".join(parts), np.uint8), passage, np.repeat(np.array(owner), per)

    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), SLICE):
            parts.append(text[at:at + SLICE])
            owner.append(k)
            held += len(parts[-1]) + 64
            if held >= SLICE:
                yield flush()
                parts, owner, held = [], [], 0
    if parts:
        yield flush()


def text_features(text: bytes) -> np.ndarray:
    return np.vstack([features(d, p, len(o)) for d, p, o in _blocks([text])])


class Attention:
    """The model; ``theta`` holds its weights."""

    HIDDEN, GATE = 24, 12

    def __init__(self, theta: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.theta = theta or {
            "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "E": draw(WIDTH, self.HIDDEN), "b": np.zeros(self.HIDDEN),
            "V": draw(self.HIDDEN, self.GATE), "U": draw(self.HIDDEN, self.GATE), "w": draw(self.GATE), "c": np.zeros(self.HIDDEN),
            "c0": np.zeros(1)}

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention and contribution to the logit of each passage."""
        t = self.theta
        h = np.tanh(((x - t["mean"]) * t["scale"]) @ t["E"] + t["b"])
        gate = np.tanh(h @ t["V"]) / (1 + np.exp(-(h @ t["U"])))
        return gate @ t["w"], h @ t["c"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01,
            decay: float = 1e-4, seed: int = 11) -> None:
        t = self.theta
        every = np.vstack(bags)
        t["mean"], t["scale"] = every.mean(0), 1 / (every.std(0) + 0.02)
        bags = [(b - t["mean"]) * t["scale"] for b in bags]
        names = ["E", "b", "V", "U", "w", "c", "c0"]
        m, v = ({k: np.zeros_like(t[k]) for k in names} for _ in range(2))
        rng, step = np.random.default_rng(seed), 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                grads = self._gradients([bags[i] for i in pick], labels[pick])
                step += 1
                for k in names:
                    g = grads[k] + decay * t[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    t[k] = t[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def _gradients(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        t = self.theta
        size = np.array([len(b) for b in bags])
        first = np.cumsum(size) - size
        bag = np.repeat(np.arange(len(bags)), size)
        x = np.vstack(bags)
        h = np.tanh(x @ t["E"] + t["b"])
        tv, su = np.tanh(h @ t["V"]), 1 / (1 + np.exp(-(h @ t["U"])))
        a = (tv * su) @ t["w"]
        e = np.exp(a - np.maximum.reduceat(a, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-(z @ t["c"] + t["c0"])))
        dlogit = (p - y) / len(bags)
        dz = dlogit[:, None] * t["c"]
        dh = alpha[:, None] * dz[bag]
        dalpha = (dz[bag] * h).sum(1)
        da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, first)[bag])
        dgate = da[:, None] * t["w"]
        dtv, dsu = dgate * su * (1 - tv ** 2), dgate * tv * su * (1 - su)
        dh += dtv @ t["V"].T + dsu @ t["U"].T
        dpre = dh * (1 - h ** 2)
        return {"E": x.T @ dpre, "b": dpre.sum(0), "V": h.T @ dtv, "U": h.T @ dsu, "w": da @ (tv * su),
                "c": z.T @ dlogit, "c0": np.array([dlogit.sum()])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; per passage only two numbers are kept."""
        owner, att, con = [], [], []
        for data, passage, text in _blocks(texts):
            a, s = self.passages(features(data, passage, len(text)))
            owner.append(text)
            att.append(a)
            con.append(s)
        owner, att, con = (np.concatenate(z) for z in (owner, att, con))
        first = np.searchsorted(owner, np.arange(len(texts)))
        e = np.exp(att - np.maximum.reduceat(att, first)[owner])
        logit = np.add.reduceat(e * con, first) / np.add.reduceat(e, first) + self.theta["c0"]
        return 1 / (1 + np.exp(-logit))


def _fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          train_docs: int = TRAIN_DOCS) -> Attention:
    """Fit on labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").where(_fold(F.col("doc_id")) != 0) \
        .groupBy("doc_id").agg(F.max("quality").alias("label"))
    # at most train_docs rows, so the broadcast is bounded
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).withColumnRenamed("doc_id", "label_id")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .where(F.octet_length("text") <= TRAIN_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                held = io.BytesIO()
                np.save(held, text_features(text.as_py().encode()).astype(np.float32))
                found.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())],
                                             names=["doc_id", "label", "bag"])

    picked = materialize(src.join(F.broadcast(sample), src["doc_id"] == sample["label_id"])
                         .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
                             F.max("label").cast("int").alias("label"), F.min("text").alias("text")), "training-texts")
    # at most train_docs rows in one window
    held = F.sum(F.ceil(F.greatest(F.octet_length("text"), F.lit(1)) / PASSAGE_BYTES)).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    room = picked.select(F.col("doc_id").alias("label_id"), held.alias("held")).where(F.col("held") <= TRAIN_PASSAGES)
    chosen = picked.join(F.broadcast(room), picked["doc_id"] == room["label_id"]).select("doc_id", "label", "text")
    rows = chosen.mapInArrow(run, "doc_id long, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    model = Attention()
    if rows:
        model.fit([np.load(io.BytesIO(bytes(r["bag"]))).astype(np.float64) for r in rows], np.array([r["label"] for r in rows], float))
    return model


def score(docs: DataFrame, model: Attention, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score column added, row by row."""
    theta = docs.sparkSession.sparkContext.broadcast(model.theta)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        fitted = Attention(theta.value)
        out, held, size = [np.zeros(0)], [], 0
        for text in texts:
            held.append(text.encode())
            size += len(held[-1]) + 64
            if size >= SLICE:
                out.append(fitted.score(held))
                held, size = [], 0
        return pd.Series(np.concatenate([*out, fitted.score(held)] if held else out))

    return docs.withColumn(out_col, scored(F.coalesce(F.col(text_col), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row."""
    model = train(docs, labels, id_col, text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(src, model).select(
        "doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    name = free_name(docs, "_quality")
    return score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) >= threshold).drop(name)
