"""Personal data by exact patterns plus a character-level BiLSTM-CRF.

The base finds e-mail addresses, IP addresses, card and phone numbers by
pattern; its spans always stay.  The model - character embeddings, one LSTM in
each direction, CRF transitions, all in numpy - is trained from labelled spans
(the base's own, with some written in ways the patterns do not take) on a
bounded sample with a share for each kind.  It reads every stretch of every
text that can hold such data: each of the four kinds has a digit or an @, so
windows cover all characters within ``REACH`` of one.  Windows of ``WINDOW`` characters overlap by half; each
is decoded by Viterbi, spans cut off by a window's edge are left to its
neighbour, and of all spans of a text the heaviest set without overlaps is
kept.  A model span is added when it is confident, well-formed for its kind
and touches neither a base span nor a match that the base's checks turned down.

Edge cases: null text counts as empty; very long texts and very long runs of
digits or letters are read in linear time; rows may repeat and are read each;
without labelled spans the model adds nothing, and of a kind without any
nothing either (a warning names it); an empty table gives an empty result;
:func:`find` reads only the id and the text, :func:`mask` keeps every column.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import heapq
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import sliced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive digits: a shorter run can never be followed by what the pattern wants
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        # without a domain no other start before this @ can match; characters are walked once
        if domain:
            end = domain.end()
            yield start, end
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans by kind and start, and the stretches whose checks failed."""
    out: list[Span] = []
    failed = []
    if not _TRIGGER.search(text):
        return out, failed
    out += [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        out.append((1, *m.span())) if good else failed.append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0] if m[0].isdigit() else _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
        elif len(digits) > 12:
            failed.append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        good = 8 <= len(_DIGITS.sub("", m[0])) <= 15
        out.append((3, *m.span())) if good else failed.append(m.span())
    return out, failed


# ---- the model

WINDOW, REACH, HIDDEN, EMBED = 64, 24, 12, 12
TAGS = 1 + 2 * len(KINDS)  # outside, and begin / inside of each kind
TRAIN_DOCS = 600
TRAIN_BYTES = 1 << 16
TRAIN_WINDOWS = 600
CONFIDENT = 1.5  # mean log-odds of a span's tags against the text being outside
_SYMBOLS = 131  # ASCII, other letters, other characters, padding


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points, np.where((points < 0x250) | (points > 0x370), 128, 129))


def windows(text: str) -> list[int]:
    """Starts of the windows that cover every character near a digit or an @."""
    starts: list[int] = []
    covered = -1
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.start() + REACH)
        at = low if low > covered else None
        if at is not None:
            starts.append(at)
            covered = at + WINDOW - WINDOW // 2
        while covered < high and starts[-1] + WINDOW < len(text):
            starts.append(starts[-1] + WINDOW // 2)
            covered = starts[-1] + WINDOW - WINDOW // 2
    return starts


def window_codes(text: str, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), WINDOW), _SYMBOLS - 1, dtype=np.int64)
    for k, at in enumerate(starts):
        got = _codes(text[at:at + WINDOW])
        out[k, :len(got)] = got
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM emissions and CRF transitions; ``theta`` holds the weights."""

    def __init__(self, theta: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape)
        if theta is None:
            theta = {"emb": rng.normal(0, 1.0, (_SYMBOLS, EMBED)), "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS),
                     "trans": np.zeros((TAGS, TAGS))}
            for d in "fb":
                theta |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN)}
                theta[f"c{d}"][HIDDEN:2 * HIDDEN] = 1.0  # forget gates start open
        self.theta = theta
        # an inside tag follows the begin or inside of its own kind
        self.banned = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            for t in range(TAGS):
                if t not in (1 + 2 * k, 2 + 2 * k):
                    self.banned[t, 2 + 2 * k] = -1e4
        self.first = np.where(np.isin(np.arange(TAGS), [2 + 2 * k for k in range(len(KINDS))]), -1e4, 0.0)

    def _lstm(self, codes: np.ndarray, d: str, keep: bool):
        t = self.theta
        n, width = codes.shape
        inputs = (t["emb"] @ t[f"x{d}"] + t[f"c{d}"])
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        hs = np.empty((width, n, HIDDEN))
        saved = []
        for at in (range(width) if d == "f" else range(width - 1, -1, -1)):
            z = inputs[codes[:, at]] + h @ t[f"h{d}"]
            g = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
            u = np.tanh(z[:, 3 * HIDDEN:])
            before_h, before_c = h, c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            hs[at] = h
            if keep:
                saved.append((at, i, f, o, u, tc, before_h, before_c))
        return hs, saved

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(width, windows, tags)"""
        both = np.concatenate([self._lstm(codes, d, False)[0] for d in "fb"], axis=2)
        return both @ self.theta["out"] + self.theta["bias"]

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (windows, width) and per position the log-odds of the best tag against outside."""
        e = self.emissions(codes)
        width, n, _ = e.shape
        step = self.theta["trans"] + self.banned
        best = e[0] + self.first
        back = np.empty((width, n, TAGS), dtype=np.int8)
        for at in range(1, width):
            scores = best[:, :, None] + step
            back[at] = scores.argmax(1)
            best = scores.max(1) + e[at]
        tags = np.empty((n, width), dtype=np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for at in range(width - 1, 0, -1):
            tags[:, at - 1] = back[at][rows, tags[:, at]]
        odds = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - e[:, :, 0].T
        return tags, odds

    def loss_gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        t = self.theta
        n, width = codes.shape
        runs = {d: self._lstm(codes, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = both @ t["out"] + t["bias"]
        step = t["trans"] + self.banned
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = e[0] + self.first
        for at in range(1, width):
            s = alpha[at - 1][:, :, None] + step
            m = s.max(1)
            alpha[at] = m + np.log(np.exp(s - m[:, None]).sum(1)) + e[at]
        beta[-1] = 0
        for at in range(width - 2, -1, -1):
            s = step + (e[at + 1] + beta[at + 1])[:, None, :]
            m = s.max(2)
            beta[at] = m + np.log(np.exp(s - m[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        de = np.exp(alpha + beta - total[None, :, None])
        dtrans = np.zeros((TAGS, TAGS))
        rows = np.arange(n)
        gold = self.first[tags[:, 0]].copy()
        for at in range(width):
            gold += e[at, rows, tags[:, at]]
            de[at, rows, tags[:, at]] -= 1
            if at:
                gold += step[tags[:, at - 1], tags[:, at]]
                dtrans += np.exp(alpha[at - 1][:, :, None] + step + (e[at] + beta[at])[:, None, :] - total[:, None, None]).sum(0)
                np.subtract.at(dtrans, (tags[:, at - 1], tags[:, at]), 1)
        de /= n
        grads = {"trans": dtrans / n, "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "bias": de.sum((0, 1))}
        dboth = de @ t["out"].T
        demb = np.zeros_like(t["emb"])
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            gh, dzs = np.zeros_like(t[f"h{d}"]), np.empty((width, n, 4 * HIDDEN))
            for at, i, f, o, u, tc, before_h, before_c in reversed(runs[d][1]):
                dh = dh + part[at]
                dc = dc + dh * o * (1 - tc ** 2)
                dz = np.concatenate([dc * u * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u ** 2)], axis=1)
                dzs[at] = dz
                gh += before_h.T @ dz
                dh, dc = dz @ t[f"h{d}"].T, dc * f
            symbol = codes.T.ravel()
            gx = np.column_stack([np.bincount(symbol, col, _SYMBOLS) for col in dzs.reshape(-1, 4 * HIDDEN).T])
            grads |= {f"x{d}": t["emb"].T @ gx, f"c{d}": gx.sum(0), f"h{d}": gh}
            demb += gx @ t[f"x{d}"].T
        grads["emb"] = demb
        return float((total - gold).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 24, batch: int = 32, rate: float = 0.02, seed: int = 3) -> float:
        m, v = ({k: np.zeros_like(w) for k, w in self.theta.items()} for _ in range(2))
        rng, step, loss = np.random.default_rng(seed), 0, 0.0
        for epoch in range(epochs):
            order, loss = rng.permutation(len(codes)), 0.0
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                part, grads = self.loss_gradients(codes[pick], tags[pick])
                loss += part * len(pick) / len(order)
                step += 1
                size = np.sqrt(sum((g ** 2).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.theta[k] = self.theta[k] - rate * (0.5 ** (epoch / 8)) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return loss


def _labelled(text: str, spans: list[Span]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = windows(text)
    marks = np.zeros(len(text) + WINDOW, dtype=np.int64)
    for kind, s, e in spans:
        marks[s:e] = 2 + 2 * kind
        marks[s] = 1 + 2 * kind
    for code, at in zip(window_codes(text, starts), starts, strict=True):
        tags = marks[at:at + WINDOW].copy()
        if at and tags[0] >= 2 and tags[0] % 2 == 0:  # a span that began before the window
            tags[0] -= 1
        yield code, tags


def variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """The text itself, and one with every phone and card written in another way."""
    yield text, spans
    parts, moved, at = [], [], 0
    size = 0
    for k, (kind, s, e) in enumerate(sorted(spans, key=lambda x: x[1])):
        if s < at:
            return
        own = text[s:e]
        if kind == 3:
            own = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", own) or own
            own = own.replace(" ", "-") if k % 2 else own
        elif kind == 2 and own.isdigit():
            own = ".".join(own[i:i + 4] for i in range(0, len(own), 4))
        parts += [text[at:s], own]
        size += s - at
        moved.append((kind, size, size + len(own)))
        size += len(own)
        at = e
    if moved:
        yield "".join([*parts, text[at:]]), moved


def _drawn(src: DataFrame, share: int) -> list[int]:
    """Hashes of the sample: for each kind the ``share`` smallest of the texts with a base span of that
    kind, and as many of those without any.  ``src`` has the texts and their hashes ``h``."""
    schema = "kind int, h long"

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[int]] = [[] for _ in range(len(KINDS) + 1)]  # heaps of the negated hashes
        held: list[set[int]] = [set() for _ in best]
        for batch in batches:
            for text, h in zip(batch.column("text"), batch.column("h").to_pylist(), strict=True):
                if all(h in own or len(own) == share and h > -heap[0] for heap, own in zip(best, held, strict=True)):
                    continue
                for kind in {k for k, _, _ in base_spans(text.as_py())[0]} or {len(KINDS)}:
                    heap, own = best[kind], held[kind]
                    if h in own:
                        continue
                    own.add(h)
                    heapq.heappush(heap, -h)
                    if len(heap) > share:
                        own.remove(-heapq.heappop(heap))
        rows = [(k, h) for k, own in enumerate(held) for h in own]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([h for _, h in rows], pa.int64())], names=["kind", "h"])

    # a bounded number of hashes from each task
    found = materialize(src.mapInArrow(least, schema), "pii-sample")
    picked = [found.where(F.col("kind") == k).select("h").distinct().orderBy("h").limit(share) for k in range(len(KINDS) + 1)]
    return sorted({r["h"] for part in picked for r in part.collect()})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Tagger | None:
    """Fit on at most ``train_docs`` texts of at most ``TRAIN_BYTES`` bytes that hold a digit or an @:
    an equal share for each kind (those of the smallest hash that hold a base span of it), and one for
    texts without any.  Warns of kinds that no text has; None when there is no base span at all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(text.alias("text")).where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= TRAIN_BYTES)) \
        .select("text", F.xxhash64("text").alias("h"))
    # the hashes of the sample first, then only its texts
    hashes = _drawn(rows, max(1, train_docs // (len(KINDS) + 1)))
    if not hashes:
        return None
    # in the order of their hashes: windows beyond the bound are then left out evenly
    texts = [r["text"] for r in sorted(rows.where(F.col("h").isin(hashes)).dropDuplicates(["h"]).collect(), key=lambda r: (r["h"], r["text"]))]
    marked, plain = [], []
    for body in texts:
        spans, _ = base_spans(body)
        for version, own in variants(body, spans):
            for code, tag in _labelled(version, own):
                (marked if tag.any() else plain).append((code, tag))
    of_kind = [[w for w in marked if np.isin(w[1], (1 + 2 * k, 2 + 2 * k)).any()] for k in range(len(KINDS))]
    if missing := [name for name, own in zip(KINDS, of_kind, strict=True) if not own]:
        warnings.warn(f"PII model: no text of the sample has a base span of {', '.join(missing)}; the model cannot add this kind", stacklevel=2)
    if not marked:
        return None
    # a window of each kind in turn, so that a rare kind keeps all it has
    turns = [w for turn in zip_longest(*of_kind) for w in turn if w]
    picked = list({id(w): w for w in turns}.values())[:TRAIN_WINDOWS] + plain[:TRAIN_WINDOWS // 2]
    model = Tagger()
    model.fit(np.array([code for code, _ in picked]), np.array([tag for _, tag in picked]))
    return model


def decoded(model: Tagger, text: str) -> list[tuple[float, Span]]:
    """Confident spans of all windows, reconciled over the whole text: the heaviest set without overlaps."""
    starts = windows(text)
    found: dict[Span, float] = {}
    for lo in range(0, len(starts), 256):
        part = starts[lo:lo + 256]
        tags, odds = model.decode(window_codes(text, part))
        for k, at in enumerate(part):
            if not tags[k].any():
                continue
            width = min(WINDOW, len(text) - at)
            begins = [p for p in range(width) if tags[k, p] % 2 == 1]
            for b in begins:
                kind, e = (int(tags[k, b]) - 1) // 2, b + 1
                while e < width and tags[k, e] == 2 + 2 * kind:
                    e += 1
                if (b == 0 and at > 0) or (e == width and at + width < len(text)):
                    continue  # cut off: a neighbouring window has it whole
                weight = float(odds[k, b:e].mean())
                if weight >= CONFIDENT:
                    span = (kind, at + b, at + e)
                    found[span] = max(found.get(span, 0.0), weight * (e - b))
    order = sorted(found, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    best, take = [0.0], []
    for i, s in enumerate(order):
        before = bisect_right(ends, s[1], hi=i)
        use = best[before] + found[s]
        take.append(before if use > best[-1] else -1)
        best.append(max(best[-1], use))
    out, i = [], len(order)
    while i:
        if take[i - 1] >= 0:
            out.append((found[order[i - 1]], order[i - 1]))
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


_FORM = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"), re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
         re.compile(r"[0-9](?:[ .-]?[0-9]){12,18}"), re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){8,14}"))


def added_spans(model: Tagger, text: str, base: list[Span], failed: list[tuple[int, int]]) -> list[Span]:
    taken = [(s, e) for _, s, e in base] + failed
    out = []
    for _, (kind, s, e) in decoded(model, text):
        own = text[s:e]
        if any(s < y and x < e for x, y in taken) or not _FORM[kind].fullmatch(own):
            continue
        if kind == 3 and not re.search("[ ().-]", own) or kind == 2 and not luhn(_DIGITS.sub("", own)):
            continue
        if (s and (text[s - 1].isalnum() or text[s - 1] in "=\"'_-./+")) or (e < len(text) and text[e].isalnum()):
            continue  # part of a longer word or number
        out.append((kind, s, e))
    return out


def all_spans(text: str, model: Tagger | None) -> tuple[list[Span], list[Span]]:
    base, failed = base_spans(text)
    more = added_spans(model, text, base, failed) if model and _TRIGGER.search(text) else []
    return base, sorted(base + more)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, base counts ``n_<kind>``, ``base`` and ``spans`` as kind:start:end lists."""
    theta = docs.sparkSession.sparkContext.broadcast(model.theta if model else None)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(theta.value) if theta.value else None
        for batch in batches:
            for part in sliced(batch, "text"):
                counts, base, spans = [[] for _ in KINDS], [], []
                for text in part.column("text"):
                    own, every = all_spans(text.as_py(), tagger)
                    for k, c in enumerate(counts):
                        c.append(sum(s[0] == k for s in own))
                    base.append(listed(own))
                    spans.append(listed(every))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                    names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """Each stretch of spans (overlapping ones together) replaced by its kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; all columns stay (null texts too)."""
    theta = docs.sparkSession.sparkContext.broadcast(model.theta if model else None)

    @F.pandas_udf("string")
    def cleaned(texts):
        tagger = Tagger(theta.value) if theta.value else None
        return texts.map(lambda t: t if t is None else masked(t, all_spans(t, tagger)[1]))

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


