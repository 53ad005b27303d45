"""Licence scan: normalised text against licence templates by Dice coefficient.

Every line of a document, and the document as a whole, is a unit.  A unit is
lower-cased (A-Z), stripped of everything but letters and digits, and cut into
the set of its word bigrams.  Its Dice coefficient with a template of n bigrams
can reach the threshold t only if its own number of bigrams lies between
n * t / (2 - t) and n * (2 - t) / t: other templates are not compared.

A notice that wraps over lines, or stands in a line with other words, is found
by windows: every stretch of a text's words, across line ends, of at most
n * (2 - t) / t + 1 words is compared with the template of n bigrams.  Of all
windows that share no word with a unit that matches, the best is taken (dice,
then the earlier template, the earlier end, the later start), then the best of
those that share no word with it, and so on.  Templates are one-line notices
and the licence texts under ``license_texts``.

Words are hashed per Arrow batch; a window that matches holds n * t / (2 - t)
different bigrams of its template, so only stretches as dense as that are
compared, on the words themselves.  One scan; nothing is shuffled.

Edge cases: null text counts as empty; a unit of one word has no bigram and
matches nothing; of equally good matches the earlier template, then the
earlier unit, is reported; rows may repeat and are reported each; an empty
table gives an empty result; columns other than the id and the text are not
read.
"""

from __future__ import annotations

import heapq
import pkgutil
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import sliced

# Notices by which public licences are applied to a work.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
}
# Whole licence texts; a line of its own or a wrapped notice is matched by the notices above.
TEXTS = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "CC-BY-SA-4.0")
TEMPLATES |= {f"{name}-full": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in TEXTS}
# The threshold as a share of hundredths, so that comparisons are exact.
THRESHOLD = 80

# Bytes of words, lower-cased; 0 for all others.
_CODES = np.zeros(256, dtype=np.uint8)
_CODES[[*range(48, 58), *range(97, 123)]] = [*range(48, 58), *range(97, 123)]
_CODES[65:91] = _CODES[97:123]
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Numbers of bigrams that can reach the threshold against a template of n."""
    return -(-n * threshold // (200 - threshold)), n * (200 - threshold) // threshold


class _Matcher:
    """The templates as tables of word and bigram hashes, and the comparison of a batch of texts."""

    def __init__(self, templates: dict[str, str], threshold: int):
        self.grams = [frozenset(tuple(g.split(" ")) for g in bigrams(t)) for t in templates.values()]
        self.bounds = [size_bounds(len(g), threshold) for g in self.grams]
        self.least = threshold / 100
        vocabulary = sorted({w for g in self.grams for pair in g for w in pair})
        self.longest = max(map(len, vocabulary), default=0)
        data = np.frombuffer("".join(vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        hashes = self._hashes(_CODES[data], ends - np.diff(ends, prepend=0), ends)
        order = np.argsort(hashes)
        self.words, at = hashes[order], {vocabulary[j]: k for k, j in enumerate(order)}
        pairs = sorted({at[a] * len(at) + at[b] for g in self.grams for a, b in g})
        self.pairs = np.array(pairs, dtype=np.int64)
        self.member = np.zeros((len(pairs), len(self.grams)), dtype=bool)
        row = {p: k for k, p in enumerate(pairs)}
        for k, g in enumerate(self.grams):
            self.member[[row[at[a] * len(at) + at[b]] for a, b in g], k] = True

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of words; 0 for those longer than any of the templates."""
        size = ends - starts
        out = np.where(size <= self.longest, size, 0).astype(np.uint64)
        left = np.flatnonzero(size <= self.longest)
        for k in range(self.longest):
            left = left[size[left] > k]
            out[left] = (out[left] + codes[starts[left] + k]) * _PRIME
            out[left] ^= out[left] >> np.uint64(29)
        return out

    def dice(self, own: set, k: int) -> float:
        low, high = self.bounds[k]
        return 2 * len(own & self.grams[k]) / (len(own) + len(self.grams[k])) if low <= len(own) <= high else 0.0

    def find(self, texts: pa.Array) -> list[list[tuple[float, int, int]]]:
        """Per text its matches: dice, template, unit (lines from 0, the number of lines for the whole text; a window has the line it begins in)."""
        out: list[list[tuple[float, int, int]]] = [[] for _ in range(len(texts))]
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if not self.grams or offsets[-1] == offsets[0]:
            return out
        data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        codes = _CODES[data]
        inside = codes > 0
        cut = offsets[:-1][np.diff(offsets) > 0]  # a word ends with its text
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[cut] = inside[cut]
        last[cut[1:] - 1] = inside[cut[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts) < 2:
            return out
        hashes = self._hashes(codes, starts, ends)
        ids = np.searchsorted(self.words, hashes)
        ids[ids == len(self.words)] = 0
        known = self.words[ids] == hashes
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        spot = np.flatnonzero(known[:-1] & known[1:] & (text_of[:-1] == text_of[1:]))
        keys = ids[spot] * len(self.words) + ids[spot + 1]
        pair = np.searchsorted(self.pairs, keys)
        pair[pair == len(self.pairs)] = 0
        good = self.pairs[pair] == keys
        spot, pair = spot[good], pair[good]
        if not len(spot):
            return out
        breaks = np.flatnonzero(data == 10)
        # lines of all texts, numbered through
        line_of = np.searchsorted(breaks, starts) + text_of
        first_line = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(texts))
        n_lines = np.diff(np.append(first_line, len(breaks) + len(texts)))
        spelled: dict[int, bytes] = {}

        def pairs_of(lo: int, hi: int) -> list[tuple[str, str]]:
            """Bigrams that begin at the words lo to hi - 1."""
            w = [spelled.get(i) or spelled.setdefault(i, codes[starts[i]:ends[i]].tobytes().decode()) for i in range(lo, hi + 1)]
            return list(zip(w, w[1:]))

        lined = line_of[spot] == line_of[spot + 1]
        plain = n_lines[text_of[spot]] > 1
        taken: dict[int, list[tuple[int, int]]] = {}  # words of the units that match, by text
        for of, use in ((line_of, lined), (text_of, plain)):
            places, tried = self._places(of[spot[use]], pair[use]), {}
            for place, k in places:
                tried.setdefault(place, []).append(k)
            for place, ks in sorted(tried.items()):
                lo, hi = np.searchsorted(of, [place, place + 1])
                most, own = max(self.bounds[k][1] for k in ks), set()
                for at in range(lo, hi - 1, 256):
                    own.update(pairs_of(at, min(at + 256, hi - 1)))
                    if len(own) > most:
                        break
                best = min((-self.dice(own, k), k) for k in ks)
                if -best[0] >= self.least:
                    doc = int(text_of[lo])
                    out[doc].append((-best[0], best[1], int(place - first_line[doc]) if of is line_of else int(n_lines[doc])))
                    taken.setdefault(doc, []).append((int(lo), int(hi)))
        regions: dict[int, list[tuple[int, int, int]]] = {}
        for k, (low, high) in enumerate(self.bounds):
            p = spot[self.member[pair, k]]
            if len(p) < low or not low:
                continue
            p = p[:len(p) - low + 1][(p[low - 1:] - p[:len(p) - low + 1] < high) & (text_of[p[low - 1:]] == text_of[p[:len(p) - low + 1]])]
            for group in np.split(p, np.flatnonzero(np.diff(p) > high) + 1) if len(p) else ():
                doc = int(text_of[group[0]])
                for g in (np.split(group, np.flatnonzero(np.diff(text_of[group])) + 1) if doc != text_of[group[-1]] else (group,)):
                    doc = int(text_of[g[0]])
                    end = int(np.searchsorted(text_of, doc, side="right"))
                    regions.setdefault(doc, []).append((k, int(g[0]), min(int(g[-1]) + high, end - 1)))
        for doc, parts in regions.items():
            for dice, k, lo in self._windows(parts, taken.get(doc, []), pairs_of):
                out[doc].append((dice, k, int(line_of[lo] - first_line[doc])))
        return out

    def _places(self, place: np.ndarray, pair: np.ndarray) -> list[tuple[int, int]]:
        """Places with as many different bigrams of a template as its least unit has."""
        if not len(place):
            return []
        seen = np.unique(place * len(self.pairs) + pair)
        place, pair = seen // len(self.pairs), seen % len(self.pairs)
        out = []
        for k, (low, _) in enumerate(self.bounds):
            at, n = np.unique(place[self.member[pair, k]], return_counts=True)
            out += [(int(x), k) for x in at[n >= max(1, low)]]
        return out

    def _windows(self, parts: list[tuple[int, int, int]], taken: list[tuple[int, int]], pairs_of) -> Iterator[tuple[float, int, int]]:
        """Best windows without common words: dice, template, first word.  parts: templates, and the stretch of bigrams to look at."""
        heap: list[tuple[float, int, int, int]] = []
        taken = sorted(taken)
        for k, lo, hi in parts:
            for a, b in _free(lo, hi, taken):
                heap += [(-dice, k, end, -start) for dice, end, start in self._ends(k, a, b, pairs_of)]
        heapq.heapify(heap)
        while heap:
            dice, k, end, start = heapq.heappop(heap)
            start = -start
            near = bisect_left(taken, (end + 2,))  # taken stretches share no word
            after = taken[near - 1][1] if near else 0
            if after <= start:
                taken.insert(near, (start, end + 2))
                yield -dice, k, start
                continue
            if after <= end:  # the window's end is free: its best start after what was taken
                for d, e, s in self._ends(k, after, end + 1, pairs_of, only=end):
                    heapq.heappush(heap, (-d, k, e, -s))

    def _ends(self, k: int, lo: int, hi: int, pairs_of, only: int | None = None) -> Iterator[tuple[float, int, int]]:
        """For the bigrams lo to hi - 1, per end that belongs to the template: the best window (the latest start), if it matches."""
        (low, high), grams, n = self.bounds[k], self.grams[k], len(self.grams[k])
        if only is not None:
            lo = max(lo, only - high + 1)
        if hi - lo < low:
            return
        own = pairs_of(lo, hi)
        if len(grams.intersection(own)) < low:
            return
        shared, size = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        before: dict[tuple[str, str], int] = {}
        for j, g in enumerate(own):
            a = max(before.get(g, -1) + 1, j - high + 1)
            before[g] = j
            size[a:j + 1] += 1
            if g not in grams:
                continue
            shared[a:j + 1] += 1
            if only is not None and lo + j != only:
                continue
            a = max(0, j - high + 1)
            dice = 2 * shared[a:j + 1] / (size[a:j + 1] + n)
            best = j - int(dice[::-1].argmax())
            if dice[best - a] >= self.least:
                yield float(dice[best - a]), lo + j, lo + best


def _free(lo: int, hi: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of the bigrams lo to hi - 1 both of whose words are free."""
    for a, b in taken:
        if b <= lo or a > hi:
            continue
        if lo < a - 1:
            yield lo, a - 1
        lo = max(lo, b)
    if lo < hi:
        yield lo, hi


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         threshold: int = THRESHOLD) -> DataFrame:
    """Per row: ``doc_id``, ``n_matches`` (units and windows that match some template), ``license`` (of the
    best match), ``dice`` (rounded to 6 places), ``unit`` (its line from 0, -1 for the whole text; for a
    window the line in which it begins)."""
    names = list(templates or TEMPLATES)
    matcher = docs.sparkSession.sparkContext.broadcast(_Matcher(templates or TEMPLATES, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                texts = part.column("text")
                cols: list[list] = [[], [], [], []]
                for text, hits in zip(texts, matcher.value.find(texts), strict=True):
                    dice, k, unit = min(hits, key=lambda h: (-h[0], h[1], h[2])) if hits else (None, None, None)
                    whole = bool(hits) and unit > 0 and unit == text.as_py().count("\n") + 1
                    for col, value in zip(cols, (len(hits), names[k] if hits else None, dice, -1 if whole else unit), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True))],
                    names=["doc_id", "n_matches", "license", "dice", "unit"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_matches long, license string, dice double, unit long")
    return found.withColumn("dice", F.round("dice", 6))
