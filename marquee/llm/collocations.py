"""Phrase collocations from FM-indexes over word ids.

Texts become sequences of shard-local word ids (0 between pieces); a shard
holds at most about ``SHARD`` bytes of one language, so a language of any size
is many shards.  Words are counted over all shards first; a phrase can be
frequent only if its words are, so in each shard the others become breaks (its
dictionary comes back from Spark with the words that stay).

Per shard two FM-indexes are built, of the sequence and of its reverse.  Their
rows are sorted by the first ``DEPTH`` symbols only: the interval of a pattern
of at most that many symbols is then exact.  A phrase is a pair of intervals,
one in each index; a left extension reads the BWT symbols inside its forward
interval, a right extension those inside its reverse interval, and the other
interval follows from the symbols below.  All phrases of a length are extended
at once: words to the left into pairs, pairs to the right into triples, and so
on in turns.  The counts (interval sizes) of all shards are summed in Spark,
pre-aggregated before the shuffle, so no shard decides what is frequent.  The
lengths are counted one after the other: a phrase is left out when a shorter
one inside is not in the bit filter of the frequent ones.  That filter has a
fixed size and no false negatives; full, it lets everything pass.

Frequent words are numbered by count (fewer than 2**31 of them; the cast fails
otherwise).  Scores are exact: products in decimals of 38 digits (counts below 10**15),
then integer division.

Edge cases: null text counts as empty, a null language as ``und``; very long
texts are cut into shards at any piece, so no phrase is lost (a piece is never
split, a shard holds one at least); rows may repeat and count each; ties are
ordered by score, count and phrase (UTF-8 bytes); an empty table, or one
without candidates, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ordered_index
from ..session import materialize, scratch_path
from .bpe import sliced

DEPTH = 3  # words of the longest phrase
LEAST = 10  # occurrences of a candidate
COVERED = 50  # hundredths of a phrase's count at which a longer one replaces it
TOP = 2000
SHARD = 8 << 20
FILTER_BITS = 1 << 26  # of the filter of frequent shorter phrases that tasks get: 8 MB

# A-Z become lower case, the signs and line ends that end a piece a comma, tab a blank;
# what bytes.split takes as white space is then blanks only
_TABLE = bytes(ord(",") if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words(dict):
    """Ids of words from 1 on, in order of first use; 0 ends a piece."""

    def __init__(self):
        super().__init__({b",": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Shard:
    """Word ids of the texts of one language."""

    def __init__(self):
        self.ids, self.parts = Words(), []

    def add(self, text: bytes) -> None:
        words = text.translate(_TABLE).replace(b",", b" , ").split()
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))

    def row(self, lang: str, at: int) -> dict:
        seq = np.concatenate(self.parts)
        counts = np.bincount(seq, minlength=len(self.ids))[1:]
        return {"shard": at, "lang": lang, "words": [w.decode() for w in self.ids][1:], "counts": counts, "seq": seq.tobytes()}


_PIECE_END = (b".", b"\n", b",")


def _stretches(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text cut behind signs that end a piece."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(sign, at, at + limit) for sign in _PIECE_END) + 1
        if cut <= at:  # a piece longer than a shard stays whole
            cut = min((c + 1 for c in (text.find(sign, at + limit) for sign in _PIECE_END) if c >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def _shard_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                            ("seq", pa.binary())])
        held: dict[str, Shard] = {}
        size = made = 0
        first = None

        def flush():
            nonlocal made
            rows = []
            for lang, shard in held.items():
                rows.append(shard.row(lang, first + made))
                made += 1
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for part in sliced(batch, "text"):
                first = part.column("row")[0].as_py() if first is None else first
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                    for stretch in _stretches(text, limit) if len(text) > limit else (text,):
                        if size and size + len(stretch) > limit:
                            yield flush()
                            size = 0
                        held.setdefault(lang, Shard()).add(stretch)
                        size += len(stretch) + 1
        if held:
            yield flush()

    return run


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD) -> DataFrame:
    """``shard``, ``lang``, ``words``, ``counts``, ``seq`` of all texts; written.  The ids of the shards
    of a task follow its first row's, so they are distinct."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _packed(src.mapInArrow(_shard_rows(shard_bytes), "shard long, lang string, words array<string>, counts array<long>, seq binary"), "shards")


def _packed(df: DataFrame, name: str) -> DataFrame:
    """Written like ``materialize``, but with zstd: word ids are small numbers in wide integers."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


class Index:
    """FM-index of a sequence whose rows are sorted by their first ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, depth: int):
        n = len(seq)
        padded = np.concatenate([seq, np.zeros(depth, seq.dtype)])
        order = np.arange(n, dtype=np.int32)
        for k in reversed(range(depth)):
            order = order[np.argsort(padded[k:k + n][order], kind="stable")]
        self.bwt = seq[order - 1]  # the sequence starts with 0, so the symbol before its start is a break
        self.first = np.searchsorted(seq[order], np.arange(int(seq.max()) + 2))
        # LF: row of the suffix that begins one symbol earlier
        by_symbol = np.argsort(self.bwt, kind="stable")
        self.lf = np.empty(n, np.int32)
        self.lf[by_symbol] = np.arange(n, dtype=np.int32)

    def extend(self, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """Extensions of patterns by the symbols before them.  ``start``, ``size``: their intervals;
        ``other``: starts of their intervals in the index of the reverse.  Returns per extension
        the pattern, the symbol, start, size and the start in the other index; breaks are left out."""
        owner = np.repeat(np.arange(len(start), dtype=np.int32), size)
        row = np.arange(len(owner), dtype=np.int32) + np.repeat((start - np.cumsum(size) + size).astype(np.int32), size)
        # by pattern, then symbol; equal ones stay in row order
        order = np.argsort(owner.astype(np.int64) * (len(self.first) + 1) + self.bwt[row], kind="stable").astype(np.int32)
        owner, row = owner[order], row[order]
        symbol = self.bwt[row]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])) if len(owner) else \
            np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(owner)]]))
        owner, symbol = owner[new], symbol[new]
        # smaller symbols of the same pattern (and breaks) come first in the other index
        below = new - (np.cumsum(size) - size)[owner]
        keep = symbol > 0
        return tuple(x[keep] for x in (owner, symbol, self.lf[row[new]], count, other[owner] + below))


def _slots(words: np.ndarray) -> np.ndarray:
    """Bit of each phrase (a row of word ids) in a filter of ``FILTER_BITS``."""
    h = np.full(len(words), np.uint64(words.shape[1]))
    for k in range(words.shape[1]):
        h = (h ^ words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = _slots(words)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def phrases(seq: np.ndarray, length: int, filters: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words (a row per phrase) and counts of all phrases of ``length`` symbols without breaks, but
    for those that hold a shorter phrase which ``filters`` (bits by length) rule out."""
    filters = filters or {}
    symbols, seq = np.unique(np.concatenate([[0], seq, [0]]), return_inverse=True)
    seq = seq.astype(np.int32)
    forward, reverse = Index(seq, length), Index(seq[::-1].copy(), length)
    words = np.arange(1, len(symbols), dtype=np.int32)
    start = forward.first[words]
    size = forward.first[words + 1] - start
    found, ahead, back = words[:, None], start, reverse.first[words]
    for n in range(2, length + 1):
        if n % 2 == 0:
            owner, symbol, ahead, size, back = forward.extend(ahead, size, back)
            found = np.column_stack([symbol, found[owner]])
            other = found[:, :-1]
        else:
            owner, symbol, back, size, ahead = reverse.extend(back, size, ahead)
            found = np.column_stack([found[owner], symbol])
            other = found[:, 1:]
        keep = np.ones(len(found), bool)
        if n - 1 in filters:  # the part extended has passed already
            keep &= _passes(filters[n - 1], symbols[other])
        if n in filters and n < length:
            keep &= _passes(filters[n], symbols[found])
        if not keep.all():
            found, ahead, size, back = found[keep], ahead[keep], size[keep], back[keep]
    return symbols[found], size


def _coded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards as sequences of corpus-wide word numbers from 1 on, other words as breaks."""
    for batch in batches:
        for row in range(batch.num_rows):
            found = batch.column("found")[row].values
            seq = np.frombuffer(batch.column("seq")[row].as_buffer(), np.int32)
            ids = np.zeros(int(seq.max(initial=0)) + 1, np.int32)
            ids[found.field("at").to_numpy() + 1] = found.field("id").to_numpy() + 1
            seq = ids[seq]
            if len(seq):
                seq = seq[(seq > 0) | np.concatenate([[True], seq[:-1] > 0])]
            yield pa.RecordBatch.from_arrays([pa.array([seq.tobytes()], pa.binary())], names=["seq"])


def _phrase_rows(length: int, filters):
    schema = pa.schema([*((f"w{k + 1}", pa.int32()) for k in range(length)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq in batch.column("seq"):
                words, count = phrases(np.frombuffer(seq.as_buffer(), np.int32), length, filters.value)
                for at in range(0, len(count), 1 << 16):
                    part = words[at:at + (1 << 16)].astype(np.int32) - 1
                    yield pa.RecordBatch.from_arrays([*(pa.array(part[:, k]) for k in range(length)),
                                                      pa.array(count[at:at + (1 << 16)].astype(np.int64))], schema=schema)

    return run


def _filter_of(frequent: DataFrame, length: int) -> np.ndarray:
    """Bits of the phrases of a table: at most FILTER_BITS / 64 rows reach the driver, whatever the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(np.column_stack([batch.column(k).to_numpy() + 1 for k in range(length)]))
            bit = np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(bit.view(np.int64))], names=["slot", "bits"])

    rows = frequent.select(*(f"w{k + 1}" for k in range(length))).mapInArrow(run, "slot long, bits long") \
        .groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def frequent_phrases(coded: DataFrame, depth: int, least: int) -> DataFrame:
    """``w1`` … ``w<depth>`` (null behind a shorter phrase's end) and ``f`` of all phrases of 2 words or more
    with ``least`` occurrences over all shards."""
    spark, found, filters = coded.sparkSession, None, {}
    for length in range(2, depth + 1):
        names = [f"w{k + 1}" for k in range(length)]
        here = coded.mapInArrow(_phrase_rows(length, spark.sparkContext.broadcast(dict(filters))),
                                ", ".join(f"{c} int" for c in names) + ", n long")
        here = materialize(here.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases")
        if length < depth:
            filters[length] = _filter_of(here, length)
        here = here.select(*names, *(F.lit(None).cast("int").alias(f"w{k + 1}") for k in range(length, depth)), "f")
        found = here if found is None else found.unionByName(here)
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST,
                 covered: int = COVERED, top: int = TOP, shard_bytes: int = SHARD) -> DataFrame:
    """Per language the ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    rows = shards(docs, text_col, lang_col, shard_bytes)
    seen = rows.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counted = materialize(seen.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")), "word-counts")
    total = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    # ids in order of count: small numbers, which shuffle well, for frequent words
    known = materialize(ordered_index(counted.where(F.col("f") >= least), [F.desc("f"), "lang", "word"], "id"), "words")

    wanted = rows.select("shard", "lang", F.posexplode("words").alias("at", "word")).join(known.select("lang", "word", F.col("id").cast("int").alias("id")), ["lang", "word"])
    found = wanted.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("found"))  # a shard's own words
    columns = [f"w{k}" for k in range(1, depth + 1)]
    coded = _packed(rows.select("shard", "seq").join(found, "shard").select("seq", "found").mapInArrow(_coded_rows, "seq binary"), "coded")
    f = frequent_phrases(coded, depth, least)

    cands = None
    for length in range(2, depth + 1):
        of = f.where(f"w{length} is not null" + (f" and w{length + 1} is null" if length < depth else ""))
        here = of.select(*columns, F.col("f").alias("a"))
        for k in range(1, length):
            here = _count_of(here, columns[:k], f"l{k}", f, known, columns)
            here = _count_of(here, columns[k:length], f"r{k}", f, known, columns)
        cut = F.array_min(F.array(*(F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"),
                                             F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length))))
        here = here.select(*columns, "a", cut.alias("cut")).select(*columns, "a", "cut.l", "cut.r", "cut.score")
        # the highest count of a longer candidate that holds these words
        for longer in range(length + 1, depth + 1):
            over = f.where(f"w{longer} is not null" + (f" and w{longer + 1} is null" if longer < depth else ""))
            for shift in range(longer - length + 1):
                most = over.groupBy(*(F.col(columns[shift + k]).alias(columns[k]) for k in range(length))).agg(F.max("f").alias("most"))
                here = here.join(most, columns[:length], "left").where(
                    F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))).drop("most")
        cands = here if cands is None else cands.unionByName(here)
    cands = materialize(cands, "candidates")
    for k, c in enumerate(columns):
        word = known.select(F.col("id").cast("int").alias(c), F.col("word").alias(f"t{k + 1}"), *([F.col("lang")] if k == 0 else []))
        cands = cands.join(word, c, "inner" if k < 2 else "left")
    cands = cands.select("lang", F.concat_ws(" ", *(f"t{k + 1}" for k in range(depth))).alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = cands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(a: str, left: str, right: str):
    """floor(1000000 * a * a / (left * right)), exactly."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"cast(1000000 as decimal(7,0)) * ({big(a)} * {big(a)}) div ({big(left)} * {big(right)})")


def _count_of(rows: DataFrame, part: list[str], name: str, f: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the count of the words in columns ``part``."""
    if len(part) == 1:
        return rows.join(known.select(F.col("id").cast("int").alias(part[0]), F.col("f").alias(name)), part[0])
    of = f.where(f"{columns[len(part) - 1]} is not null" + (f" and {columns[len(part)]} is null" if len(part) < len(columns) else ""))
    return rows.join(of.select(*(F.col(columns[k]).alias(c) for k, c in enumerate(part)), F.col("f").alias(name)), part)


def oracle(top: int = TOP, least: int = LEAST, covered: int = COVERED) -> str:
    """DuckDB SQL of :func:`collocations` for phrases of two and three words."""
    return f"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
f1 as materialized (select lang, a, count(*) as f from (select lang, unnest(w) as a from w) group by all),
f2 as materialized (select lang, a, b, count(*) as f from
  (select lang, unnest(w[:-2]) as a, unnest(w[2:]) as b from w where len(w) >= 2) group by all having count(*) >= {least}),
f3 as materialized (select lang, a, b, c, count(*) as f from
  (select lang, unnest(w[:-3]) as a, unnest(w[2:-2]) as b, unnest(w[3:]) as c from w where len(w) >= 3) group by all having count(*) >= {least}),
s2 as (select f2.lang, f2.a || ' ' || f2.b as phrase, f2.f as a, x.f as l, y.f as r,
         (1000000::hugeint * f2.f * f2.f // (x.f::hugeint * y.f))::bigint as score
       from f2 join f1 x on x.lang = f2.lang and x.a = f2.a join f1 y on y.lang = f2.lang and y.a = f2.b
       left join (select lang, a, b, max(f) as f from (select lang, a, b, f from f3 union all select lang, b, c, f from f3) group by all) o
         on o.lang = f2.lang and o.a = f2.a and o.b = f2.b
       where o.f is null or 100 * o.f < {covered} * f2.f),
c3 as (select f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c as phrase, f3.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2,
         (1000000::hugeint * f3.f * f3.f // (x.f::hugeint * yz.f))::bigint as s1, (1000000::hugeint * f3.f * f3.f // (xy.f::hugeint * z.f))::bigint as s2
       from f3 join f1 x on x.lang = f3.lang and x.a = f3.a join f1 z on z.lang = f3.lang and z.a = f3.c
       join f2 xy on xy.lang = f3.lang and xy.a = f3.a and xy.b = f3.b join f2 yz on yz.lang = f3.lang and yz.a = f3.b and yz.b = f3.c),
s as (select * from s2 union all
      select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from c3),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from s),
n as (select lang, sum(f)::bigint as n from f1 group by lang)
select k.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score from k join n using (lang) where rank <= {top}"""
