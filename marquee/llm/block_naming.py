"""Exact dedup by deterministic block naming (DataFrame functions only).

Each text is cut into blocks of ``block_chars`` characters.  Equal blocks get
equal integers and different blocks different ones; then neighbouring integers
are paired and the pairs named again, halving the number of names per text,
until one integer is left.  Two texts are equal exactly when they have the
same number of blocks and the same last integer.

Blocks are grouped under a 128-bit key *together with their text*, so a key
that two different blocks share is seen (and the key family re-seeded): names
never rest on a hash being free of collisions.  Names are positions in the
range-sorted keys.  Every naming step groups with partial aggregation before
its shuffle, and each level is written to the shared checkpoint folder, so a
group of copies costs one row per map task and lost executors cost one level.

Edge cases: null text counts as empty; an empty text has no blocks and all
empty texts are one group; rows may repeat (same id, same text): one of them
stays; a null id is smaller than every id; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import free_name

BLOCK_CHARS = 2048


def _blocks(text, block_chars: int):
    """One linear pass over the text (repeated substring calls would be quadratic)."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block_chars), F.lit(0))


def _keys(block, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(block, F.lit(~seed)).alias("k2"))


def _ranked(keys: DataFrame, cols: list[str], what: str) -> DataFrame:
    """Distinct ``keys`` with ``name``: an integer that follows their sort order."""
    ordered = keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return materialize(ordered.select("*", F.monotonically_increasing_id().alias("name")), what)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``row``, ``doc_id``, ``text_sha256``, ``n_blocks``, ``name`` per input row: texts
    are equal exactly when (``n_blocks``, ``name``) are."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = src.select(F.explode(_blocks("text", block_chars)).alias("block"))
    seed = 0
    while True:
        # grouped by key and block text: different blocks under one key stay apart
        exact = blocks.select(_keys(F.col("block"), seed).alias("k"), "block") \
            .select("k.k1", "k.k2", "block").distinct()
        names = _ranked(exact.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_texts")), ["k1", "k2"], "block-names")
        if names.where("n_texts > 1").isEmpty():
            break
        seed += 1

    rows = materialize(src.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"),
        F.transform(_blocks("text", block_chars), lambda b: _keys(b, seed)).alias("keys"))
        .withColumn("n_blocks", F.size("keys")), "block-rows")
    cur = materialize(
        rows.select("row", "n_blocks", F.posexplode("keys").alias("pos", "k")).select("row", "n_blocks", "pos", "k.k1", "k.k2")
        .join(names.select("k1", "k2", "name"), ["k1", "k2"]).select("row", "n_blocks", "pos", "name"), "block-level")

    left = rows.agg(F.max("n_blocks")).first()[0] or 0
    done = [rows.where("n_blocks = 0").select("row", F.lit(-1).cast("long").alias("name"))]
    level = 0
    while left > 0:
        width = 1 << level  # texts of at most this many blocks now have one name
        done.append(cur.where(F.col("n_blocks") <= width).where("pos = 0").select("row", "name"))
        if left <= width:
            break
        pairs = (cur.where(F.col("n_blocks") > width)
                 .groupBy("row", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b")))
        pair_names = _ranked(pairs.select("a", "b").distinct(), ["a", "b"], "pair-names")
        cur = materialize(pairs.join(pair_names, ["a", "b"]).select("row", "n_blocks", "pos", "name"), "block-level")
        level += 1
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    return rows.select("row", "doc_id", "text_sha256", "n_blocks").join(named, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per input row: ``doc_id``, ``keep_id`` (largest id of the equal texts),
    ``group_size``, ``kept``, ``text_sha256``.  Exactly one row of a group has ``kept``."""
    ident = materialize(identities(docs, id_col, text_col, block_chars), "identities")
    # written before the join back, so both join sides are plain shuffles that AQE can split
    groups = materialize(ident.groupBy("n_blocks", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ident.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    sha = free_name(docs, "_kept_sha")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    cond = keyed[id_col].eqNullSafe(kept["kept_id"]) & (keyed[sha] == kept["kept_sha"])
    return keyed.join(kept, cond, "left_semi").dropDuplicates([id_col, sha]).drop(sha)
