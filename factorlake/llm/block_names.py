"""Exact duplicates by deterministic block naming, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stable

BLANKS = [" ", "\n", "\t", "\r", "\x0b", "\x0c"]


def without_blanks(text: Column) -> Column:
    """The text (null: empty) with every ASCII white-space character deleted."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _blocks(docs: DataFrame, block_chars: int) -> DataFrame:
    """Fixed-size blocks of the normalised text, one row each; the attributes of a document ride on its first block."""
    flat = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"), without_blanks(F.col("text")).alias("flat"))
    cut = flat.select("row", "doc_id", "n_chars", F.sha2("flat", 256).alias("sha"),
                      F.regexp_extract_all(F.col("flat"), F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("parts"))
    some = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.lit("")))
    return cut.select("row", "doc_id", "n_chars", "sha", F.size(some).alias("n_blocks"), F.posexplode(some).alias("pos", "block"))


def _clashing(blocks: DataFrame) -> DataFrame:
    """(h, block, k) for different blocks with one 64-bit hash: k numbers them in order.

    Blocks are sorted by hash and the least and greatest block of each hash compared, so a name is
    proved to stand for one content only. Almost always empty.
    """
    pairs = blocks.select(F.xxhash64("block").alias("h"), "block")
    mixed = stable(pairs.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo <> hi").select("h"))
    return stable(pairs.join(mixed, "h", "left_semi").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("block"))))


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """``rows`` with an integer ``name`` in place of the key columns: the number of the key in sorted order.

    Distinct keys are sorted by range and numbered once, then stored: the numbers are fixed. Both
    sides of the join are stored tables, so Spark can split a key that many documents share.
    """
    names = stable(rows.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id()))
    return stable(rows.join(names, list(key)).drop(*key))


def identities(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """(row, doc_id, n_chars, sha, level, name) for every row; two rows have equal (level, name) exactly if
    their texts without white space are equal.

    Level 0 names blocks of ``block_chars`` characters; each further level names adjacent pairs of
    names, until a document has one name left. The number of levels is the logarithm of the longest
    text's number of blocks. A document leaves at the level where it is down to one name, so later levels
    hold long texts only. Null texts are empty texts, which are equal to each other. Stored tables keep
    rows and numbers, so a lost executor repeats only reads.
    """
    blocks = _blocks(docs.select("doc_id", "text"), block_chars)
    clashes = _clashing(blocks)
    hashed = blocks.withColumn("h", F.xxhash64("block")).join(clashes, ["h", "block"], "left").withColumn("k", F.coalesce("k", F.lit(0))).drop("block")
    first = F.col("pos") == 0
    slim = stable(hashed.select("row", "pos", "n_blocks", "h", "k", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_chars", "sha")]))
    longest = slim.agg(F.max("n_blocks")).first()[0] or 1
    level, now = 0, _named(slim, "h", "k")
    parts = [now.where("n_blocks = 1")]
    while longest > 1:
        even = F.col("pos") % 2 == 0
        pairs = now.where("n_blocks > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.ceil(F.max("n_blocks") / 2).cast("int").alias("n_blocks"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            *[F.max(c).alias(c) for c in ("doc_id", "n_chars", "sha")])
        longest, level = (longest + 1) // 2, level + 1
        now = _named(stable(pairs), "a", "b")
        parts.append(now.where("n_blocks = 1").withColumn("level", F.lit(level)))
    parts[0] = parts[0].withColumn("level", F.lit(0))
    return reduce(DataFrame.unionByName, [p.select("row", "doc_id", "n_chars", "sha", "level", "name") for p in parts])


def duplicates(docs: DataFrame, block_chars: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts (white space deleted) the one with the most code points in the original text stays,
    then the smallest doc_id (null last), then one of fully repeated rows. ``docs`` needs doc_id and
    text, other columns are ignored. An empty table gives an empty result.
    """
    named = stable(identities(docs, block_chars))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    groups = stable(named.groupBy("level", "name").agg(best, F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_chars").cast("long").alias("n_chars"))
