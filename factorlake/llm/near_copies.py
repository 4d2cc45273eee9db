"""Near copies by five-word Jaccard similarity: SimHash groups, then MinHash bands name candidates, exact sets decide."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stable
from .graph import components
from .simhash_tiles import SLICE, links

ODD = np.random.default_rng(64).integers(0, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)  # multipliers: fixed values
STARS = 3  # rounds that compare a bucket with its first row only, before rows meet by their rarest shingles


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; words as in ``simhash_tiles.fingerprint``."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    digest, parts = xxhash.xxh64_intdigest, []
    while part := [digest(g, 42) for g in itertools.islice(grams, SLICE)]:
        parts.append(np.unique(np.array(part, np.uint64)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit number per band of ``rows`` MinHash values; none for an empty set."""
    if not len(hashes):
        return []
    odd = ODD[:bands * rows]
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i:i + 512, None] * odd).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(bands, rows))]


def simhash(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit shingle hashes as a signed number: a bit is 1 if set in over half of them; an empty set gives 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        ones += np.unpackbits(hashes[i:i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _signed(texts: pd.Series, width: int, bands: int, rows: int) -> pd.DataFrame:
    sets = [shingles(t, width) for t in texts]
    return pd.DataFrame({"same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "fp": [simhash(s) for s in sets],
                         "keys": [band_keys(s, bands, rows) for s in sets]})


def simhash_pairs(rows: DataFrame, radius: int = 3) -> DataFrame:
    """(u, v) of every row of ``rows(at, fp)`` and the first row of its SimHash group, sizes not yet compared.

    A group is what fingerprints at ``radius`` or fewer differing bits connect (``simhash_tiles.links``: all pairs of
    fingerprints in question are compared, in tiles).
    """
    roots = components(links(rows.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    grouped = stable(rows.join(roots, "fp", "left").select("at", F.coalesce("root", "fp").alias("root")))
    heads = stable(grouped.groupBy("root").agg(F.min("at").alias("head"), F.count("*").alias("size")).where("size > 1").select("root", "head"))
    return grouped.join(heads, "root").where(F.col("at.row") != F.col("head.row")).select("head", "at")


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(v) of the edges (u, v) whose sets have at least this Jaccard similarity."""
    right = edges.join(sets.select(F.col("row").alias("v"), F.col("set").alias("b")), "v")
    both = right.join(sets.select(F.col("row").alias("u"), F.col("set").alias("a")), "u")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common / (F.size("a") + F.size("b") - common) >= similarity).select("v").distinct()


def _by_rare_shingles(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) for all pairs of ``rows(at)`` that can have the similarity, u before v, without comparing each with each.

    Two sets of similarity s share one of the first n - ceil(s n) + 1 shingles of either in any common order
    (prefix filtering, exact). The order goes from the rarest shingle among these rows on, so what a large group
    of unlike rows has in common is not in it, and a shingle that one row has meets nobody.
    """
    own = stable(rows.select(F.col("at.row").alias("row"), "at").distinct())
    long = stable(sets.join(own, "row").select("at", F.explode("set").alias("s")))
    often = stable(long.groupBy("s").agg(F.count("*").alias("df")))
    order = Window.partitionBy("at.row").orderBy("df", "s")
    # one part in a million is given away against rounding: a longer prefix is still exact
    prefix = F.col("at.n") - F.ceil(F.col("at.n") * (similarity - 1e-6)) + 1
    heads = long.join(often, "s").withColumn("k", F.row_number().over(order)).where((F.col("k") <= prefix) & (F.col("df") > 1))
    heads = stable(heads.select("s", "at", F.col("at.n").alias("n"), "k"))
    # behind its first common shingle a pair has at most the rest of the shorter tail in common
    most = 1 + F.least(F.col("n") - F.col("k"), F.col("m") - F.col("j"))
    enough = most >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-3
    met = heads.join(heads.select("s", F.col("at").alias("head"), F.col("n").alias("m"), F.col("k").alias("j")), "s").where((F.col("head") < F.col("at")) & enough)
    return met.select(F.col("head.row").alias("u"), F.col("at.row").alias("v")).distinct()


def one_per_group(docs: DataFrame, similarity: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5) -> DataFrame:
    """``docs`` without the rows that have a near copy of smaller doc_id (null last; then one of equal rows stays).

    A row goes only if the Jaccard similarity of its set of word shingles with that of an earlier row is at
    least ``similarity``; 64 bits of hash stand for a shingle. Rows of equal sets (texts without a word, too) meet
    by the hash of the set. Every row is first compared with the first row of its SimHash group (at most 3 bits apart from
    row to row). Three bits reach only the nearest copies, so the rows that stay are compared when they share one of the
    bands of MinHash values, too: a pair of similarity s does with probability 1 - (1 - s**rows)**bands (0.9996 at 0.8). Every pair of a bucket whose
    rows both stay has been compared, or cannot have the similarity. A bucket meets its first row, then, without
    the rows that went, its next one, and so on for three rounds, so a large group of near copies gives a row per
    member and round; the rows of buckets that are still not empty meet where they share one of their rarest shingles.
    """
    signs = T.StructType([T.StructField("same", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    @F.pandas_udf(signs)
    def signed(texts: pd.Series) -> pd.DataFrame:
        return _signed(texts, width, bands, rows)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).view(np.int64) for t in texts])

    own, text = docs.columns, F.coalesce(F.col("text"), F.lit("")).cast("binary")
    marked = stable(docs.withColumn("__sign", signed(text)).withColumn("__row", F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.col("__row").alias("row"), F.col("__sign.n").alias("n"))
    # the keys are a function of the set: they go with the first row, not through the grouping
    first = stable(marked.groupBy("__sign.same").agg(F.min(place).alias("at"), F.first("__sign.fp").alias("fp")).select("at", "fp", F.col("at.row").alias("__row")))
    able = F.least("at.n", "head.n") >= F.greatest("at.n", "head.n") * similarity
    grouped = stable(simhash_pairs(first).where(able).select(F.col("head.row").alias("u"), F.col("at.row").alias("v")))
    keyed = first.join(marked.select("__row", F.explode("__sign.keys").alias("key")), "__row").select("key", "at")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    left = stable(keyed.join(buckets, "key").select("key", "at"))
    compared = left.select(F.col("at.row").alias("__row")).unionByName(grouped.select(F.explode(F.array("u", "v")).alias("__row")))
    texts = marked.join(compared.distinct(), "__row", "left_semi")
    sets = stable(texts.select(F.col("__row").alias("row"), shingled(text).alias("set")))
    gone = [stable(_verified(grouped, sets, similarity))]
    for star in range(STARS + 1):
        if left.isEmpty():
            break
        if star == STARS:
            gone.append(stable(_verified(stable(_by_rare_shingles(left, sets, similarity)), sets, similarity)))
            break
        heads = stable(left.groupBy("key").agg(F.min("at").alias("head")))
        met = left.join(heads, "key").where(F.col("at.row") != F.col("head.row"))
        if star == 0:  # a row that went already need not go again; the others still meet it where it is the first
            met = stable(met.join(gone[0], F.col("at.row") == F.col("v"), "left_anti"))
        pairs = stable(met.where(able).select(F.col("head.row").alias("u"), F.col("at.row").alias("v")).distinct())
        gone.append(stable(_verified(pairs, sets, similarity)))
        rest = met.select("key", "at").join(gone[-1], F.col("at.row") == F.col("v"), "left_anti")
        left = stable(rest.join(rest.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "key"))
    keep = first.select("__row")
    for rows_gone in gone:
        keep = keep.join(rows_gone, F.col("__row") == F.col("v"), "left_anti")
    return marked.join(keep, "__row", "left_semi").select(*own)
