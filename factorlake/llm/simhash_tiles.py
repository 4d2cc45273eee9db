"""Near-duplicate groups from 64-bit SimHash fingerprints by tiled exact comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stable
from .graph import components

SLICE = 1 << 16  # shingles hashed at a time: bounds memory for one very long text


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text as a signed 64-bit number; no word gives 0.

    A-Z are lower-cased, words are the runs between ASCII white space, repeated shingles count again.
    A text with fewer words than a shingle is one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    ones, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    while part := [digest(g, 42) for g in itertools.islice(grams, SLICE)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """Adds the SimHash of ``text`` (null: empty) as a long column."""
    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, simhash(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def hex_digits(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _part_counts(fp: Column, parts: int) -> list[Column]:
    width = 64 // parts
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(parts)]


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of tile keys that can lie within the radius, one of each opposite pair, zero left out."""
    found = (d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius)
    return [s for s in (sum(x * 32**i for i, x in enumerate(d)) for d in found) if s > 0]


def tiles(prints: DataFrame, radius: int, parts: int, tile_rows: int) -> DataFrame:
    """(key, chunk, fps) from distinct fingerprints ``fp``.

    The key holds the population count of each part of the fingerprint (offset by 8, base 32). Each
    differing bit changes one of these counts by one, so fingerprints within the radius have keys
    whose counts differ by at most the radius in sum. A key with more than ``tile_rows`` fingerprints
    is dealt to several chunks.
    """
    counts = _part_counts(F.col("fp"), parts)
    key = sum(((c + 8) * F.lit(32**i) for i, c in enumerate(counts)), F.lit(0)).cast("long")
    keyed = prints.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile_rows).alias("chunks"))
    return (keyed.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
            .groupBy("key", "chunk").agg(F.collect_list("fp").alias("fps")))


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links within ``a`` (``b`` None) or between ``a`` and ``b`` connect."""
    other = a if b is None else b
    near = np.empty((len(a), len(other)), bool)
    left, right = a.view(np.uint64), other.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    for i in range(0, len(a), 256):
        near[i:i + 256] = np.bitwise_count(left[i:i + 256, None] ^ right[None, :]) <= radius
    if b is None:
        np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    edges: list[tuple[int, int]] = []
    waiting_a, waiting_b = np.zeros(len(a), bool), np.ones(len(other), bool)
    waiting_a[rows] = True
    for start in rows:
        if not waiting_a[start]:
            continue
        waiting_a[start] = False
        if b is None:
            waiting_b[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            reached = np.flatnonzero(near[i] & waiting_b)
            waiting_b[reached] = False
            for j in reached:
                edges.append((int(a[i]), int(other[j])))
                if b is None:
                    waiting_a[j] = False
                    queue.append(j)
                else:
                    back = np.flatnonzero(near[:, j] & waiting_a)
                    waiting_a[back] = False
                    for k in back:
                        edges.append((int(a[k]), int(other[j])))
                        queue.append(k)
    return edges


def links(prints: DataFrame, radius: int = 3, parts: int = 4, tile_rows: int = 2048) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``: a spanning forest of the links of every tile pair.

    All pairs within the radius are compared; what is returned connects the same fingerprints with at
    most one edge less than a tile pair has fingerprints, so a large group of near copies never
    becomes a quadratic number of rows.
    """
    stored = stable(tiles(prints, radius, parts, tile_rows))
    left = stored.select("key", F.col("chunk").alias("ca"), F.col("fps").alias("a"))
    right = stored.select("key", F.col("chunk").alias("cb"), F.col("fps").alias("b"))
    moved = right.select(F.explode(F.array(*map(F.lit, _steps(parts, radius)))).alias("step"), "key", "b").select((F.col("key") + F.col("step")).alias("key"), "b")
    alone = stored.select(F.col("fps").alias("a"), F.lit(None).cast("array<long>").alias("b")).where(F.size("a") > 1)
    chunks = left.join(right, "key").where("ca < cb").select("a", "b")
    pairs = left.join(moved, "key").select("a", "b").unionByName(chunks).unionByName(alone)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [e for a, b in zip(batch["a"], batch["b"]) for e in _forest(np.asarray(a, np.int64), None if b is None else np.asarray(b, np.int64), radius)]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return pairs.mapInPandas(compare, "u long, v long")


def groups(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: its other columns, ``fingerprint`` (long) and ``component_id``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; the component id is
    the smallest doc_id that can be reached. Null texts count as empty, empty texts have fingerprint
    zero and are linked like others, repeated rows are separate rows of one component. A null doc_id
    is never a component id unless the whole component has none. ``docs`` needs doc_id and text.
    """
    marked = stable(with_fingerprint(docs.select("doc_id", "text"), "fp", shingle).drop("text"))
    return marked.join(component_ids(marked, radius), "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def component_ids(marked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, component_id) of ``marked(doc_id, fp)``, stored."""
    owners = stable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(owners.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    rooted = stable(owners.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = stable(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return stable(rooted.join(smallest, "root").select("fp", "component_id"))


def one_per_group(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group kept: that with the smallest doc_id (null last), then one of equal rows."""
    own = docs.columns
    marked = stable(with_fingerprint(docs, "__fp", shingle).withColumn("__row", F.monotonically_increasing_id()))
    slim = marked.select("doc_id", F.col("__fp").alias("fp"), F.col("__row").alias("row"))
    ids = component_ids(slim, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    per_print = slim.groupBy("fp").agg(F.min(order).alias("best"))
    best = per_print.join(ids, "fp")
    # components of rows without any doc_id have no id of their own: they keep one row per fingerprint
    keep = best.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    return marked.join(keep, "__row", "left_semi").select(*own)
