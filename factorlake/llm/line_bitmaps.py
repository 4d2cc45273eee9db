"""Lines that many documents share, dropped by per-document keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stable

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def text_mark(text: Column) -> Column:
    return F.xxhash64(text)


def _solid(text: Column) -> Column:
    """Code points that are not ASCII white space."""
    return F.char_length(F.translate(text, BLANK, ""))


def line_hashes(docs: DataFrame, min_chars: int = 1, sizes: bool = False) -> DataFrame:
    """(h1, h2, doc_id, mark, pos, n_lines) for each line whose key has ``min_chars`` code points; 128 bits of hash stand for the key.

    With ``sizes`` also the code points but white space of the line (chars) and of its document (whole).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text_mark(text).alias("mark"), F.split(text, "\n").alias("lines"), *[_solid(text).alias("whole")] * sizes)
    lines = split.select("doc_id", "mark", *["whole"] * sizes, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "mark", *["whole"] * sizes, "n_lines", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "mark", "pos", "n_lines", *["whole", _solid(F.col("key")).alias("chars")] * sizes)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (h1, h2, doc_id, mark, pos): one row per run of equal hashes with its number of documents
    and its first occurrence. A run that reaches the end of a batch is carried over."""
    names = ["h1", "h2", "docs", "first_doc", "first_mark", "first_pos"]
    held: list | None = None  # h1, h2, docs, first doc, mark and pos, last doc and mark
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, mark, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        absent = np.asarray(batch.column(2).is_null())
        doc = np.asarray(batch.column(2).fill_null(0)).astype(np.int64)
        new_run = np.ones(len(h1), bool)
        new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = new_run.copy()
        new_doc[1:] |= (doc[1:] != doc[:-1]) | (absent[1:] != absent[:-1]) | (mark[1:] != mark[:-1])
        starts = np.flatnonzero(new_run)
        counts = np.add.reduceat(new_doc.astype(np.int64), starts)
        who = [None if absent[s] else int(doc[s]) for s in starts]
        rows = [[int(h1[s]), int(h2[s]), int(c), w, int(mark[s]), int(pos[s])] for s, c, w in zip(starts, counts, who)]
        if held is not None:
            if held[:2] == rows[0][:2]:
                repeated = held[6:] == rows[0][3:5]
                rows[0] = [*held[:2], held[2] + rows[0][2] - repeated, *held[3:6]]
            else:
                rows.insert(0, held[:6])
        last = [None if absent[-1] else int(doc[-1]), int(mark[-1])]
        held = rows.pop() + last
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in held[:6]], names)


def shared_keys(hashes: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first_doc, first_mark, first_pos) of the keys found in at least ``min_docs`` documents, stored.

    The rows are range-partitioned by hash and document and sorted by position within them, so a key
    that a third of all documents share is spread over several ranges; no document of a key is ever
    cut between two ranges, and the ranges' counts add up exactly.
    """
    order = ["h1", "h2", "doc_id", "mark"]
    streamed = hashes.select(*order, F.col("pos").cast("long").alias("pos")).repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    runs = streamed.mapInArrow(_runs, "h1 long, h2 long, docs long, first_doc long, first_mark long, first_pos long")
    first = F.min(F.struct(F.col("first_doc").isNotNull().alias("known"), "first_doc", "first_mark", "first_pos")).alias("first")
    total = runs.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), first).where(F.col("docs") >= min_docs)
    return stable(total.select("h1", "h2", "first.first_doc", "first.first_mark", "first.first_pos"))


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series, lines: pd.Series) -> pd.Series:
    out = []
    for at, n in zip(dropped, lines):
        keep = np.ones(n, np.uint8)
        keep[np.asarray(at, np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pd.Series(out)


def unpack_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Keep flags, one per line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, long_chars: int = 0) -> DataFrame:
    """(doc_id, mark, n_lines, n_dropped, bitmap) for the documents that lose lines.

    ``bitmap`` is the zlib-compressed keep bit of each line in order; texts do not travel. A document
    is a doc_id together with its text (``mark`` is the hash of the text): repeated rows count once,
    two texts under one id count twice, rows without doc_id count by their text. Null texts are one
    empty line. With ``keep_first`` the first line by document and position stays (ids without a value
    first); otherwise every line of a shared key goes. With ``long_chars`` a first line of fewer
    code points but white space goes as well, unless shared lines are half of its document's text or more.
    """
    hashes = stable(line_hashes(docs, min_chars, keep_first and long_chars > 0))
    shared = shared_keys(hashes, min_docs)
    hits = hashes.join(shared, ["h1", "h2"])
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("mark") == F.col("first_mark")) & (F.col("pos") == F.col("first_pos"))
    if keep_first and long_chars > 0:
        met = hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("pos", "chars", first.alias("first"))).alias("hits"), F.max("n_lines").alias("n_lines"), F.max("whole").alias("whole"))
        lost = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
        met = met.withColumn("copy", lost * 2 >= F.col("whole"))
        goes = F.filter("hits", lambda x: ~x["first"] | ~((x["chars"] >= long_chars) | F.col("copy")))
        dropped = met.select("doc_id", "mark", F.transform(goes, lambda x: x["pos"]).alias("dropped"), "n_lines").where(F.size("dropped") > 0)
        return dropped.select("doc_id", "mark", "n_lines", F.size("dropped").alias("n_dropped"), _bitmap("dropped", "n_lines").alias("bitmap"))
    if keep_first:
        hits = hits.where(~first)
    dropped = hits.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("dropped"), F.max("n_lines").alias("n_lines"))
    return dropped.select("doc_id", "mark", "n_lines", F.size("dropped").alias("n_dropped"), _bitmap("dropped", "n_lines").alias("bitmap"))


@F.pandas_udf(T.StringType())
def _kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    out = []
    for text, bitmap in zip(texts, bitmaps):
        if bitmap is None:
            out.append(None)
            continue
        lines = text.split("\n")
        out.append("\n".join(x for x, keep in zip(lines, unpack_bitmap(bitmap, len(lines))) if keep))
    return pd.Series(out, dtype=object)


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, long_chars: int = 0, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the kept lines as ``text`` and two more columns, named by ``counts`` (which replace such columns of ``docs``).

    Rows, and texts that lose nothing (null ones too), stay as they are; a text that loses all lines is empty.
    """
    own = docs.columns
    maps = keep_bitmaps(docs, min_docs, min_chars, keep_first, long_chars).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("n_dropped").alias("__n"), F.col("bitmap").alias("__bits"))
    marked = docs.withColumn("__m", text_mark(F.coalesce(F.col("text"), F.lit(""))))
    met = marked.join(maps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    hit = F.col("__bits").isNotNull()
    text = F.when(hit, _kept(F.when(hit, F.col("text")), F.col("__bits"))).otherwise(F.col("text"))
    return met.select(*[c for c in own if c != "text" and c not in counts], text.alias("text"),
                      F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("long").alias(counts[0]), F.coalesce(F.col("__n"), F.lit(0)).cast("long").alias(counts[1]))
