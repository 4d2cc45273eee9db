"""Benchmark passages in documents: latent semantic retrieval, then longest common subsequences and answer checks."""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stable

WORD = re.compile(r"[^\W_]+")
SIGNS = string.punctuation
FOREIGN_SIGNS = re.compile(r"[^\w\x00-\x7f]+")
IN_WORD = bytes(c > 127 or chr(c).isalnum() for c in range(256))  # by byte of a text without FOREIGN_SIGNS
PRIMES = 2654435761, 2246822519, 3266489917, 668265263, 374761393  # of XXH32
LONG_WORD = 16  # bytes; XXH32 takes longer words another way
FEATURES = 1 << 13  # hashed vocabulary
CELL, CELLS = 8, 3  # a passage is three cells of eight words
PASSAGE = CELL * CELLS
CACHE_WORDS = 500_000
CHUNK_BYTES = 1 << 20  # text hashed at a time
CHUNK_WORDS = 120_000  # words scored at a time: bounds memory for one very long text
CACHED_LINES, CACHED_WINDOWS = 512, 256  # sums and cosines made at a time, which stay in a processor's cache
MEETS = 8  # passages of a feature, or sums of them, that are added up at a time
BLOCK = 64  # feature rows that travel together while the projected matrix is summed


@dataclass(frozen=True)
class Settings:
    """``rank`` latent dimensions from ``rank + spare`` random directions; a candidate has a cosine of ``cosine``
    (less for items shorter than a window, in proportion to the root of their length).

    A candidate is a leak if the longest common subsequence covers ``copied`` of the item's words, or
    ``rephrased`` of them and the answer is found: ``answered`` of the item's answer (or, without
    one, of its rarest third of words) occurs in the same place.
    """
    rank: int = 64
    spare: int = 8
    cosine: float = 0.6
    copied: float = 0.8
    rephrased: float = 0.6
    answered: float = 0.6
    short_item: int = 8  # items with fewer words must occur word by word
    items_per_block: int = 2_000
    seed: int = 11


class _Known(dict):
    """The hashes of the words of a run between white space, made when a run is first asked for; no word crosses white space."""

    def __missing__(self, run: str) -> bytes:
        core = run.rstrip(SIGNS)
        # letters and digits, perhaps with signs behind them, are one word
        found = xxhash.xxh32_digest(core) if core.isalnum() else b"".join(map(xxhash.xxh32_digest, WORD.findall(run)))
        self[run] = found
        return found


@functools.lru_cache(1)
def _known() -> _Known:
    """One per Python process: later benchmarks find the runs of the earlier ones."""
    return _Known()


def word_ids(text: str | None, known: _Known) -> bytes:
    """32-bit hashes of the lower-case words (runs of letters and digits) of a text, as bytes. ``known`` caches them."""
    out = b"".join(map(known.__getitem__, (text or "").lower().split()))
    if len(known) > CACHE_WORDS:
        known.clear()
    return out


def _word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH32 of the bytes of each word, all words of a size together; three more bytes follow the last word."""
    one, two, three, four, five = map(np.uint32, PRIMES)
    single, lanes = np.frombuffer(data, np.uint8), np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    kinds = np.minimum(sizes, LONG_WORD).astype(np.uint8)
    order, ends = np.argsort(kinds, kind="stable"), np.cumsum(np.bincount(kinds, minlength=LONG_WORD + 1))
    out = np.empty(len(starts), np.uint32)
    for size in range(1, LONG_WORD):
        words = order[ends[size - 1]:ends[size]]
        at = starts[words]
        h = np.full(len(at), PRIMES[4] + size, np.uint32)
        for k in range(0, size - 3, 4):
            h += lanes[at + k] * three
            h = (h << 17 | h >> 15) * four
        for k in range(size // 4 * 4, size):
            h += single[at + k] * five
            h = (h << 11 | h >> 21) * one
        h = (h ^ h >> 15) * two
        h = (h ^ h >> 13) * three
        out[words] = h ^ h >> 16
    for k in order[ends[LONG_WORD - 1]:].tolist():
        out[k] = xxhash.xxh32_intdigest(data[starts[k]:starts[k] + sizes[k]])
    return out.byteswap()  # digests are big-endian


def texts_ids(texts: Iterable[str | None]) -> Iterator[bytes]:
    """``word_ids`` of each text; the words of about CHUNK_BYTES of texts are found and hashed at a time."""
    held, size = [], 0

    def joined() -> Iterator[bytes]:
        data = b"\n".join([b"", *held, b"   "])
        inside = np.frombuffer(data.translate(IN_WORD), np.bool_)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        raw = _word_hashes(data, starts, ends - starts).tobytes()
        last = 4 * np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held]))
        first = 0
        for end in last.tolist():
            yield raw[first:end]
            first = end

    for text in texts:
        text = (text or "").lower()
        held.append((text if text.isascii() else FOREIGN_SIGNS.sub(" ", text)).encode())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield from joined()
            held, size = [], 0
    if held:
        yield from joined()


def encoded(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with __row (a number of the row) and __ids (word hashes of the whole text), stored."""
    @F.pandas_udf(T.BinaryType())
    def ids(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield pd.Series(list(texts_ids(texts)), dtype=object)

    coded = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__ids", ids(F.col("text")))
    return stable(coded if keep_text else coded.drop("text"))


def _lines(values: np.ndarray, sizes: np.ndarray, width: int, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The values in lines of ``width`` and the number of lines of each group; a group begins a line and is filled up with ``blank``."""
    counts = -(-sizes // width)
    out = np.full((counts.sum(), width), blank, np.int64)
    skipped = (np.cumsum(counts) - counts) * width - (np.cumsum(sizes) - sizes)
    out.ravel()[np.arange(len(values)) + np.repeat(skipped, sizes)] = values
    return out, counts


def _features(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts in lines of ``width`` words, FEATURES where a text has no more words, and the lines of each text."""
    values = (np.concatenate(parts) & np.uint32(FEATURES - 1)).astype(np.int64)
    return _lines(values, np.array([len(p) for p in parts]), width, FEATURES)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """The features of about CHUNK_WORDS words, a passage a line; passages do not run across documents."""
    held, n = [], 0
    for frame in frames:
        for raw in frame["__ids"]:
            ids = np.frombuffer(raw, np.uint32)
            for at in range(0, len(ids), CHUNK_WORDS // PASSAGE * PASSAGE):
                part = ids[at:at + CHUNK_WORDS // PASSAGE * PASSAGE]
                held.append(part)
                n += len(part)
                if n >= CHUNK_WORDS:
                    yield _features(held, PASSAGE)[0]
                    held, n = [], 0
    if held:
        yield _features(held, PASSAGE)[0]


def _and_zero(table: np.ndarray) -> np.ndarray:
    """``table`` with a row of zeros behind it, which stands for what a line lacks."""
    return np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])


def _sum_rows(table: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The sum of the rows of ``table`` that each line names, and a row of zeros behind the sums."""
    out = np.zeros((len(lines) + 1, table.shape[1]), np.float32)
    spare = np.empty((CACHED_LINES, table.shape[1]), np.float32)
    for a in range(0, len(lines), CACHED_LINES):
        columns = np.ascontiguousarray(lines[a:a + CACHED_LINES].T)
        here, more = out[a:a + columns.shape[1]], spare[:columns.shape[1]]
        for column in columns:
            here += np.take(table, column, axis=0, out=more, mode="clip")
    return out


def _add_groups(total: np.ndarray, table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
    """Adds to row k of ``total`` the rows of ``table`` that group k names; ``rows`` has the groups one behind the other."""
    groups = np.arange(len(sizes))
    while len(rows):  # the sums of a group's lines are the rows of the next round, until a line is left
        lines, counts = _lines(rows, sizes, MEETS, len(table) - 1)
        table, last = _sum_rows(table, lines), counts == 1
        total[groups[last]] += table[(np.cumsum(counts) - counts)[last]]
        more = counts > 1
        rows, sizes, groups = np.flatnonzero(np.repeat(more, counts)), counts[more], groups[more]


def passage_weights(coded: DataFrame) -> np.ndarray:
    """Inverse document frequency of every feature over the passages of all documents."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, passages = np.zeros(FEATURES, np.int64), 0
        for lines in _batches(frames):
            rows = lines.astype(np.uint16)
            rows.sort(axis=1)
            fresh = np.ones_like(rows, bool)
            fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
            seen += np.bincount(rows[fresh], minlength=FEATURES + 1)[:FEATURES]
            passages += len(rows)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"slot": np.append(at, -1), "n": np.append(seen[at], passages)})

    totals = dict(coded.select("__ids").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())
    seen = np.array([totals.get(i, 0) for i in range(FEATURES)], np.float64)
    return np.log((totals.get(-1, 0) + 1) / (seen + 1)).astype(np.float32)


def _directions(settings: Settings) -> np.ndarray:
    return np.random.default_rng(settings.seed).standard_normal((FEATURES, settings.rank + settings.spare), dtype=np.float32)


def latent_basis(coded: DataFrame, idf: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """features x rank: the projection of a TF-IDF vector into whitened latent space, by a distributed randomised SVD.

    With A the TF-IDF matrix of all passages of all documents, every task adds up its share of
    A'(A R) for random directions R; the sums are added in two levels by blocks of feature rows, so that no task
    gathers all of them. The result, 8,192 rows of rank + spare numbers however large the corpus, is
    factorised on the driver.
    """
    width = settings.rank + settings.spare

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _and_zero(_directions(settings) * idf[:, None])
        total = np.zeros((FEATURES, width), np.float64)
        for lines in _batches(frames):
            projected = _sum_rows(table, lines)
            features = lines.ravel().astype(np.uint16)
            sizes = np.bincount(features, minlength=FEATURES)[:FEATURES]
            order = np.argsort(features, kind="stable")[:sizes.sum()]
            _add_groups(total, projected, order // PASSAGE, sizes)
        blocks = total.astype(np.float32).reshape(-1, BLOCK * width)
        salt = int(total.sum() * 1e3) % 16
        yield pd.DataFrame({"block": range(len(blocks)), "salt": salt, "part": [b.tobytes() for b in blocks]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK * width, np.float64)
        for p in frame["part"]:
            total += np.frombuffer(p, np.float32)
        return pd.DataFrame({"block": frame["block"].head(1), "salt": 0, "part": [total.astype(np.float32).tobytes()]})

    shape = "block long, salt long, part binary"
    sums = coded.select("__ids").mapInPandas(project, shape).groupBy("block", "salt").applyInPandas(add, shape).groupBy("block").applyInPandas(add, shape)
    found = {r["block"]: r["part"] for r in sums.collect()}
    if not found:
        return np.zeros((FEATURES, settings.rank), np.float32)
    b = np.concatenate([np.frombuffer(found[k], np.float32) for k in range(FEATURES // BLOCK)]).reshape(FEATURES, width) * idf[:, None]
    u, s, _ = np.linalg.svd(b.astype(np.float64), full_matrices=False)
    keep = s[:settings.rank] > s[0] * 1e-6 if s[0] > 0 else np.zeros(settings.rank, bool)
    # b has squared singular values of A: dividing by them whitens, so that frequent words do not rule the cosine
    scale = np.where(keep, 1 / np.maximum(s[:settings.rank], 1e-30), 0.0) * (s[0] if s[0] > 0 else 1.0)
    return (u[:, :settings.rank] * scale * idf[:, None]).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-20)


def common_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of the item (``masks``: word -> its places)."""
    row = full = (1 << size) - 1
    for w in words:
        if m := masks.get(w):
            both = row & m
            row = (row + both | row - both) & full
    return size - row.bit_count()


class _Items:
    """A block of benchmark items, with the latent vectors of their passages."""

    def __init__(self, items: list[tuple[int, np.ndarray, ...]], basis: np.ndarray, idf: np.ndarray, settings: Settings):
        self.settings, self.items, vectors, self.owner, self.offset = settings, [], [], [], []
        for item_id, ids, *answer in items:
            n = len(ids)
            if not n:
                continue
            features = (ids & np.uint32(FEATURES - 1)).astype(np.int64)
            for start in sorted({*range(0, max(1, n - PASSAGE + 1), PASSAGE // 2), max(0, n - PASSAGE)}):
                vectors.append(basis[features[start:start + PASSAGE]].sum(axis=0))
                self.owner.append(len(self.items))
                self.offset.append(start)
            masks: dict[int, int] = {}
            for k, w in enumerate(ids.tolist()):
                masks[w] = masks.get(w, 0) | 1 << k
            key = set(answer[0].tolist()) if answer else set()
            if not key:
                rare = sorted(masks, key=lambda w: (-idf[w & FEATURES - 1], w))
                key = set(rare[:max(3, len(rare) // 3)])
            self.items.append((item_id, ids, masks, key))
        self.vectors = _unit(np.array(vectors, np.float32).reshape(-1, basis.shape[1]))
        # features of each item, and how many words of a window must be among them: of a place that holds
        # ``rephrased`` of the item, a window at most half a cell off has three quarters of that share
        self.table = np.zeros((max(1, len(self.items)), FEATURES + 1), bool)
        for k, (_, ids, _, _) in enumerate(self.items):
            self.table[k, (ids & np.uint32(FEATURES - 1)).astype(np.int64)] = True
        self.least = np.array([0.75 * settings.rephrased * min(len(ids), PASSAGE) for _, ids, _, _ in self.items])
        self.owners = np.array(self.owner, np.int64)
        # a short item fills a part of a window only, and its cosine falls with the root of that part
        sizes = np.array([min(len(ids), PASSAGE) for _, ids, _, _ in self.items], np.float32)
        self.limits = settings.cosine * np.sqrt(sizes[self.owners] / PASSAGE)

    def check(self, ids: np.ndarray, start: int, segment: int) -> tuple | None:
        """(item, share of common subsequence, share of answer, first, last word) if the place around a window holds the item."""
        s = self.settings
        item_id, words, masks, answer = self.items[self.owner[segment]]
        n = len(words)
        slack = max(CELL, n // 4)
        first = max(0, start - self.offset[segment] - slack)
        place = ids[first:start - self.offset[segment] + n + slack].tolist()
        there = masks.keys() & set(place)
        if len(there) < s.rephrased * len(masks):
            return None
        if n < s.short_item:
            whole = words.tolist()
            hit = next((i for i in range(len(place) - n + 1) if place[i:i + n] == whole), None)
            return None if hit is None else (item_id, 1.0, 1.0, first + hit, first + hit + n)
        share = common_length(masks, n, place) / n
        answered = len(answer & set(place)) / len(answer)
        if share >= s.copied or share >= s.rephrased and answered >= s.answered:
            return item_id, share, answered, first, first + len(place)
        return None

    def find(self, basis: np.ndarray, parts: list[tuple[int, np.ndarray, int, np.ndarray]], found: dict[tuple[int, int], tuple]) -> None:
        """Puts (cosine, common share, answer share, first, last) of the best place into ``found`` by row and item.

        ``parts`` has a row, its words, the first word of a part of them and the words of that part; ``basis`` ends with a row of zeros.
        """
        features, counts = _features([p[3] for p in parts], CELL)
        number = np.repeat(np.arange(len(parts)), counts)
        place = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        # a window is a cell and the next ones of its part; behind them stands the row of zeros
        cells = np.arange(len(number))[:, None] + np.arange(CELLS)
        cells[place[:, None] + np.arange(CELLS) >= counts[number][:, None]] = len(number)
        windows = _sum_rows(_sum_rows(basis, features), cells)[:-1]
        features = np.vstack([features, np.full((1, CELL), FEATURES)])
        vectors = np.ascontiguousarray(self.vectors.T)
        for a in range(0, len(windows), CACHED_WINDOWS):
            near = _unit(windows[a:a + CACHED_WINDOWS]) @ vectors
            flat = np.flatnonzero(near >= self.limits)
            if not len(flat):
                continue
            w, g = flat // near.shape[1], flat % near.shape[1]
            owners = self.owners[g]
            shared = self.table.take(owners[:, None] * (FEATURES + 1) + features[cells[a + w]].reshape(len(w), PASSAGE)).sum(axis=1)
            enough = shared >= self.least[owners]
            for w, g in zip(w[enough].tolist(), g[enough].tolist()):
                row, ids, at, _ = parts[number[a + w]]
                hit = self.check(ids, at + int(place[a + w]) * CELL, g)
                if hit:
                    best = found.get((row, hit[0]))
                    if best is None or (hit[1], float(near[w, g])) > (best[1], best[0]):
                        found[row, hit[0]] = (float(near[w, g]), *hit[1:])


SHAPE = "__row long, item_id long, cosine double, common_share double, answer_share double, first_word long, last_word long"


def leaks(coded: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(__row, item_id, cosine, common_share, answer_share, first_word, last_word): the best place of each item in each row.

    ``benchmark`` has item_id, text and perhaps answer; it is the stated query set and is met with all rows in
    blocks of ``items_per_block`` items, so what is sent to the workers stays bounded. Every passage of
    every document is compared with every passage of the items; the whole text takes part.
    """
    idf = passage_weights(coded)
    basis = latent_basis(coded, idf, settings)
    known = _known()
    columns = ["text", "answer"] if "answer" in benchmark.columns else ["text"]
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), *columns).toLocalIterator()

    def search(block: list[tuple]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            items, table, step = _Items(block, basis, idf, settings), _and_zero(basis), CHUNK_WORDS // CELL * CELL
            for frame in frames:
                found: dict[tuple[int, int], tuple] = {}
                held, n = [], 0
                for row, raw in zip(frame["__row"], frame["__ids"]):
                    ids = np.frombuffer(raw, np.uint32)
                    for at in range(0, len(ids), step):  # a part takes the cells that its last windows need along
                        held.append((row, ids, at, ids[at:at + step + PASSAGE - CELL]))
                        n += len(held[-1][3])
                        if n >= CHUNK_WORDS:
                            items.find(table, held, found)
                            held, n = [], 0
                if held:
                    items.find(table, held, found)
                out = [(row, item, *hit) for (row, item), hit in found.items()]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SHAPE.split(", ")])

        return coded.select("__row", "__ids").mapInPandas(run, SHAPE)

    found, block = None, []
    for r in rows:
        block.append((r["item_id"], *(np.frombuffer(word_ids(r[c], known), np.uint32) for c in columns)))
        if len(block) == settings.items_per_block:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, common_share, answer_share, first_word, last_word) for each document that holds an item.

    Null and empty texts and items never match. Items of equal text are all reported; repeated rows are
    reported once each. With an empty table of either kind the result is empty.
    """
    coded = encoded(docs.select("doc_id", "text"), keep_text=False)
    return coded.select("__row", "doc_id").join(leaks(coded, benchmark, settings), "__row").drop("__row")


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; other rows stay as they are."""
    coded = encoded(docs)
    found = stable(leaks(coded, benchmark, settings).select("__row").distinct())
    return coded.join(found, "__row", "left_anti").select(*docs.columns)
