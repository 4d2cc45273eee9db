"""Collocations from depth-truncated suffix trees, built group by group over vertically partitioned word prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stable

WORD_BITS = 1 << 27  # slots for frequent words: 16 MB however many words there are
PREFIX_BITS = 1 << 24  # slots for prefixes over the budget
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(PIECE_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(PIECE_ENDS) + b" " + bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers words as they come; 1 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(batches: Iterable[pa.RecordBatch], chunk_words: int) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, words, ids) of whole texts; id 0 is a piece end. A task holds about ``chunk_words`` words at a time."""
    held: dict[str, tuple[_Ids, list[np.ndarray], int]] = {}
    total = 0

    def close(lang: str) -> tuple[str, list[bytes], np.ndarray]:
        ids, parts, _ = held.pop(lang)
        return lang, list(ids)[1:], np.concatenate(parts)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            ids, parts, n = held.get(lang) or (_Ids({b"": 0, b"\n": 1}), [], 0)
            tokens = (text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(b"\n", b" \n ") + b" \n").split(b" ")
            found = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
            found = found[found > 0]
            parts.append(found - 1)
            held[lang] = (ids, parts, n + len(found))
            total += len(found)
            if total >= chunk_words:
                full = max(held, key=lambda k: held[k][2])
                total -= held[full][2]
                yield close(full)
    for lang in list(held):
        yield close(lang)


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """One 64-bit number per word of a language; 0 for the piece end."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([0, *[xxhash.xxh3_64_intdigest(w, seed) for w in words[1:]]], np.uint64)


def _longer(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The number of a prefix that one more word lengthens."""
    h = (h ^ (following + _MIX)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ h >> np.uint64(32)) * np.uint64(0xC4CEB9FE1A85EC53)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _bitmap(slots: DataFrame, size: int) -> np.ndarray:
    """The bits that ``slots(slot)`` names; Spark builds them in blocks of 4 KB, so size / 8 bytes reach the driver at most."""
    bits = np.zeros(size // 8, np.uint8)
    position, bucket = F.bitmap_bit_position("slot"), F.bitmap_bucket_number("slot")
    for row in slots.groupBy(bucket.alias("b")).agg(F.bitmap_construct_agg(position).alias("bits")).collect():
        bits[(row["b"] - 1) * 4096:row["b"] * 4096] = np.frombuffer(row["bits"], np.uint8)[:len(bits) - (row["b"] - 1) * 4096]
    return bits


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    """Positions that count from 1, as Spark's bitmaps do."""
    return (h & np.uint64(size - 1)).astype(np.int64) + 1


def _word_counts(texts: DataFrame, chunk_words: int) -> DataFrame:
    """(lang, phrase, slot, f) of every word."""
    def count(batches):
        for lang, words, ids in _chunks(batches, chunk_words):
            n = np.bincount(ids, minlength=len(words))[1:]
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(words[1:], pa.binary()).cast(pa.string()), pa.array(_slot(_hashes(lang, words)[1:], WORD_BITS)), pa.array(n)],
                                                 names=["lang", "phrase", "slot", "f"])

    rows = texts.mapInArrow(count, "lang string, phrase string, slot long, f long")
    return rows.groupBy("lang", "phrase", "slot").agg(F.sum("f").alias("f"))


def _pairs(h: np.ndarray, ids: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word and next word are both frequent and of one piece, and the numbers of these pairs."""
    ok = _has(frequent, h)
    ok[0] = False
    ok = ok[ids]
    at = np.flatnonzero(ok[:-1] & ok[1:])
    return at, _longer(h[ids[at]], h[ids[at + 1]])


def _suffixes(h: np.ndarray, ids: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (rows x depth word ids, 0 behind the end) of at least two words, one per position that starts one,
    the length of their partition prefix, their own length, and the running prefix numbers.

    A suffix ends with its piece or before a word or a pair of words that is not frequent: no phrase across
    it can be. The partition prefix is the shortest one that is not over the budget; its length is one more
    than the suffix has words if all its prefixes are over. ``known``: frequent words, frequent pairs, prefixes over the budget.
    """
    frequent, paired, hot = known
    at, mark = _pairs(h, ids, frequent)
    start = at[_has(paired, mark)]
    joined = np.zeros(len(ids) + depth, bool)
    joined[start] = True
    padded = np.append(ids, np.zeros(depth, ids.dtype))
    rows = padded[start[:, None] + np.arange(depth)]
    rows[:, 1:][~np.logical_and.accumulate(joined[start[:, None] + np.arange(depth - 1)], axis=1)] = 0
    length = (rows > 0).sum(axis=1)
    marks = np.empty((len(rows), depth), np.uint64)
    marks[:, 0] = h[rows[:, 0]]
    at = np.ones(len(rows), np.int8)
    grows = np.ones(len(rows), bool)
    for k in range(1, depth):
        marks[:, k] = _longer(marks[:, k - 1], h[rows[:, k]])
        grows &= _has(hot, marks[:, k - 1]) & (length >= k)
        at += grows
    return rows, at, length, marks


def _phrases(rows: np.ndarray, words: list[bytes]) -> pa.Array:
    """Space-joined words of every row."""
    names = pa.array([None, *words[1:]], pa.binary()).cast(pa.string())
    columns = [names.take(pa.array(rows[:, k])) for k in range(rows.shape[1])]
    return pc.binary_join_element_wise(*columns, " ", null_handling="skip")


def _leaves(rows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in tree order: (sorted distinct rows, their totals, index of one original row each)."""
    bits = max(1, int(rows.max(initial=0)).bit_length())
    per = 62 // bits
    keys = []
    for i in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for k in range(i, min(i + per, rows.shape[1])):
            key = key << bits | rows[:, k]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(rows), bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(change)
    weights = np.ones(len(rows), np.int64) if weights is None else weights
    totals = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
    return rows[order[first]], totals, order[first]


def _counted(texts: DataFrame, chunk_words: int, numbers) -> DataFrame:
    """(h, f): how often each prefix number occurs among those that ``numbers(hashes, ids)`` finds; a 64-bit sum of equal numbers."""
    def count(batches):
        for lang, words, ids in _chunks(batches, chunk_words):
            h, n = np.unique(numbers(_hashes(lang, words), ids), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "f"])

    return texts.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _slots(numbers: DataFrame, size: int) -> DataFrame:
    return numbers.select((F.col("h").bitwiseAND(F.lit(size - 1)) + 1).alias("slot"))


def _subtree(packed: pa.Table, min_count: int, depth: int) -> pa.Table:
    """Counts of the nodes of one group's tree: the totals of the leaves below each. A row packs the leaves of one chunk of a task.

    A node above the partition depth has leaves in other groups too: it is returned whatever its count, to
    be added up; of the others those below ``min_count`` are left out.
    """
    t = packed.combine_chunks()
    langs = pa.concat_arrays(t["lang"].chunks).dictionary_encode()
    lists = [pa.concat_arrays(t[c].chunks) for c in ("phrase", "at", "f")]
    lang = np.repeat(langs.indices.to_numpy(), pc.list_value_length(lists[0]).to_numpy())
    phrases, depths, f = (x.flatten() for x in lists)
    parts = pc.split_pattern(phrases, " ")
    flat = parts.flatten().dictionary_encode()
    offsets = parts.offsets.to_numpy()
    length = np.diff(offsets)
    rows = np.zeros((len(length), depth + 1), np.int64)
    rows[:, 0] = lang + 1
    of = np.repeat(np.arange(len(length)), length)
    rows[of, np.arange(len(of)) - np.repeat(offsets[:-1] - offsets[0], length) + 1] = flat.indices.to_numpy() + 1
    leaves, totals, index = _leaves(rows, f.to_numpy())
    at = depths.to_numpy()[index]
    words = flat.dictionary
    out = []
    for k in range(2, depth + 1):
        deep = leaves[:, k] > 0
        top, n, start = leaves[deep], totals[deep], at[deep]
        if not len(top):
            break
        first = np.flatnonzero(np.append(True, (top[1:, :k + 1] != top[:-1, :k + 1]).any(axis=1)))
        f = np.add.reduceat(n, first)
        keep = (f >= min_count) | (start[first] > k)
        nodes = top[first[keep]]
        columns = [words.take(pa.array(nodes[:, i] - 1)) for i in range(1, k + 1)]
        out.append(pa.table({"lang": langs.dictionary.take(pa.array(nodes[:, 0] - 1)), "k": pa.array(np.full(len(nodes), k, np.int32)), "phrase": pc.binary_join_element_wise(*columns, " "), "f": pa.array(f[keep])}))
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    return pa.concat_tables([o.cast(schema) for o in out]) if out else schema.empty_table()


def phrase_counts(docs: DataFrame, most_words: int = 5, min_count: int = 100, text: str = "text", lang: str = "lang", budget: int = 500_000, chunk_words: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of every phrase of 1 to ``most_words`` words found ``min_count`` times or more, (lang, n) with all words).

    Words are counted first, then pairs of frequent words. Like ERA's vertical partitioning, word prefixes
    over ``budget`` occurrences are lengthened word by word until they are within it or have ``most_words``
    words; each further round reads the texts again and counts only prefixes whose shorter prefix was over.
    Prefixes are then drawn into groups that hold half a budget on average. Every task builds the suffixes
    of its own texts, cut at ``most_words`` words and before words and pairs that are too rare, adds up equal
    ones and sends them to the group of their prefix; every group builds its subtree on its own and reads
    the counts from the leaf totals.

    What tasks must know is three bit sets of fixed size (frequent words and pairs, prefixes over budget);
    a false hit costs some extra rows, never a count. A frequent phrase costs one row per task, so no group holds copies.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = stable(_word_counts(texts, chunk_words))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    common = words.where(F.col("f") >= min_count)
    frequent = sc.broadcast(_bitmap(common.select("slot"), WORD_BITS))
    # a word's number in the smaller bit set is its number in the larger one without the upper digits
    pairs = stable(_counted(texts, chunk_words, lambda h, ids: _pairs(h, ids, frequent.value)[1]).where(F.col("f") >= min_count))
    paired = sc.broadcast(_bitmap(_slots(pairs, WORD_BITS), WORD_BITS))
    # a word's number in the smaller bit set is its number in the larger one without the upper digits
    over = common.where(F.col("f") > budget).select(((F.col("slot") - 1) % PREFIX_BITS + 1).alias("slot"))
    hot = _bitmap(over, PREFIX_BITS)
    fresh = _bitmap(_slots(pairs.where(F.col("f") > budget), PREFIX_BITS), PREFIX_BITS)
    for length in range(3, most_words + 1):
        hot = hot | fresh
        if length == most_words or not fresh.any():
            break
        marked = sc.broadcast(hot)

        def prefixes(h, ids):
            _, at, size, marks = _suffixes(h, ids, (frequent.value, paired.value, marked.value), most_words)
            return marks[(at == length) & (size >= length), length - 1]

        fresh = _bitmap(_slots(_counted(texts, chunk_words, prefixes).where(F.col("f") > budget), PREFIX_BITS), PREFIX_BITS)
    marked = sc.broadcast(hot)
    total = pairs.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))

    def send(batches):
        for name, vocabulary, ids in _chunks(batches, chunk_words):
            rows, at, size, marks = _suffixes(_hashes(name, vocabulary), ids, (frequent.value, paired.value, marked.value), most_words)
            if len(rows):
                leaves, n, index = _leaves(rows)
                group = (marks[index, np.minimum(at, size)[index] - 1] >> np.uint64(24)) % np.uint64(groups)
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.append(True, group[order[1:]] != group[order[:-1]]))
                cuts = pa.array(np.append(first, len(order)).astype(np.int32))
                columns = [pa.ListArray.from_arrays(cuts, c) for c in (_phrases(leaves[order], vocabulary), pa.array(at[index][order]), pa.array(n[order]))]
                yield pa.RecordBatch.from_arrays([pa.array(group[order[first]].astype(np.int64)), pa.array([name] * len(first)), *columns], names=["grp", "lang", "phrase", "at", "f"])

    sent = texts.mapInArrow(send, "grp long, lang string, phrase array<string>, at array<byte>, f array<long>")

    def build(t: pa.Table) -> pa.Table:
        return _subtree(t, min_count, most_words)

    nodes = sent.groupBy("grp").applyInArrow(build, "lang string, k int, phrase string, f long")
    counted = nodes.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return stable(counted.unionByName(common.select("lang", F.lit(1).alias("k"), "phrase", "f"))), stable(sizes)


def _part(first, count):
    return F.array_join(F.slice("w", first, count), " ")


def scored(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of every phrase of two words or more, by its lowest-scoring cut.

    Both parts of a cut are at least as frequent as the phrase, so ``counts`` holds them. Products are
    38-digit decimals, the quotient is rounded down; ties go to the earliest cut.
    """
    w = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = w.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "k", "phrase", "a", "at", _part(F.lit(1), F.col("at")).alias("left"), _part(F.col("at") + 1, F.col("k") - F.col("at")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(sizes, "lang")
    score = F.expr("CAST((CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)")
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("k", "a", "l", "r", "n", "score"), F.struct("score", "at")).alias("b"))
    return best.select("lang", "phrase", "b.*")


def collocations(docs: DataFrame, most_words: int = 5, min_count: int = 100, top: int = 2000, percent: int = 100, text: str = "text", lang: str = "lang", budget: int = 500_000, chunk_words: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of every language.

    A null language counts as ``und``, null texts are empty. A phrase goes if its words lie side by side in
    a longer counted phrase that has ``percent`` of its count or more. Ranked by score, count and text.
    """
    counts, sizes = phrase_counts(docs, most_words, min_count, text, lang, budget, chunk_words)
    long = counts.where("k > 2").select("lang", "k", "f", F.split("phrase", " ").alias("w"))
    long = long.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    inside = long.groupBy("lang", _part(F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored(counts, sizes).join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return left.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
