"""Packs token pieces into sequences of fixed capacity by bin completion."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import stable

# Texts of these characters alone need no Unicode composition, have one-character lower-case forms and no other white
# space; "<|" could begin one of the tokenizer's special strings.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\|")
LATIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
# Splitting rule of the tokenizer file: a fixed value.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_WORDS = 400_000
TOGETHER = 64  # texts whose new words are encoded in one call
FLUSH_BYTES = 8 << 20


def _unusual(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return UNUSUAL.search(text) is not None
    return bool(raw.translate(None, LATIN)) or b"<|" in raw


def _cut(word: str) -> list[str]:
    """The parts of a word. Letters, or letters and then signs, need no pattern: the signs at the end are one part."""
    core = word.rstrip(SIGNS)
    if core.isalpha():
        return [core] if len(core) == len(word) else [core, word[len(core):]]
    return PART.findall(word)


class _Encoder:
    """Token ids as little-endian 32-bit bytes. The tokenizer joins nothing across its parts of a text, and the last token
    of each part carries the word end; so parts are encoded once, many in one call, and cached, and so are the runs
    of parts between white space. A text with any unusual character goes to the tokenizer whole. What reaches ``plain`` is
    lower-case, composed and cut already: it has the same model, but only splits at spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.model, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, new: set[str]) -> None:
        cut = {w: _cut(w) for w in new}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        missing = list({p for parts in cut.values() for p in parts}.difference(self.parts))
        if missing:
            ids = np.array(self.plain.encode_batch_fast([" ".join(missing)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            raw = ids.tobytes()
            self.parts.update((p, raw[4 * a:4 * b]) for p, a, b in zip(missing, cuts[:-1], cuts[1:], strict=True))
        known = self.parts
        self.words.update((w, known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])) for w, parts in cut.items())

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [_unusual(t) for t in texts]
        split = [() if odd else t.lower().split() for t, odd in zip(texts, whole)]
        used = set().union(*split)
        new = used.difference(self.words)
        if new:
            if len(self.words) + len(new) > CACHE_WORDS:
                new = used
            self._learn(new)
        get = self.words.__getitem__
        return [np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if odd else b"".join(map(get, words)) for t, odd, words in zip(texts, whole, split)]


@functools.lru_cache(1)
def _encoder(path: str) -> _Encoder:
    """One per Python worker: later tasks of the worker find the words of the earlier ones."""
    return _Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids) per piece; ``ids`` are little-endian unsigned 32-bit token ids.

    Each text (null: empty) is encoded whole and gets ``end_id``; only longer ones are cut, into pieces of
    ``capacity`` tokens with a shorter last one. ``tokenizer_path`` must exist on the workers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, held = _encoder(tokenizer_path), [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(first, TOGETHER)
                for doc, ids in zip(some.column(0).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        rows.append((doc, k, at // 4, len(part) // 4, part))
                        held += len(part)
                if held > FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class _Completion:
    """Bin completion over a histogram of lengths.

    A bin starts with the largest piece left. Its fillings, of any number of pieces, are searched depth first
    from the largest pieces on, with what is taken counted off; of the fillings of one sum only the first
    counts. The bound is exact: the sums that the lengths up to each one can reach are bits of a number,
    so the least waste is known and no branch that misses it is entered. The best-fit pair is the
    incumbent and ends the search if it wastes nothing. The filling is used as often as its lengths last.
    With ``lead`` the largest piece that fits is taken first and the search fills the rest.
    """

    def __init__(self, counts: np.ndarray, capacity: int, lead: bool = False):
        self.left, self.capacity, self.lead = counts.astype(np.int64).copy(), capacity, lead
        self._refresh()

    def _refresh(self) -> None:
        at = np.arange(self.capacity + 1)
        self.below = np.maximum.accumulate(np.where(self.left > 0, at, 0))  # largest length left that is not above
        self.lengths = np.flatnonzero(self.left > 0)[::-1]

    def _pair(self, room: int) -> list[int]:
        """At most two lengths of the largest sum within ``room``, the larger one as large as possible."""
        one = int(self.below[room])
        if one == room or one == 0:
            return [one] if one else []
        a = self.lengths[np.searchsorted(-self.lengths, -room):]
        b = self.below[room - a]
        b = np.where((b >= a) & (self.left[a] < 2), self.below[a - 1], np.minimum(b, a))
        total = a + b
        i = int(np.argmax(total))
        return [int(a[i]), *([int(b[i])] if b[i] else [])]

    def _fill(self, room: int) -> list[int]:
        """The pieces of least waste within ``room``; as many of the largest as possible, then of the next."""
        best = self._pair(room)
        if not best or sum(best) == room:
            return best
        every = (1 << room + 1) - 1
        sums, sizes = [1], self.lengths[np.searchsorted(-self.lengths, -room):][::-1].tolist()
        for x in sizes:  # sums[i]: bit s is set if pieces of the i smallest lengths can have the sum s
            reach, rest, step = sums[-1], min(int(self.left[x]), room // x), 1
            while rest and reach != every:
                step = min(step, rest)
                reach |= reach << step * x & every
                rest, step = rest - step, 2 * step
            sums.append(reach)
        room, taken = sums[-1].bit_length() - 1, []
        for i in range(len(sizes) - 1, -1, -1):
            x = sizes[i]
            if x > room:
                continue
            n = min(int(self.left[x]), room // x)
            while not sums[i] >> room - n * x & 1:
                n -= 1
            taken += [x] * n
            room -= n * x
            if not room:
                break
        return taken

    def patterns(self) -> Iterator[tuple[list[int], int]]:
        while len(self.lengths):
            top = int(self.lengths[0])
            self.left[top] -= 1
            if not self.left[top]:
                self._refresh()
            first = [x] if self.lead and (x := int(self.below[self.capacity - top])) else []
            for x in first:
                self.left[x] -= 1
                if not self.left[x]:
                    self._refresh()
            filling = first + self._fill(self.capacity - top - sum(first))
            for x in [top, *first]:
                self.left[x] += 1
            items = sorted([top, *filling], reverse=True)
            times = int(min(self.left[x] // items.count(x) for x in set(items)))
            for x in items:
                self.left[x] -= times
            self._refresh()
            yield items, times


class _Spent(Exception):
    """The search has used up its work."""


class _Search:
    """Branch and bound over bins: a packing that wastes at most ``slack`` in all, or the proof that there is none.

    Each level fills the bin of the largest piece left. Its fillings come in order of their waste, up to
    what is left of the slack: that is the bound that prunes. The sums that the smaller lengths reach are bits of
    a number, so only fillings of exactly the asked sum are built. A filling is dominated, and skipped, if a piece
    left over could take the place of one or two of its pieces. States that failed with as much slack are
    not entered again. A filling is used as often as its lengths last or, unless ``whole``, once.
    ``work`` bounds the number of levels entered times their lengths.
    """

    def __init__(self, capacity: int, work: int, whole: bool):
        self.capacity, self.work, self.whole, self.failed = capacity, work, whole, {}

    def _exact(self, sizes: list[int], left: dict[int, int], sums: list[int], i: int, target: int) -> Iterator[list[int]]:
        """Fillings of exactly ``target`` from the ``i`` smallest sizes, larger pieces first."""
        while target and i:
            i -= 1
            x = sizes[i]
            for n in range(min(left[x], target // x), 0, -1):
                if sums[i] >> target - n * x & 1:
                    for rest in self._exact(sizes, left, sums, i, target - n * x):
                        yield [x] * n + rest
            if not sums[i] >> target & 1:
                return
        if not target:
            yield []

    def _dominated(self, filling: list[int], left: dict[int, int], sizes: list[int], waste: int) -> bool:
        spare = [x for x in sizes if left[x] > filling.count(x)]
        distinct = sorted(set(filling))
        swaps = set(distinct) | {a + b for k, a in enumerate(distinct) for b in distinct[k:] if a != b or filling.count(a) > 1}
        for y in swaps:  # a single piece must grow; two pieces may give way to one of their own sum
            k = bisect.bisect_right(spare, y + waste)
            if k and (spare[k - 1] > y or spare[k - 1] == y and y not in distinct):
                return True
        return False

    def run(self, left: dict[int, int], slack: int) -> list[tuple[list[int], int]] | None:
        if not left:
            return []
        state = tuple(sorted(left.items()))
        if self.failed.get(state, -1) >= slack:
            return None
        self.work -= len(left)
        if self.work < 0:
            raise _Spent
        top = max(left)
        room, rest = self.capacity - top, {x: n - (x == top) for x, n in left.items() if n > (x == top)}
        sizes = sorted(x for x in rest if x <= room)
        every, sums = (1 << room + 1) - 1, [1]
        for x in sizes:
            reach, n, step = sums[-1], min(rest[x], room // x), 1
            while n and reach != every:
                step = min(step, n)
                reach |= reach << step * x & every
                n, step = n - step, 2 * step
            sums.append(reach)
        for waste in range(min(slack, room) + 1):
            if not sums[-1] >> room - waste & 1:
                continue
            for filling in self._exact(sizes, rest, sums, len(sizes), room - waste):
                if waste and self._dominated(filling, rest, sizes, waste):
                    continue
                items = [top, *filling]
                most = min(left[x] // items.count(x) for x in set(items))
                most = min(most, slack // waste) if waste else most
                for times in (most,) if self.whole else dict.fromkeys((most, 1)):
                    after = {x: m for x, n in left.items() if (m := n - times * items.count(x))}
                    found = self.run(after, slack - times * waste)
                    if found is not None:
                        return [(items, times), *found]
        self.failed[state] = slack
        return None


def _repacked(part: list[tuple[list[int], int]], capacity: int, bins: int, work: int, whole: bool) -> list[tuple[list[int], int]] | None:
    """The pieces of ``part`` in ``bins`` bins, if the search finds such a packing."""
    left: dict[int, int] = {}
    for items, times in part:
        for x in items:
            left[x] = left.get(x, 0) + times
    slack = bins * capacity - sum(x * n for x, n in left.items())
    if slack < 0:
        return None
    try:
        return _Search(capacity, work, whole).run(left, slack)
    except (_Spent, RecursionError):
        return None


def _improved(patterns: list[tuple[list[int], int]], capacity: int, fewest: int, work: int) -> list[tuple[list[int], int]] | None:
    """A plan of fewer sequences, if the search finds one: first over all pieces, then over the bins that waste most."""
    used = sum(n for _, n in patterns)
    if len(patterns) <= 400:
        low, high, best = fewest, used - 1, None
        while low <= high:  # fillings used as often as they last; a goal that was not met is taken as too low
            goal = (low + high) // 2
            found = _repacked(patterns, capacity, goal, work, True)
            low, high, best = (low, goal - 1, found) if found is not None else (goal + 1, high, best)
        best = best if best is not None else _repacked(patterns, capacity, used - 1, work, False)
        if best is not None:
            return best
    single = [(items, 1) for items, times in sorted(patterns, key=lambda p: sum(p[0])) for _ in range(min(times, 64))][:64]
    for size in (4, 8, 16, 32, 64):
        found = _repacked(single[:size], capacity, size - 1, work, False) if len(single) >= size else None
        if found is not None:
            kept: dict[tuple, int] = {}
            for items, times in patterns:
                kept[tuple(items)] = kept.get(tuple(items), 0) + times
            for items, _ in single[:size]:
                kept[tuple(items)] -= 1
            return [(list(items), times) for items, times in kept.items() if times] + found
    return None


def plan(counts: np.ndarray, capacity: int, work: int = 100_000) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): the pieces of a length take sequences by their rank.

    ``counts[n]`` is the number of pieces of length n. Every pattern uses up a length, so there are not many
    more patterns than lengths, whatever the number of pieces. The best-fit plan and one that takes the largest
    fitting piece first are the incumbents; while the better one needs more sequences than the total length
    admits, branch and bound looks for a plan of fewer, each search within ``work`` (levels entered times lengths):
    what it returns is an improvement, and without one the incumbent stays.
    """
    fewest = -(-int(counts @ np.arange(len(counts))) // capacity)
    used = lambda p: sum(n for _, n in p)
    patterns = list(_Completion(counts, capacity).patterns())
    if used(patterns) > fewest:
        patterns = min(patterns, list(_Completion(counts, capacity, lead=True).patterns()), key=used)
    while used(patterns) > fewest and (better := _improved(patterns, capacity, fewest, work)) is not None:
        patterns = better
    nextrank, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for items, times in patterns:
        offset = 0
        for x in items:
            rows.append((x, nextrank[x], sequence, offset))
            nextrank[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = 4096, cell_rows: int = 50_000) -> DataFrame:
    """``cut`` (a stored table with doc_id, piece and length) with sequence_id and offset.

    Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver; the plan that goes back
    is bounded by it as well. Pieces are ranked within their length; a length that very many pieces
    share is ranked in cells by hash, whose counts give each cell its first rank. Lengths lie from 1
    to ``capacity``. Repeated rows and null ids are pieces of their own. An empty table gives no sequence.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        histogram[length] = n
    slots = plan(histogram, capacity)
    span = int(histogram.sum()) + 1
    keys, sequences, offsets, ranks = slots[:, 0] * span + slots[:, 1], slots[:, 2], slots[:, 3], slots[:, 1]
    cells = max(64, int(histogram.sum()) // cell_rows)
    celled = cut.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)))
    starts = celled.groupBy("length", "__cell").count().withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__cell")) - F.col("count")).drop("count")
    own = Window.partitionBy("length", "__cell").orderBy("doc_id", "piece")
    ranked = celled.withColumn("__n", F.row_number().over(own)).join(starts, ["length", "__cell"]).withColumn("__rank", F.col("__before") + F.col("__n") - 1)

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - ranks[at], "offset": offsets[at]})

    return ranked.withColumn("__slot", slot("length", "__rank")).select(*cut.columns, "__slot.sequence_id", "__slot.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) per piece of every document.

    With ``keep_ids`` False the token ids are dropped after their checksum, so that ranking moves only numbers.
    """
    cut = pieces(docs, tokenizer_path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return place(stable(cut.select(*columns)), capacity)
