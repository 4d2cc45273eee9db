"""Language spans of mixed-language text: script ranges, per-word scores and Viterbi with a switching penalty."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# First and last code points of the letters of a script: fixed values (Unicode blocks).
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Arabic", 0x750, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Gurmukhi", 0xA00, 0xA7F),
    ("Gujarati", 0xA80, 0xAFF), ("Tamil", 0xB80, 0xBFF), ("Telugu", 0xC00, 0xC7F), ("Kannada", 0xC80, 0xCFF), ("Malayalam", 0xD00, 0xD7F), ("Sinhala", 0xD80, 0xDFF),
    ("Thai", 0xE00, 0xE7F), ("Lao", 0xE80, 0xEFF), ("Tibetan", 0xF00, 0xFFF), ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F), ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x3FFFF))
NAMES = ("Other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
BUCKETS = 1 << 15
SLICE = 1 << 20  # characters scored at a time: bounds memory for one very long text
SMALL_SHARE = 0.01  # a language is a candidate for a script that has this share of its learned letters


class _Letters:
    """Lower-case form (0 if not a letter) and script number of every code point."""

    def __init__(self):
        self.lower, self.script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for name, first, last in SCRIPTS:
            self.script[first:last + 1] = NAMES.index(name)
        marks = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc"}
        for cp in range(0x32400):
            c = chr(cp)
            if unicodedata.category(c) in marks and (c.isalpha() or cp >= 0x300):
                low = c.lower()
                self.lower[cp] = ord(low) if len(low) == 1 else cp


_LETTERS: list[_Letters] = []


def _letters() -> _Letters:
    if not _LETTERS:
        _LETTERS.append(_Letters())
    return _LETTERS[0]


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of at most about SLICE characters, cut after white space where there is any."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space > at else end
        yield at, text[at:end]
        at = end


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters, the bucket of each letter's trigram (0 stands for a word boundary) and its script."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    low = table.lower[points]
    at = np.flatnonzero(low)
    padded = np.zeros(len(low) + 2, np.uint32)
    padded[1:-1] = low
    h = padded[at] * np.uint32(2654435761) ^ padded[at + 1] * np.uint32(2246822519) ^ padded[at + 2] * np.uint32(3266489917)
    return at, (h ^ h >> np.uint32(15)) & np.uint32(BUCKETS - 1), table.script[points[at]]


@dataclass
class Model:
    """Log probabilities of trigram buckets and candidate flags of scripts, per language."""
    langs: list[str]
    scores: np.ndarray  # buckets x languages
    candidates: np.ndarray  # scripts x languages
    penalty: float

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last letter position, letters and scores of every word."""
        parts = []
        for offset, part in _slices(text if self.langs else ""):
            at, bucket, script = _grams(part)
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            total = np.add.reduceat(self.scores[bucket], first, axis=0)
            able = self.candidates[script[first]]
            total = np.where(able | ~able.any(axis=1, keepdims=True), total, total.min(axis=1, keepdims=True) - 50.0)
            last = np.append(first[1:], len(at)) - 1
            parts.append((at[first] + offset, at[last] + offset, last - first + 1, total))
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, len(self.langs)), np.float32),)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def path(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi labels: scores minus ``penalty`` for every switch are greatest; ties go to the earlier language."""
        best = int(scores.sum(axis=0, dtype=np.float64).argmax())
        # no stretch of words gains more elsewhere than a switch costs: then one language is the best path
        gain = np.cumsum(scores.max(axis=1) - scores[:, best], dtype=np.float64)
        floor = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
        if (gain - floor).max() <= self.penalty:
            return np.full(len(scores), best)
        n, state, came = len(self.langs), scores[0].tolist(), []
        penalty = self.penalty
        for row in scores[1:].tolist():
            top = max(range(n), key=state.__getitem__)
            jump = state[top] - penalty
            came.append([k if state[k] >= jump else top for k in range(n)])
            state = [max(state[k], jump) + row[k] for k in range(n)]
        out = [max(range(n), key=state.__getitem__)]
        for back in reversed(came):
            out.append(back[out[-1]])
        return np.array(out[::-1])

    def predict(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """Language with the most letters, its share of letters, and the spans as (start, end, language) in code points."""
        first, last, letters, scores = self.words(text or "")
        if not len(first) or not self.langs:
            return "und", 0.0, []
        path = self.path(scores)
        share = np.bincount(path, weights=letters, minlength=len(self.langs))
        top = int(share.argmax())
        starts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = np.append(starts[1:], len(path)) - 1
        return self.langs[top], float(share[top] / share.sum()), [(int(first[a]), int(last[b]) + 1, self.langs[path[a]]) for a, b in zip(starts, ends)]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def learn(train: DataFrame, penalty: float = 12.0, smoothing: float = 0.5) -> Model:
    """Counts trigrams and scripts of every row of ``train(text, lang)`` that has a language.

    Each task adds up its own counts, so rows of a frequent language are pre-aggregated; the model that
    reaches the driver has at most languages x 32,768 counts, however many rows there are. Without any
    row the model knows no language and predicts ``und``.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)
                for _, part in _slices(text or ""):
                    _, bucket, script = _grams(part)
                    if len(bucket) > 2000:
                        grams[lang] += np.bincount(bucket, minlength=BUCKETS)
                    else:
                        np.add.at(grams[lang], bucket, 1)
                    scripts[lang] += np.bincount(script, minlength=len(NAMES))
        for lang, total in grams.items():
            both = np.concatenate([total, scripts[lang]])
            at = np.flatnonzero(both)
            yield pd.DataFrame({"lang": lang, "slot": at, "n": both[at]})
            yield pd.DataFrame({"lang": [lang], "slot": [-1], "n": [1]})

    rows = train.where(F.col("lang").isNotNull()).select("text", "lang").mapInPandas(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)))
    rows = rows[rows["slot"] >= 0]
    counts[rows["slot"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = rows["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + smoothing) / (grams.sum(axis=0) + smoothing * BUCKETS)) if langs else np.zeros((BUCKETS, 0))
    return Model(langs, scores.astype(np.float32), scripts >= SMALL_SHARE * np.maximum(scripts.sum(axis=0), 1), penalty)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
SCHEMA = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """Adds the struct ``name`` (lang_pred, score, spans) to every row.

    Script ranges leave a word only the languages that use its script; Viterbi then labels words, and
    a switch of language costs ``model.penalty``. The prediction is the language with the most letters, the
    score its share of them. A text that is null, empty or without a letter is ``und`` with score 0 and no
    span. Ties go to the language that sorts first. Other columns stay as they are.
    """
    @F.pandas_udf(SCHEMA)
    def language(texts: pd.Series) -> pd.DataFrame:
        rows = [model.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "spans": [[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows]})

    return docs.withColumn(name, language(F.col(text)))


@F.pandas_udf(T.BooleanType())
def has_letter(texts: pd.Series) -> pd.Series:
    """Whether ``identify`` finds a letter in the text, whatever a model knows."""
    return pd.Series([any(len(_grams(part)[0]) for _, part in _slices(t or "")) for t in texts], dtype=bool)
