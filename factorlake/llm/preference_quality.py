"""Document quality from pairwise preferences: Bradley-Terry strengths by logistic loss on feature differences."""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "bar", "quote", "dash", "bracket", "symbol", "control", "other")
FEATURES = ("log_chars", "log_words", "log_lines", *KINDS, "word_length", "word_spread", "distinct_words", "repeated_next", "top_word", "distinct_lines", "line_words", "symbol_ends", "stop_ends", "all_caps", "long_words")
SLICE = 1 << 20


def _kind_table() -> np.ndarray:
    table = np.full(0x110000, KINDS.index("other"), np.uint8)
    groups = {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lm": "lower", "Lo": "lower", "Mn": "lower", "Mc": "lower", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "space", "Zl": "newline", "Zp": "newline",
              "Cc": "control", "Cf": "control", "Pd": "dash", "Ps": "bracket", "Pe": "bracket", "Pi": "quote", "Pf": "quote", "Sm": "symbol", "Sc": "symbol", "Sk": "symbol", "So": "symbol", "Po": "symbol", "Pc": "symbol"}
    for cp in range(0x32400):
        table[cp] = KINDS.index(groups.get(unicodedata.category(chr(cp)), "other"))
    for chars, kind in ((".?…。", "stop"), (",;:、", "comma"), ("!¡", "bang"), ("|", "bar"), ("'\"’“”", "quote"), ("\n\r", "newline"), ("\t", "space")):
        for c in chars:
            table[ord(c)] = KINDS.index(kind)
    return table


_KINDS: list[np.ndarray] = []


def features(text: str | None) -> list[float]:
    """Shares and rates of the whole text; a null, empty or blank text has zeros."""
    text = text or ""
    if not _KINDS:
        _KINDS.append(_kind_table())
    counts = np.zeros(len(KINDS), np.int64)
    for at in range(0, len(text), SLICE):
        counts += np.bincount(_KINDS[0][np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(KINDS))
    words, n_chars = text.split(), max(1, len(text))
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    # distinct words fall with length in any text: compared over consecutive windows of 100 words
    windows = [words[i:i + 100] for i in range(0, len(words), 100)]
    distinct = sum(len(set(w)) for w in windows) / n
    return [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *(counts / n_chars).tolist(), float(lengths.mean()), float(lengths.std()), distinct,
            sum(a == b for a, b in zip(words, words[1:])) / n, max(Counter(words).values(), default=0) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n, sum(w[-1] in ".?!" for w in words) / n,
            sum(w.isupper() and len(w) > 1 for w in words) / n, float((lengths > 20).mean())]


@dataclass
class Model:
    """Strength of a document: the sum of the weights of the bins its features fall into; ``scale`` and ``shift`` make a score of it."""
    edges: np.ndarray  # features x (bins - 1)
    weights: np.ndarray  # features x bins
    scale: float
    shift: float
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        return self.weights[np.arange(len(self.edges)), at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.strength(x) + self.shift, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.3, bins: int = 12, pairs: int = 60_000, rounds: int = 12, ridge: float = 1.0, seed: int = 7) -> Model:
    """Bradley-Terry strengths from preferences of label 1 over label 0.

    ``pairs`` preference pairs are drawn; every one of them asks that the preferred document be stronger by
    logistic loss on the difference of binned features, solved by Newton steps with a ridge. The
    share of label 0 gives the quantile of strengths below which documents are rejected: scores are
    calibrated so that this quantile has the score ``threshold``. With one class only, every
    score is that class's.
    """
    flat = Model(np.zeros((x.shape[1], 1)), np.zeros((x.shape[1], 2)), 1.0, 40.0 if not len(y) or y.all() else -40.0, threshold)
    if not 0 < y.sum() < len(y):
        return flat
    edges = np.quantile(x, np.arange(1, bins) / bins, axis=0).T
    at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) + np.arange(x.shape[1]) * bins
    draw = np.random.default_rng(seed)
    good, bad = draw.choice(np.flatnonzero(y == 1), pairs), draw.choice(np.flatnonzero(y == 0), pairs)
    width = bins * x.shape[1]
    w = np.zeros(width)
    hot = np.zeros((len(x), width), np.float32)
    hot[np.arange(len(x))[:, None], at] = 1
    for _ in range(rounds):
        gradient, hessian = -ridge * w, ridge * np.eye(width)
        for i in range(0, pairs, 4096):
            d = hot[good[i:i + 4096]] - hot[bad[i:i + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # probability that the preference is broken
            gradient += d.T @ p
            hessian += (d * (p * (1 - p))[:, None].astype(np.float32)).T @ d
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    model = Model(edges, w.reshape(x.shape[1], bins), 1.0, 0.0, threshold)
    strength = model.strength(x)
    cut = np.quantile(strength, 1 - y.mean())
    # the slope of a logistic curve through the cut, fitted to the labels
    logit = np.log(threshold / (1 - threshold))
    slopes = np.geomspace(0.02, 20, 60)
    z = np.clip(slopes[:, None] * (strength - cut)[None, :] + logit, -40, 40)
    loss = np.where(y == 1, np.log1p(np.exp(-z)), np.log1p(np.exp(z))).mean(axis=1)
    model.scale = float(slopes[loss.argmin()])
    model.shift = float(logit - model.scale * cut)
    return model


def learn(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> Model:
    """Fits on at most ``max_rows`` rows of ``labels(doc_id, quality)``, those whose doc_id has the smallest hash.

    The bound holds what is broadcast (ids with labels) and what reaches the driver (features, no
    texts). Rows without a doc_id or label are left out, labels without a document have no effect.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    found = with_features(met.select("text", "y", "id")).select("features", "y", "id").toPandas().sort_values(["id", "y"])
    x = np.array(found["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["y"].to_numpy(np.int64), threshold)


def with_features(docs: DataFrame) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return docs.withColumn("features", extract(F.col("text")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score reaches the model's threshold) from the whole ``text``.

    One pass without a shuffle; only the text is read. Null texts count as empty and are scored like any
    other; repeated rows get equal scores; other columns stay as they are.
    """
    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    scored = docs.withColumn("score", scores(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
