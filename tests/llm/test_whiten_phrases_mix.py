"""Whitening, phrase collocations and source mixing against brute force."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from factorlake.llm import phrase_groups, source_mix, whitening

# ---- whitening -----------------------------------------------------------------------------------


def rotated(values, seed=1):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.asarray(values, dtype=np.longdouble)) @ q.T
    return ((a + a.T) / 2).astype(np.float64)


@pytest.mark.parametrize("values", [np.linspace(1, 10, 64), np.r_[np.full(10, 5.0), np.linspace(1, 2, 20)], 1 + 1e-9 * np.arange(30), np.r_[1 + 1e-12 * np.arange(8), 7, 7 + 1e-7, 9],
                                    np.zeros(5), np.array([1.0, 0, 0]), 10.0 ** -np.arange(12), np.array([3.0])])
def test_eigenvectors_are_right_to_double_precision(values):
    a = rotated(values)
    e, x = whitening.refined_eigenvectors(a)
    wide = x.astype(np.longdouble)
    scale = max(1.0, np.abs(values).max())
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-15 * scale * len(values)
    assert np.abs(wide.T @ wide - np.eye(len(values))).max() < 3e-16
    assert np.abs(a.astype(np.longdouble) @ wide - wide * e).max() < 1e-15 * scale
    assert (np.diff(e) <= 0).all()


def brute_whitening(rows, components):
    """Plain numpy over the kept vectors: {(id, component): (n, deviation, |whitened|, explained)}."""
    kept = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    once = sorted({tuple(x) for _, x in kept})
    n, dims = len(once), len(once[0])
    s = [sum(x[j] for x in once) for j in range(dims)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(dims)] for x in once])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for k, x in kept:
        d = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(dims)])
        for c in range(min(components, int((e > 1e-12 * e[0]).sum()))):
            out.append((k, c + 1, n, sum((n * x[j] - s[j]) ** 2 for j in range(dims)), abs(d @ q[:, c]) / math.sqrt(e[c]), e[c] / np.trace(v)))
    return sorted(out, key=lambda r: (str(r[0]), *r[1:]))


def test_whitening_matches_plain_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=6).astype(np.float32) * [3, 2, 1.5, 1, .5, .25]]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # a third of all rows hold one vector
    rows += [(2000, None), (2001, [1.0] * 5 + [float("nan")]), (2002, [1.0] * 5 + [None]), (2003, [float("inf")] * 6), (None, rows[7][1]), (None, rows[7][1])]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    out = whitening.whitened(d, components=4)
    got = sorted([(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in out.collect()], key=lambda r: (str(r[0]), *r[1:]))
    want = brute_whitening(rows, 4)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-12)
    assert out.select("identity_error").distinct().count() == 1 and out.first()["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, []), (3, [None])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance
    few = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in few) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)]


def test_deviation_beyond_a_long_is_masked():
    m = whitening.Whitening(10, np.array([0, 0]), np.ones(1), np.ones((2, 1)), 1.0)
    out = m.deviations(np.array([[1, 2], [2 ** 40, 0]]))
    assert out[0] == 500 and out.mask[1]


# ---- phrases ---------------------------------------------------------------------------------------


def brute_phrases(rows, min_count, percent=100, top=2000, most=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    covered = defaultdict(int)
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                covered[lang, w[i:i + m]] = max(covered[lang, w[i:i + m]], a)
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) in covered and 100 * covered[lang, w] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine[:top])]
    return sorted(ranked)


def phrase_rows(seed=5, docs=150):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "The", "aé", "x\x01", "日本", "b", "c-d", "EE", "f"] + [f"rare{i}" for i in range(400)]
    weights = np.r_[np.array([30, 20, 10, 8, 6, 5, 5, 5, 4, 4.0]), np.full(400, .1)]
    out = []
    for i in range(docs):
        w = rng.choice(words, size=int(rng.integers(0, 120)), p=weights / weights.sum())
        seps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "; "], size=len(w), p=[.7, .05, .05, .05, .05, .05, .025, .025])
        text = "".join(a + b for a, b in zip(w, seps)) + (" One very common line of words here." if i % 3 == 0 else "")
        out.append(([None, "en", "en", "de"][i % 4], text))
    return out + [(None, None), ("en", ""), ("fr", " \t.,\n"), ("en", "the of " * 3000)]


@pytest.mark.parametrize("budget,chunk", [(500_000, 2_000_000), (40, 500), (5, 200), (300, 10_000)])
def test_phrases_match_brute_force(spark, budget, chunk):
    rows = phrase_rows()
    d = spark.createDataFrame([(i, *r, 1, "z") for i, r in enumerate(rows)], "doc_id long, lang string, text string, f long, phrase string").repartition(3)
    got = phrase_groups.collocations(d, min_count=6, budget=budget, chunk_words=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 6)
    assert len(want) > 100 and any(" " in w[2] and len(w[2].split(" ")) == 5 for w in want)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrases_cut_rank_and_absorption(spark):
    rows = phrase_rows(seed=9, docs=60)
    d = spark.createDataFrame(rows, "lang string, text string")
    for percent, top in ((100, 3), (60, 2000)):
        got = phrase_groups.collocations(d, min_count=4, top=top, percent=percent, budget=30)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 4, percent, top)


def test_phrases_of_odd_tables(spark, odd_docs, no_docs):
    assert phrase_groups.collocations(no_docs, min_count=1).count() == 0
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrase_groups.collocations(odd_docs, min_count=2).collect()) == brute_phrases(rows, 2)


# ---- mixing ----------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest = left - sum(fixed.values())
        level = {s: rest * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if level[s] > most * sizes[s]]
        if not over:
            return fixed | level
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 50}, {"a": 0, "b": 0}, {"z": 7}, {None: 10, "b": 3, "c": 90, "d": 400, "e": 1, "Z": 12}, {f"s{i}": (i * 37) % 91 for i in range(40)}])
def test_targets_match_step_by_step_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], float(want[s]), rel_tol=1e-12, abs_tol=1e-9) for s in want)


def mix_rows(spark, parts=4):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["hot", "hot", "b", None, "c"][i % 5]) for i in range(500)]
    rows += [(None, "same text here", "hot")] * 200 + [(7, None, "b"), (7, "", "b"), (7, " \t", None), (900, "v " * 3000, "c")]
    return rows, spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, source string, size int, __key string").repartition(parts)


def test_taken_words_meet_the_targets_exactly_and_reruns_agree(spark):
    rows, d = mix_rows(spark)
    got = source_mix.decide(d).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(dict(sizes))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], float(want[r["source"]]), rel_tol=1e-12) and 0 <= r["taken"] <= 2 * r["size"]
    assert {s: taken[s] for s in want} == {s: math.floor(want[s]) for s in want}
    again = source_mix.decide(mix_rows(spark, 7)[1]).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], str(r["source"]), r["taken"]) for r in rs)
    assert key(got) == key(again)


def test_mix_returns_the_texts_that_were_taken(spark):
    rows, d = mix_rows(spark)
    decided = source_mix.decide(d)
    want = {r["source"]: r["s"] for r in decided.groupBy("source").sum("taken").withColumnRenamed("sum(taken)", "s").collect()}
    out = source_mix.mix(d)
    assert out.columns == [*d.columns, "epoch"]
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    assert {s: n for s, n in want.items() if n} == dict(words)


def test_mix_of_odd_tables(spark, odd_docs, no_docs):
    assert source_mix.decide(no_docs).count() == 0 and source_mix.mix(no_docs).count() == 0
    assert source_mix.decide(odd_docs).count() == odd_docs.count()
    alone = spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in source_mix.decide(alone).collect()] == [0, 0]


def test_first_words_keep_white_space(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(" a\n b\tc  d ", n) for n in range(6)], "t string, n long").select(source_mix.first_words(F.col("t"), F.col("n"))).collect()
    assert [g[0] for g in got] == ["", " a", " a\n b", " a\n b\tc", " a\n b\tc  d", " a\n b\tc  d"]
