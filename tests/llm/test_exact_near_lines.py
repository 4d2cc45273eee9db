"""Exact dedup, SimHash groups and shared lines against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from factorlake.llm import block_names as B, graph, line_bitmaps as L, simhash_tiles as S

WORDS = [f"{a}{b}" for a in "ba ce di fo gu hy".split() for b in "ran sel tim vor wex".split()]


def texts(n, seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            out.append(rng.choice(out).replace(" ", rng.choice([" ", "  ", "\n"])))
        elif out and kind < 0.6:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 60, 200]))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_exact_groups_match_brute_force(spark, block):
    rows = texts(120) + ["é" * 7, "é" * 7 + " ", "", " ", None]
    flat = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in rows]
    groups = defaultdict(list)
    for i, f in enumerate(flat):
        groups[f].append(i)
    for r in B.duplicates(frame(spark, rows), block).collect():
        members = groups[flat[r.doc_id]]
        assert r.keep_id == min(members, key=lambda i: (-len(rows[i] or ""), i)) and r.group_size == len(members)
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(flat[r.doc_id].encode()).hexdigest()


def test_different_blocks_of_one_hash_get_different_names(spark, monkeypatch):
    monkeypatch.setattr(B.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    rows = ["aab", "abb", "aab", "aabbab", "aabbab", "aabbba"]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in B.duplicates(frame(spark, rows), 3).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 2), 4: (3, 2), 5: (5, 1)}


def test_exact_edge_rows(odd_docs, no_docs):
    got = B.duplicates(odd_docs).collect()
    assert len(got) == 10 and sum(r.kept for r in got) == 5  # alpha..., empty ones, no id, long; ALPHA differs by case
    assert {(r.doc_id, r.kept) for r in got if r.doc_id == 2} == {(2, False)}
    blank = [r for r in got if r.group_size == 3 and r.doc_id in (3, 4, 6)]
    assert len(blank) == 3 and {r.keep_id for r in blank} == {6}
    nameless = [r for r in got if r.doc_id is None]
    assert sorted(r.kept for r in nameless) == [False, True] and {r.keep_id for r in nameless} == {None}
    assert B.duplicates(no_docs).count() == 0


def test_exact_plan_has_no_python(spark):
    plan = B.duplicates(frame(spark, texts(10)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def slow_print(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def slow_components(prints, radius):
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [find(parent, i) for i in range(len(prints))]


def test_simhash_groups_match_brute_force(spark):
    rows = texts(150, 1) + ["", None, "É A"]
    prints = [slow_print(t) for t in rows]
    roots = slow_components(prints, 3)
    got = S.groups(frame(spark, rows)).withColumn("hex", S.hex_digits(F.col("fingerprint"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.hex == f"{prints[r.doc_id]:016x}" and r.component_id == roots[r.doc_id]


@pytest.mark.parametrize("tile_rows", [4, 2048])
def test_tiles_lose_no_link(spark, tile_rows):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        p = rng.choice(prints)
        for _ in range(rng.choice([1, 2, 3, 4, 9])):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile_rows=tile_rows)
    root = {r.node: r.root for r in graph.components(links).collect()}
    want = slow_components(prints, 3)
    groups = defaultdict(set)
    for p, w in zip(signed, want):
        groups[w].add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_dense_group_has_few_edges(spark):
    base = 0x5A5A_F00F_1234_4321
    near = sorted({base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)})
    edges = S.links(spark.createDataFrame([(p,) for p in near], "fp long")).count()
    assert edges < 40 * len(near)  # all pairs would be hundreds of each


def test_components_of_chains_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 300), (400, 401), (401, 400), (None, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 401: 400}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edge_rows(odd_docs, no_docs):
    got = S.groups(odd_docs).collect()
    assert len(got) == 10
    assert {r.component_id for r in got if r.doc_id in (3, 4, 6)} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2, 7)} == {1}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    kept = S.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (True, 0)]
    assert S.groups(no_docs).count() == 0 and S.one_per_group(no_docs).count() == 0


def test_a_very_long_text_is_hashed_whole():
    rng = random.Random(5)
    text = " ".join(rng.choice(WORDS) for _ in range(70_000))
    assert S.fingerprint(text.encode()) & (1 << 64) - 1 == slow_print(text)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def slow_lines(rows, least):
    owners = defaultdict(set)
    for i, t in enumerate(rows):
        for line in (t or "").split("\n"):
            if key(line):
                owners[key(line)].add(i)
    return [[line for line in (t or "").split("\n") if len(owners[key(line)]) < least] for t in rows]


def test_shared_lines_match_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choice(WORDS) for _ in range(3)) for _ in range(40)] + ["", " ", "Ünï", "\x1f", "a\x0b"]
    rows = ["\n".join(rng.choice([str, str.upper, " {}\t".format])(rng.choice(pool)) for _ in range(rng.randint(1, 9))) for _ in range(90)] + ["", None, "\n", "\n\n"]
    want = slow_lines(rows, 10)
    got = {r.doc_id: r for r in L.drop_lines(frame(spark, rows), 10).collect()}
    for i, t in enumerate(rows):
        n = len((t or "").split("\n"))
        assert (got[i].n_lines, got[i].n_dropped) == (n, n - len(want[i]))
        assert (got[i].text or "") == "\n".join(want[i])


def test_first_occurrence_can_stay(spark):
    rows = ["x\ny", "x", "x\nx\nz"]
    got = {r.doc_id: r.text for r in L.drop_lines(frame(spark, rows), 2, keep_first=True).collect()}
    assert got == {0: "x\ny", 1: "", 2: "z"}


def test_bitmaps_hold_every_line(spark):
    d = frame(spark, ["a\n" * 20 + f"own {i}" for i in range(12)])
    for r in L.keep_bitmaps(d, 10).collect():
        keep = L.unpack_bitmap(r.bitmap, r.n_lines)
        assert (r.n_lines, r.n_dropped) == (21, 20) and keep.tolist() == [False] * 20 + [True]


def test_runs_across_ranges_and_batches_count_once(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = frame(spark, ["same\n" * (1 + i % 5) + "same" for i in range(50)])
        assert L.drop_lines(d, 50).where("n_lines = n_dropped").count() == 50
        assert L.drop_lines(d, 51).where("n_dropped = 0").count() == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_line_edge_rows(odd_docs, no_docs):
    got = L.drop_lines(odd_docs, 3)
    rows = got.collect()
    assert len(rows) == 10 and {r.n_dropped for r in rows} == {0}  # repeated rows are one document
    assert sum(r.text is None for r in rows) == 1
    two = L.drop_lines(odd_docs, 2).where("doc_id in (1, 2)").collect()
    assert [(r.text, r.n_dropped) for r in two] == [("", 1)] * 3
    assert L.drop_lines(no_docs, 2).count() == 0
