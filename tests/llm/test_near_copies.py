"""Near copies by exact sets against brute force."""

import random

import pytest

from factorlake.llm import near_copies as N


def jaccard(a, b):
    a, b = set(N.shingles(a.encode()).tolist()), set(N.shingles(b.encode()).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    """The words with ``n`` of them replaced, spread out."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10 ** 9)}"
    return " ".join(out)


def check(texts, kept, similarity=0.8):
    """Every row that went has an earlier near copy; no two rows that stay are near copies."""
    for i in set(texts) - kept:
        assert any(j < i and jaccard(texts[i], texts[j]) >= similarity for j in texts)
    stay = sorted(kept)
    return [(i, j) for a, i in enumerate(stay) for j in stay[:a] if jaccard(texts[i], texts[j]) >= similarity]


@pytest.mark.parametrize("edits", [(0, 8), (9, 16), (2, 30)])
def test_a_large_group_of_like_and_unlike_rows(spark, edits):
    rng = random.Random(edits[1])
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    texts = {i: edited(rng, words, rng.randint(*edits)) for i in range(90)}
    texts |= {100 + i: edited(rng, [f"v{i}"] * 5 + [f"u{rng.randrange(10 ** 6)}" for _ in range(80)], 0) for i in range(20)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert check(texts, {r["doc_id"] for r in N.one_per_group(d).collect()}) == []


def test_rare_shingles_find_every_pair(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    texts = {i: edited(rng, words, rng.randint(1, 12)) for i in range(60)}
    sets = {i: sorted(N.shingles(t.encode()).astype("int64").tolist()) for i, t in texts.items()}
    rows = spark.createDataFrame([((False, i, i, len(s)),) for i, s in sets.items()], "at struct<absent: boolean, doc_id: long, row: long, n: int>")
    frame = spark.createDataFrame(list(sets.items()), "row long, set array<long>")
    for similarity in (0.5, 0.8, 0.95):
        found = {(r["v"], r["u"]) for r in N._by_rare_shingles(rows, frame, similarity).collect()}
        want = {(i, j) for i in texts for j in range(i) if jaccard(texts[i], texts[j]) >= similarity}
        assert want <= found
    assert len(found) < 60 * 59 / 4


def test_odd_tables(spark, odd_docs, no_docs):
    assert N.one_per_group(no_docs).count() == 0
    clash = odd_docs.withColumnRenamed("row", "__key").withColumnRenamed("pos", "at")
    out = N.one_per_group(clash)
    assert out.columns == clash.columns
    got = sorted((str(r["doc_id"]), r["text"] is None) for r in out.collect())
    # one of the copies of the first text, one empty text, the text without id once, the long text
    assert got == [("1", False), ("3", False), ("5", False), ("None", False)]


def test_simhash_groups_name_the_nearest_copies(spark):
    """The SimHash step alone: pairs are exactly the rows beside the first of their group, as brute force links them."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    texts = {i: edited(rng, words, i % 4) for i in range(12)} | {20 + i: " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(50)) for i in range(20)}
    prints = {i: N.simhash(N.shingles(t.encode())) for i, t in texts.items()}
    rows = spark.createDataFrame([((False, i, i, 1), p) for i, p in prints.items()], "at struct<absent: boolean, doc_id: long, row: long, n: int>, fp long")
    got = {(r["head"]["row"], r["at"]["row"]) for r in N.simhash_pairs(rows).collect()}
    near = {i: {j for j in texts if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 3} for i in texts}
    want = set()
    for i in texts:
        group, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - group
            group |= new
            todo += new
        want |= {(min(group), i)} if min(group) != i else set()
    assert got == want and len(got) >= 8


def test_simhash_step_removes_rows_without_any_band(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(3000)]
    texts = {i: edited(rng, words, i) for i in range(3)} | {9: "another text of its own"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in N.one_per_group(d, bands=0).collect()} == {0, 9}
