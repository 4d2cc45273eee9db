"""Ordered merge of names and queries against a loop."""

import random

import pytest

from factorlake.operators.prefix_join import best_by_prefix


def brute(queries, names, n):
    out = []
    for q in sorted(set(queries) - {""}):
        hits = sorted((-w, i) for name, i, w in names if name and name.startswith(q))[:n]
        out += [(q, i, -w) for w, i in hits]
    return sorted(out)


@pytest.mark.parametrize("parts,alphabet,seed", [("4", "ab", 1), ("23", "a", 2), ("23", "abc", 3), ("211", "aé日", 4), ("7", "abcdefgh", 5)])
def test_every_query_gets_its_heaviest_names(spark, parts, alphabet, seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    names = [(word(0, 9), i, rng.randint(0, 5)) for i in range(400)] + [("aaaa", 1000 + i, 3) for i in range(150)]  # a third are alike
    queries = [word(0, 6) for _ in range(120)] + ["zz", "aaaa", "a", ""]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = best_by_prefix(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame(names, "name string, id long, weight long"))
        assert sorted((r["q"], r["id"], r["weight"]) for r in got.collect()) == brute(queries, names, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_empty_sides(spark):
    none = spark.createDataFrame([], "name string, id long, weight long")
    assert best_by_prefix(spark.createDataFrame([("a",)], "q string"), none).count() == 0
    assert best_by_prefix(spark.createDataFrame([], "q string"), none).count() == 0
