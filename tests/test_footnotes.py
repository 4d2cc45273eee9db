"""Payloads of any depth: walk, newest block, and the rules over them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factorlake.catalog import footnotes as C
from factorlake.functions import variants as VA
from factorlake.operators import risk as K
from factorlake.sources import readers as RD, sinks as SK

SF = "/root/testdata/sf0.001"


def parsed(spark, rows):
    d = spark.createDataFrame([(t, k, p if isinstance(p, str) else json.dumps(p)) for t, k, p in rows], "ticker string, kind string, payload string")
    return d.withColumn("payload", F.try_parse_json("payload"))


def signals(spark, kind, payload, cap=None, revenue=None):
    caps = spark.createDataFrame([("A", cap)], "ticker string, market_cap double")
    rev = spark.createDataFrame([("A", revenue)], "ticker string, revenue double")
    return [(r["severity"], r["label"], r["detail"]) for r in K.footnote_signals(parsed(spark, [("A", kind, payload)]), caps, rev, F.lit(2026)).collect()]


def random_tree(rng, depth):
    kind = rng.choice(["obj", "obj", "list", "leaf"]) if depth else "leaf"
    if kind == "leaf":
        return rng.choice([1, 2.5, -3, "x", "0.5", True, False, None, "", " s "])
    if kind == "list":
        return [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abcdef"): random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def walk(node):
    if isinstance(node, dict):
        yield node
    for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from walk(child)


def test_walk_finds_every_object_of_random_trees(spark):
    rng = random.Random(7)
    trees = [random_tree(rng, 7) for _ in range(120)] + [[], {}, 5, "text", None, [[[[{"a": [{"b": {"c": {"d": {"e": {"f": 1}}}}}]}]]]]]
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(-1, "{broken"), (-2, None)], "id int, j string").select("id", F.try_parse_json("j").alias("v"))
    nodes = VA.object_nodes(rows, "v", ["id"])
    counts = {r["id"]: r["count"] for r in nodes.groupBy("id").count().collect()}
    assert counts == {i: n for i, t in enumerate(trees) if (n := len(list(walk(t))))}
    numbers = nodes.select("id", F.explode("members").alias("k", "x")).select("id", "k", VA.number(F.col("x")).alias("n")).filter("n IS NOT NULL")
    want = sorted((i, k, float(v)) for i, t in enumerate(trees) for d in walk(t) for k, v in d.items() if isinstance(v, (int, float)) and not isinstance(v, bool))
    assert sorted((r["id"], r["k"], r["n"]) for r in numbers.collect()) == want
    leaves = VA.scalars(nodes, ["id"])
    want = sorted((i, k, str(v).lower() if isinstance(v, bool) else str(v)) for i, t in enumerate(trees) for d in walk(t) for k, v in d.items() if v is not None and not isinstance(v, (dict, list)))
    assert sorted((r["id"], r["key"], r["value"]) for r in leaves.collect()) == want


@pytest.mark.parametrize("payload,want", [
    ({"data": [{"fiscalYear": 2023, "x": 1}, {"fiscalYear": 2024, "x": 2}, {"x": 3}]}, 2), ([{"x": 7}, {"x": 8}], 7), ({"x": 9}, 9), ({"data": 4, "periods": [5, {"x": 6}]}, 6),
    ([{"fiscalYear": 2024, "x": 1}, {"fiscalYear": 2024, "x": 2}], 1), ([{"fiscalYear": "2030", "x": 1}, {"fiscalYear": 2024, "x": 2}], 2), ({"data": []}, None), ([1, 2], None), ("text", None)])
def test_newest_block(spark, payload, want):
    got = spark.createDataFrame([(json.dumps(payload),)], "j string").select(VA.first_number(VA.fields(VA.latest_block(F.parse_json("j"))), "x")).first()[0]
    assert got == want


def test_rules_read_objects_at_any_depth(spark):
    deep = lambda d, n: d if n == 0 else {"w": [0, deep(d, n - 1)]}
    cases = [
        ("retirement-plans", lambda n: [{"fiscalYear": 2025, "p": deep({"fundedStatus": -8.0}, n)}, {"fiscalYear": 2024, "p": {"fundedStatus": -1e9}}], 100.0,
         ("medium", "Underfunded pension plans", "$8 net underfunded across the disclosed plans (8% of market cap)")),
        ("debt-structure", lambda n: [{"fiscalYear": 2025}, {"a": deep({"dueYear": 2027, "face": 30.0}, n), "b": deep({"dueYear": 2035, "amount": 70.0}, n + 1)}], None,
         ("medium", "Debt maturity wall", "$30 of $100 face amount (30%) matures by 2028")),
        ("credit-facilities", lambda n: [{"fiscalYear": 2025, "utilization": 0.1}, {"fiscalYear": 2020, "old": deep({"utilization": 90}, n)}], None,
         ("medium", "Credit facilities heavily drawn", "peak utilization 90% of committed capacity across the disclosed facilities")),
        ("supplier-finance", lambda n: {"x": deep({"outstandingAmount": 3e6, "outstandingPaid": 9e9, "currentObligation": 9e9}, n)}, 1e8,
         ("info", "Supplier-finance obligations", "$3M outstanding under supplier-finance programs (reverse factoring — leverage parked in accounts payable) — 3% of market cap")),
        ("fair-value-hierarchy", lambda n: {"x": deep({"level3Share": 31}, n)}, None,
         ("info", "Opaque Level 3 valuations", "31% of recurring fair-value measurements rely on unobservable (model) inputs")),
        ("stock-compensation", lambda n: [{"x": deep({"UnrecognizedComp": 4.0}, n)}], None,
         ("info", "Unvested equity compensation", "$4 of unrecognized equity compensation cost — future expense and dilution"))]
    named = {f"{kind} {n}": (kind, make(n), cap, want) for kind, make, cap, want in cases for n in (0, 1, 3, 6)}
    rows = parsed(spark, [(t, kind, p) for t, (kind, p, _, _) in named.items()])
    caps = spark.createDataFrame([(t, cap) for t, (_, _, cap, _) in named.items()], "ticker string, market_cap double")
    got = {r["ticker"]: (r["severity"], r["label"], r["detail"]) for r in K.fact_signals(K.footnote_facts(rows, F.lit(2026)), caps, F.lit(2026)).collect()}
    assert got == {t: want for t, (_, _, _, want) in named.items()}


def test_listed_instruments_hide_loose_ones(spark):
    p = [{"fiscalYear": 2025, "tranches": [{"dueYear": 2040, "face": 5.0}], "loose": {"dueYear": 2026, "face": 95.0}}]
    assert signals(spark, "debt-structure", p) == []
    assert signals(spark, "debt-structure", {"data": [1], "dueYear": 2026, "face": 3.0}) == []  # no block at all
    assert signals(spark, "debt-structure", [{"instruments": [{"dueYear": "2026", "face": 3.0}, {"dueYear": 2026, "face": True}]}]) == []


@pytest.mark.parametrize("history,want", [
    ([{"share": 0.6}, {"share": 0.2}, {"share": 0.4}], "60% → 40%"), ([{"share": 0.5}, {"period": "2001", "share": 0.3}], None),
    ([{"period": "2003", "share": 0.5}, {"period": "", "share": 0.9}, {"period": "2001", "share": 0.3}], "30% → 50%"), ([{"period": 2001, "share": 0.4}, {"period": 2003, "share": 35}], "40% → 35%")])
def test_undated_points(spark, history, want):
    (sev, _, detail), = signals(spark, "concentration", {"series": [{"riskType": "customer", "counterparties": [{"name": "N", "history": history}]}]})
    assert sev == "medium" and (f"({want} over the disclosed history)" in detail if want else "→" not in detail)


def test_parties_of_one_name_in_two_lists_stay_apart(spark):
    group = lambda share: {"riskType": "customer", "counterparties": [{"name": "N", "history": [{"period": "2001", "share": share}]}]}
    (_, _, detail), = signals(spark, "concentration", [group(0.2), group(0.5)])
    assert detail == "N at 50% of revenue"


def test_unnamed_leaves_count_in_the_total_only(spark):
    geo = {"countries": [{"name": "US", "value": 60.0}], "residuals": [{"value": 40.0}]}
    assert signals(spark, "revenue-segmentation", {"geography": geo}, None, 100.0) == [("info", "Geographic revenue concentration", "60% of revenue from US")]


def test_landed_payloads_keep_broken_text_and_the_lake_is_read_by_kind(spark, tmp_path):
    rows = [("A", "credit-facilities", '{"utilization":0.8}'), ("B", "concentration", "{broken"), ("C", "retirement-plans", None)]
    spark.createDataFrame(rows, "ticker string, kind string, payload string").write.json(str(tmp_path / "landed"))
    SK.save_footnotes(RD.read_footnotes(spark, str(tmp_path / "landed")), str(tmp_path / "lake"))
    lake = RD.footnote_lake(spark, str(tmp_path / "lake"))
    assert {(r["ticker"], r["broken"]) for r in lake.select("ticker", "broken").collect()} == {("A", None), ("B", "{broken"), ("C", None)}
    plan = K.concentration_table(lake)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "concentration" in plan
    assert K.footnote_facts(lake, F.lit(2026)).first()["utilization"] == 0.8


def test_landed_depths_reach_six(spark):
    depths = [str(r["payload"]).count('"w"') for r in C.landed(spark, SF).filter("kind = 'fair-value-hierarchy'").select("payload").collect()]
    assert max(depths) >= 6
