"""Partition-scoped upserts and keyed stream state with expiry."""

import datetime as dt
import os

import pytest

from factorlake.sources import sinks as SK, upsert as UP
from factorlake.streaming import keyed_state as KS, market_streams as MS

BARS = "ticker string, session date, close double, origin string, seen_at timestamp"
JUL, AUG = dt.date(2024, 7, 3), dt.date(2024, 8, 5)


def at(h):
    return dt.datetime(2024, 8, 6, h)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BARS)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def content(spark, path):
    return sorted((r["ticker"], str(r["session"]), r["close"], r["origin"], r["batch"]) for r in MS.read_bars(spark, path).collect())


def test_upsert_prefers_real_bars_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "bars")
    apply = MS.bar_upsert(path)
    apply(bars(spark, ("A", JUL, 12.0, "quote", at(21))), 0)
    second = bars(spark, ("A", JUL, 12.5, "bar", at(20)), ("B", AUG, 1.0, "quote", at(20)), ("B", AUG, 2.0, "quote", at(19)))
    apply(second, 1)
    want = [("A", "2024-07-03", 12.5, "bar", 1), ("B", "2024-08-05", 1.0, "quote", 1)]
    assert content(spark, path) == want
    apply(second, 1)
    assert content(spark, path) == want
    apply(second, 2)  # the same bars in a later batch: the stored ones stay
    assert content(spark, path) == want
    apply(bars(spark, ("A", JUL, 99.0, "quote", at(23))), 3)
    assert content(spark, path) == want


def test_untouched_partitions_keep_their_files_and_empty_batches_touch_none(spark, tmp_path):
    path = str(tmp_path / "bars")
    apply = MS.bar_upsert(path, buckets=1)
    apply(bars(spark, ("A", JUL, 1.0, "bar", at(1)), ("A", AUG, 2.0, "bar", at(1))), 0)
    before = files(path)
    apply(bars(spark), 1)
    assert files(path) == before
    apply(bars(spark, ("B", AUG, 3.0, "bar", at(2))), 2)
    after = files(path)
    july = {f: t for f, t in before.items() if "month=2024-07" in f}
    assert july and all(after.get(f) == t for f, t in july.items())
    assert not any(f in after for f in before if "month=2024-08" in f)
    assert [c[:3] for c in content(spark, path)] == [("A", "2024-07-03", 1.0), ("A", "2024-08-05", 2.0), ("B", "2024-08-05", 3.0)]


@pytest.mark.parametrize("fail_at", ["before", "half"])
def test_a_failure_between_copy_and_overwrite_loses_nothing(spark, tmp_path, monkeypatch, fail_at):
    path = str(tmp_path / "bars")
    apply = MS.bar_upsert(path, buckets=1)
    apply(bars(spark, ("A", JUL, 1.0, "bar", at(1))), 0)
    publish = UP._publish

    def broken(spark, copy, table, parts, schema):
        if fail_at == "half":  # the old partition is gone, the new one not yet there
            fs, p = UP._fs(spark, f"{table}/month=2024-07")
            fs.delete(p, True)
        raise RuntimeError("lost")
    monkeypatch.setattr(UP, "_publish", broken)
    with pytest.raises(RuntimeError):
        apply(bars(spark, ("B", JUL, 2.0, "bar", at(1))), 1)
    monkeypatch.setattr(UP, "_publish", publish)
    apply(bars(spark, ("B", JUL, 2.0, "bar", at(1))), 1)  # the stream replays its batch
    assert [c[:3] for c in content(spark, path)] == [("A", "2024-07-03", 1.0), ("B", "2024-07-03", 2.0)]
    assert not files(f"{path}.pending")


def test_a_copy_without_success_marker_is_not_published(spark, tmp_path):
    path = str(tmp_path / "bars")
    apply = MS.bar_upsert(path, buckets=1)
    apply(bars(spark, ("A", JUL, 1.0, "bar", at(1))), 0)
    os.makedirs(f"{path}.pending/batch=9")
    apply(bars(spark, ("B", JUL, 2.0, "bar", at(1))), 1)
    assert [c[0] for c in content(spark, path)] == ["A", "B"]


def test_saved_periods_rewrite_only_their_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "pit"), "ticker string, period_end date, v int"
    row = lambda t, v: (t, JUL, v)
    SK.save_periods(spark.createDataFrame([row(t, 1) for t in "ABCDEFGH"], schema), path, buckets=4)
    before = files(path)
    SK.save_periods(spark.createDataFrame([row("A", 2)], schema), path, buckets=4)
    after = files(path)
    assert sum(after.get(f) == t for f, t in before.items()) == len(before) - 1
    assert {r["ticker"]: r["v"] for r in spark.read.parquet(path).collect()} == {**{t: 1 for t in "BCDEFGH"}, "A": 2}


def day(n, h=0):
    return dt.datetime(2024, 1, n, h)


def test_state_holds_the_newest_record_of_live_keys_only(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k string, ts timestamp, n int, v double"
    batches = [[("a", day(1), 1, 1.0), ("b", day(2), 1, 2.0), ("a", day(1), 2, 1.5)],  # a: a tie in time goes by n
               [("a", day(3), 1, 3.0), ("c", day(14), 1, 5.0), ("c", day(13), 9, 4.0)],
               [("a", day(2), 9, 9.0), ("d", day(20), 1, 6.0), ("b", day(2, 1), 1, 7.0), ("e", day(11), 1, 8.0)],  # a: late; b: expired, its late record goes with it; e: late but alive
               [("e", day(11), 1, 8.0), ("c", day(14), 1, 5.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    log = []
    with KS.rocks_state(spark):
        q = (KS.latest_changes(stream, ["k"], ["n"], "10 days").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
             .foreachBatch(lambda d, i: log.extend((r["k"], r["op"], r["v"]) for r in d.collect())).trigger(availableNow=True).start())
        q.awaitTermination()
    got = {r["k"]: (r["ts"], r["n"], r["v"]) for r in KS.latest_records(spark, str(tmp_path / "state")).collect()}
    assert got == {"c": (day(14), 1, 5.0), "d": (day(20), 1, 6.0), "e": (day(11), 1, 8.0)}
    assert [x for x in log if x[0] == "a"] == [("a", "upsert", 1.5), ("a", "upsert", 3.0), ("a", "expired", 3.0)]
    assert [x[1] for x in log if x[0] == "b"][-1] == "expired" and log.count(("e", "upsert", 8.0)) == 1 and log.count(("c", "upsert", 5.0)) == 1
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] >= 3
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "state"))
    assert state.count() == 3
    assert spark.conf.get(KS.PROVIDER, None) != KS.ROCKS
