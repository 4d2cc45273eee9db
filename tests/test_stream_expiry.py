"""Keys that expire, against plain Python."""

import datetime as dt

import pytest

from factorlake.catalog import streams as ST
from factorlake.streaming import keyed_state as KS

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def sixty_days(spark, tmp_path):
    """A key a row, mostly expired; the early rows are wide, so a file of early days closes after the later ones."""
    start, wide = dt.datetime(2024, 1, 1, 0, 0, 0, 7), "x" * 60_000
    rows = [(i, start + dt.timedelta(days=60) * i / 1200, i % 1000, "view", i / 10, wide if i < 300 else "") for i in range(1200)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "events.parquet"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield str(tmp_path), rows
    for k, v in old.items():
        spark.conf.set(k, v)


def test_every_key_is_counted_whatever_file_closes_first(spark, sixty_days):
    path, rows = sixty_days
    newest = {r[2]: r for r in rows}
    last = rows[-1][1] - dt.timedelta(days=10)
    expired = sum(r[1] < last for r in newest.values())
    assert 0 < expired < 1000
    assert [tuple(r) for r in ST.stream_expired_keys(spark, path).collect()] == [("view", 1000, expired)]
    got = {r["user_id"]: r["value"] for r in ST.stream_latest_per_key(spark, path).collect()}
    assert got == {u: r[4] for u, r in newest.items() if r[1] >= last}


def test_live_to_the_microsecond(spark, tmp_path):
    last = dt.datetime(2024, 1, 20, 0, 0, 0, 500)
    edge = last - dt.timedelta(days=10)
    rows = [("new", last, 1), ("on", edge, 1), ("on", edge, 2), ("off", edge - dt.timedelta(microseconds=1), 1), ("old", edge - dt.timedelta(days=9), 1)]
    src, base = str(tmp_path / "in"), str(tmp_path)
    spark.createDataFrame(rows, "k string, ts timestamp, n int").coalesce(1).write.parquet(src)
    stream = KS.newest_until_expiry(spark.readStream.schema("k string, ts timestamp, n int").parquet(src), ["k"], ["n"], "10 days")
    gone = []
    with KS.rocks_state(spark):
        stream.writeStream.foreachBatch(lambda d, i: gone.extend(r["k"] for r in d.collect())).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    live = {r["k"]: (r["stamp"], r["n"]) for r in KS.live_records(spark, f"{base}/state", ["k"], "10 days").collect()}
    assert live == {"new": (last, 1), "on": (edge, 2)}
    assert gone == ["old"]
