"""Streams whose rows come late or twice, and tables whose writer is lost between its steps."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import models
from millrace.sources.snapshots import PART, Snapshots, bucket_of
from millrace.streaming import drops, streams

EVENTS = "event_id long, ts timestamp, event_type string, user_id long, value double"


def one_by_one(spark, path, schema):
    """A stream that takes a file a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def event(spark, rows):
    return [(k, spark.sql(f"select timestamp'{ts}'").first()[0], kind, k % 3, float(k)) for k, (ts, kind) in enumerate(rows)]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    days = [(f"2024-03-{d:02d} 0{d % 9}:00:00", kind) for d in range(1, 31) for kind in ("view", "error")]
    late = [("2024-01-12 10:00:00", "view"), ("2024-03-02 10:00:00", "error"), ("2024-03-29 23:00:00", "view")]  # the last is in time
    put(spark, tmp_path / "e", event(spark, days), EVENTS)
    put(spark, tmp_path / "e", event(spark, [("2024-03-30 12:00:00", "start")]), EVENTS)  # a batch drops by the watermark that the one before had
    put(spark, tmp_path / "e", event(spark, late), EVENTS)
    told, end = {}, str(tmp_path / "end")
    found = {(r.day, r.event_type): r.n for r in streams.appended(streams.daily_counters(one_by_one(spark, tmp_path / "e", EVENTS), end=end), told, end).collect()}
    want = {(ts[:10], kind): 1 for ts, kind in days}
    want |= {("2024-03-29", "view"): 2, ("2024-03-30", "start"): 1}
    assert found == want
    assert told["rows"] == len(days) + len(late) + 1 and told["rows"] - sum(found.values()) == 2 == told["dropped"]


def test_open_windows_wait(spark, tmp_path):
    """A stream that goes on keeps the days that the watermark hasn't passed."""
    put(spark, tmp_path / "e", event(spark, [(f"2024-03-{d:02d} 12:00:00", "view") for d in range(1, 11)]), EVENTS)
    found = streams.appended(streams.daily_counters(one_by_one(spark, tmp_path / "e", EVENTS))).collect()
    assert sorted(r.day for r in found) == [f"2024-03-{d:02d}" for d in range(1, 9)]


def test_late_log_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for k, hours in enumerate(((1, 5, 9), (9,), (2, 9))):  # the third file's first line is seven hours late
        (tmp_path / "log" / f"{k}.log").write_text("".join(f"2024-03-01 {h:02d}:10:00 [ERROR] PRESS-{h}: broken\n" for h in hours))
        os.utime(tmp_path / "log" / f"{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    told, end = {}, str(tmp_path / "end")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "log"))
    found = streams.appended(drops.log_alerts(lines, width="1 hour", end=end), told, end).collect()
    assert sorted((r.equipment, r.n) for r in found) == [("PRESS-1", 1), ("PRESS-5", 1), ("PRESS-9", 3)]
    assert told == {"rows": 6, "dropped": 1}


@pytest.fixture
def purchases(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def test_a_key_posts_once_whenever_it_comes_again(spark, purchases, tmp_path):
    once = purchases.orderBy("event_id").limit(400)
    later = once.withColumn("ts", (F.col("ts").cast("timestamp") + F.expr("interval 100 days")).cast(purchases.schema["ts"].dataType))
    schema, base = purchases.schema, str(tmp_path / "base")
    once.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    read = lambda: one_by_one(spark, tmp_path / "e", schema)
    first = sorted(map(tuple, streams.posted_once(read(), base).collect()))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    again = streams.posted_once(read(), base)
    assert sorted(map(tuple, again.collect())) == first and len(first) > 0
    # the batches run once more, as after a driver that was lost before it noted them
    versions = Snapshots(spark, f"{base}/ledger").versions()
    (tmp_path / "base" / "log").rename(tmp_path / "base" / "lost")
    assert sorted(map(tuple, streams.posted_once(read(), base).collect())) == first
    assert Snapshots(spark, f"{base}/ledger").versions() == versions


CHANGES = "k long, n long, op string"


def test_a_batch_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    path, base = tmp_path / "q", str(tmp_path / "base")
    run = lambda **x: streams.apply_changes(one_by_one(spark, path, CHANGES), "k", "n", "op", base, **x)
    put(spark, path, [(k, 1, "upsert") for k in range(200)], CHANGES)
    assert run().count() == 200
    table = Snapshots(spark, f"{base}/table")
    before = table.manifest()["parts"]
    put(spark, path, [(5, 2, "upsert"), (6, 3, "delete"), (900, 1, "upsert")], CHANGES)
    assert {r.k for r in run().collect()} == {*range(200), 900} - {6}
    after = table.manifest()["parts"]
    changed = {p for p in after if after[p] != before.get(p)}
    assert len(before) > 20 and 1 <= len(changed) <= 3
    put(spark, path, [(6, 2, "upsert")], CHANGES)  # older than the delete
    assert 6 not in {r.k for r in run().collect()}
    for n in range(4):
        put(spark, path, [(6 if n < 3 else 5, 1, "upsert")], CHANGES)
    assert 6 not in {r.k for r in run().collect()}


def test_deletes_are_forgotten_in_the_end(spark, tmp_path):
    path, base = tmp_path / "q", str(tmp_path / "base")
    for n in range(5):
        put(spark, path, [(1, n, "delete" if n == 0 else "upsert")] if n == 0 else [(2, n, "upsert")], CHANGES)
    streams.apply_changes(one_by_one(spark, path, CHANGES), "k", "n", "op", base, buckets=1, remember=2)
    rows = Snapshots(spark, f"{base}/table").read(spark.createDataFrame([], CHANGES + ", _batch long").schema).collect()
    assert [(r.k, r.n) for r in rows] == [(2, 4)]


class Lost(RuntimeError):
    pass


def lose(*_):
    raise Lost


def test_a_writer_lost_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    rows = spark.range(10).select("id", F.expr("date_add(date'2024-01-01', cast(id as int))").alias("day"))
    full, days = str(tmp_path / "full"), str(tmp_path / "days")
    models.full_model(rows, full)
    models.time_range_model(rows, days, "day", "2024-01-01", "2024-01-10")
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "commit", lose)
        with pytest.raises(Lost):
            models.full_model(rows.where("id < 3"), full)
        with pytest.raises(Lost):
            models.time_range_model(rows.where("id < 3"), days, "day", "2024-01-01", "2024-01-10")
    assert Snapshots(spark, full).read(rows.schema).count() == 10 == Snapshots(spark, days).read(rows.schema).count()
    # the table may be read by the plan that replaces it, and days of the range without rows become empty
    assert models.full_model(Snapshots(spark, full).read(rows.schema).where("id > 4"), full).count() == 5
    got = models.time_range_model(rows.where("id in (2, 8)"), days, "day", "2024-01-03", "2024-01-05", 1)
    assert sorted(r.id for r in got.collect()) == [0, 2, 5, 6, 7, 8, 9]


def test_two_writers_and_old_folders(spark, tmp_path):
    table, other = Snapshots(spark, str(tmp_path / "t")), Snapshots(spark, str(tmp_path / "t"))
    rows = spark.range(30).withColumn(PART, bucket_of(["id"], 3))
    table.replace(rows)
    seen = other.manifest()
    table.append(rows)
    with pytest.raises(RuntimeError):
        other.commit(seen, {}, {})
    assert table.read(spark.range(1).schema).count() == 60
    for _ in range(4):
        table.append(rows, most=2)
    assert table.read(spark.range(1).schema).count() == 180 and len(table.versions()) == 2
    assert all(len(x) <= 3 for x in table.manifest()["parts"].values()) and len(list((tmp_path / "t" / "data").iterdir())) <= 5
