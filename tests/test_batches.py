"""Batches by count or time against a plain loop, whatever the order of files."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brevia.streaming import batches, events


def plain(rows, most, seconds):
    out, open_ = [], {}
    for user, at, event in sorted(rows):
        batch = open_.setdefault(user, [])
        if batch and at - batch[0][0] >= seconds * 1_000_000:
            out.append((user, batch))
            batch = open_[user] = []
        batch.append((at, event))
        if len(batch) == most:
            out.append((user, batch))
            open_[user] = []
    out += [(u, b) for u, b in open_.items() if b]
    return sorted((u, b[0][0], len(b), b[0][1], b[-1][1]) for u, b in out)


def streamed(spark, rows, files, path, **how):
    frame = spark.createDataFrame(rows, "user_id long, at long, event_id long").withColumn("ts", F.timestamp_micros("at")).drop("at")
    for k, part in enumerate(files):
        frame.where(F.col("event_id").isin(part)).coalesce(1).write.parquet(f"{path}/in/f{k}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    return sorted(tuple(r) for r in batches.count_or_time(stream, out=f"{path}/out", **how).collect())


def test_batches_are_those_of_a_loop(spark, tmp_path):
    rng = random.Random(2)
    start = 1_700_000_000_000_000
    rows = [(rng.choice([1, 1, 1, 2, 3]), start + rng.choice([0, rng.randrange(40_000_000), rng.randrange(2_000_000_000)]), k) for k in range(220)]
    for n, seed in enumerate((5, 6)):
        ids = [r[2] for r in rows]
        random.Random(seed).shuffle(ids)
        assert streamed(spark, rows, [ids[:90], ids[90:150], ids[150:]], tmp_path / str(n), most=7, seconds=30, late="1 hour") == plain(rows, 7, 30)


def test_batches_close_while_the_stream_goes_on(spark, tmp_path):
    start = 1_700_000_000_000_000
    rows = [(1, start + k * 1_000_000, k) for k in range(100)] + [(2, start + k * 50_000_000, 1000 + k) for k in range(4)]
    order = sorted(rows, key=lambda r: r[1])
    files = [[r[2] for r in order[k : k + 26]] for k in range(0, 104, 26)]
    assert streamed(spark, rows, files, tmp_path, late="2 seconds") == plain(rows, 20, 30)
    early = spark.read.parquet(f"{tmp_path}/out/rows/batch=*")
    assert early.count() >= 4  # the state's rest is not all
    assert events.scratch(spark)


def test_users_of_one_group_keep_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "MOST_HELD", 40)  # what is written again takes several elements
    rng = random.Random(3)
    start = 1_700_000_000_000_000
    rows = [(rng.randrange(-4, 5), start + rng.choice([0, 30_000_000, rng.randrange(900_000_000)]), k) for k in range(500)]
    ids = [r[2] for r in rows]
    rng.shuffle(ids)
    assert streamed(spark, rows, [ids[:200], ids[200:]], tmp_path / "a", most=5, seconds=30, late="1 hour", groups=2) == plain(rows, 5, 30)
    ids = [r[2] for r in sorted(rows, key=lambda r: r[1])]
    assert streamed(spark, rows, [ids[k : k + 125] for k in range(0, 500, 125)], tmp_path / "b", most=5, seconds=30, late="2 seconds", groups=2) == plain(rows, 5, 30)


def test_calls_to_the_state_do_not_grow_with_users_or_events(spark, tmp_path):
    start = 1_700_000_000_000_000
    rows = [(k % 3_000, start + k * 1_000_000, k) for k in range(9_000)]
    frame = spark.createDataFrame(rows, "user_id long, at long, event_id long").withColumn("ts", F.timestamp_micros("at")).drop("at")
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    got = batches.count_or_time(stream, 20, 6 * 3600, out=f"{tmp_path}/out")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 20, 6 * 3600)
    held = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 0).load(f"{tmp_path}/out/checkpoint")
    assert 0 < held.count() <= 2_048


def test_a_batch_of_one_and_times_that_are_alike():
    rows = [(1, 5, 1), (1, 5, 2), (1, 9, 3), (2, 9, 4), (2, 14, 5)]
    assert batches.cut(rows, 1, 100) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    assert batches.cut(rows, 9, 4) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert batches.cut(rows, 9, 5) == [(0, 3), (3, 4), (4, 5)]
    assert batches.cut(rows, 2, 6) == [(0, 2), (2, 3), (3, 5)]
    assert batches.cut([], 2, 6) == []
