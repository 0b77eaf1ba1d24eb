"""Event streams: counted micro-batches with an idempotent sink, and a cache with a time to live."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or a temporary one in local mode where that is unset."""
    named, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{named.rstrip('/')}/brevia-stream-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="spark-stream-")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a folder or file, as a stream."""
    batch = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    one_file = any(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles())
    stream = spark.readStream.schema(batch.schema)
    stream = stream.option("pathGlobFilter", name).parquet(folder) if one_file else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n and total per window and type; windows close once the watermark has passed them."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_available(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Process all there is in micro-batches, write each batch to a folder of its own, and return the rows written.

    A batch that is run again after a failure overwrites its own folder, so its rows are there once. In mode complete
    each batch holds all rows and replaces the one before.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


STATE = "user_id long, inserted long, n_reads long, n_hits long"


def ttl_step(reads: DataFrame, state: DataFrame, ttl_seconds: int) -> DataFrame:
    """The state after some reads (user_id, ts, event_id) of a cache that keeps an entry for ttl_seconds from its insert, not from its last use.

    state: user_id, inserted (microseconds), n_reads, n_hits. Rows are sorted by user and time within partitions and folded
    as they stream by: a user with any number of reads needs the memory of one batch. One step of the fold is one insert.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, inserted, n_reads, n_hits = None, None, 0, 0
        for batch in batches:
            users, times, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            done: list[tuple] = []
            cut = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)] if len(users) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if users[a] != user:
                    if user is not None:
                        done.append((user, inserted, n_reads, n_hits))
                    user, inserted, n_reads, n_hits = users[a], None, 0, 0
                if known[a]:  # the state's row comes first
                    inserted, n_reads, n_hits = (batch.column(k)[a].as_py() for k in (1, 3, 4))
                    a += 1
                n_reads += b - a
                while a < b:
                    if inserted is None or times[a] - inserted > ttl_seconds * 1_000_000:
                        inserted, a = int(times[a]), a + 1
                    last = a + int(np.searchsorted(times[a:b], inserted + ttl_seconds * 1_000_000, "right"))
                    n_hits, a = n_hits + last - a, last
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done, strict=True)], ["user_id", "inserted", "n_reads", "n_hits"])
        if user is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (user, inserted, n_reads, n_hits)], ["user_id", "inserted", "n_reads", "n_hits"])

    none = F.lit(0).cast("long")
    now = reads.where("user_id is not null and ts is not null").select("user_id", F.unix_micros("ts").alias("at"), F.lit(0).alias("known"), none.alias("n_reads"), none.alias("n_hits"), F.col("event_id").alias("place"))
    old = state.select("user_id", F.col("inserted").alias("at"), F.lit(1).alias("known"), "n_reads", "n_hits", none.alias("place"))
    rows = now.unionByName(old).repartition("user_id").sortWithinPartitions("user_id", F.desc("known"), "at", "place").select("user_id", "at", "known", "n_reads", "n_hits")
    return rows.mapInArrow(fold, STATE)


def ttl_cache(events: DataFrame, ttl_seconds: int, out: str) -> DataFrame:
    """user_id, n_reads and n_hits after all micro-batches of a stream of reads.

    Each batch writes the state after it to a folder of its own, made from the one before, so a batch that is run again
    after a failure gives the same state. Rows of one batch may come in any order.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(STATE).parquet(f"{out}/state/batch={number - 1}") if number else spark.createDataFrame([], STATE)
        ttl_step(batch, before, ttl_seconds).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else None
    done = spark.createDataFrame([], STATE) if last is None else spark.read.schema(STATE).parquet(f"{out}/state/batch={last}")
    return done.select("user_id", "n_reads", "n_hits")


def may_reuse(is_local: Column, same_key: Column, page: Column, other_view: Column, is_json: Column) -> Column:
    """Whether a read may take an entry that is there: a local one while its key stays, a remote one only to go on with it.

    Going on is another page, and for documents an outline or a section too.
    """
    return same_key & (is_local | (F.coalesce(page, F.lit(1)) > 1) | (F.coalesce(other_view, F.lit(False)) & ~is_json))
