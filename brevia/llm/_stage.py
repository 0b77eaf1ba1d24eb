"""Tables written between the steps of an operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own[app]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/brevia-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and lost executors cost nothing done before."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of ``likely``: 2**18 words of 64, so the broadcast side never exceeds 262,144 rows of 16 bytes.
WORDS = 1 << 18


def likely(df: DataFrame, column: str, ids: DataFrame, others: bool = False) -> DataFrame:
    """The rows of df whose ``column`` may be among the single-column ``ids`` (all that are, few others), or the other rows.

    A Bloom-like bitmap of fixed size is broadcast, so wide rows are thinned before an exact join shuffles them.
    The more ids, the less it thins; the join that follows keeps the result exact.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(WORDS * 64))
    key = ids.columns[0]
    bitmap = (
        ids.select(spot(F.col(key)).alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(_at % 64))")).alias("_bits"))
    )
    marked = df.withColumn("_at", spot(F.col(column))).withColumn("_mark", F.shiftright("_at", 6))
    hit = (marked["_mark"] == bitmap["_word"]) & (F.expr("_bits & shiftleft(1L, int(_at % 64))") != 0)
    return marked.join(F.broadcast(bitmap), hit, "left_anti" if others else "left_semi").drop("_at", "_mark")


def without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose ``column`` is not among ``ids`` (one column of the same name); of few others are any shuffled."""
    return likely(df, column, ids, others=True).unionByName(likely(df, column, ids).join(ids, column, "left_anti").select(*df.columns))
