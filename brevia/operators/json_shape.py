"""The merged shape of a whole corpus of JSON texts, without a schema: level by level, as sums keyed by path.

Each step takes the values of one level apart into fields and elements, and adds up what each path holds: partial sums
before the shuffle, one row a path behind it. No document is gathered, and no path's values are. Labels are then put
together from the deepest level up, from the paths' rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.operators.json_docs import SHAPE_DEPTH, SHAPE_EXAMPLE, SHAPE_INLINE, SHAPE_KEYS
from brevia.streaming.events import scratch

#: Private signs in a path before a key, and for the elements of an array.
_KEY, _ITEM = "\u0001", "\u0002"
#: Levels that are taken apart at most: objects go SHAPE_DEPTH deep, arrays between them count as levels too.
MOST_LEVELS = 64


def _kind(v: Column, fields: Column, items: Column) -> Column:
    scalar = F.expr("schema_of_variant(v)")
    return F.when(fields.isNotNull(), "object").when(items.isNotNull(), "array").when(F.expr("is_variant_null(v)"), "null").when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "bool").otherwise("number")


def _described(level: DataFrame) -> DataFrame:
    """(id, at, path, parent, name, v) with its fields, items and kind."""
    taken = level.withColumns({"fields": F.expr("try_cast(v as map<string, variant>)"), "items": F.expr("try_cast(v as array<variant>)")})
    return taken.withColumn("kind", _kind(F.col("v"), F.col("fields"), F.col("items")))


def _summed(described: DataFrame) -> DataFrame:
    """One row a path: how often each kind is there, the range of array lengths, the first example by document and place.

    The set of kinds is there so that Spark hashes the rows by path: with sums and an example alone it would sort them.
    """
    text = F.expr("cast(v as string)")
    start = F.substring(text, 1, SHAPE_EXAMPLE)
    written = F.to_json(F.array(start))
    quoted = F.when(start.rlike(r'["\\\x00-\x1f]'), F.substr(written, F.lit(2), F.length(written) - 2)).otherwise(F.concat(F.lit('"'), start, F.lit('"')))
    shown = F.when(F.col("kind") == "string", F.concat(quoted, F.when(F.length(text) > SHAPE_EXAMPLE, "…").otherwise(""))).when(F.col("kind").isin("number", "bool"), text)
    rows = described.withColumn("example", F.when(F.col("kind").isin("string", "number", "bool"), F.struct("id", "at", shown.alias("text"))))
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    kinds = [count(k) for k in ("object", "array", "string", "number", "bool", "null")]
    return rows.groupBy("path", "parent", "name").agg(F.count("*").alias("n_seen"), *kinds, F.min(F.size("items")).alias("least"), F.max(F.size("items")).alias("most"), F.min("example")["text"].alias("example"), F.collect_set("kind").alias("kinds"))


def _parts(level: DataFrame) -> DataFrame:
    """The fields and elements of the objects and arrays of (id, at, path, v)."""
    taken = level.withColumn("fields", F.expr("try_cast(v as map<string, variant>)")).withColumn("items", F.when(F.col("fields").isNull(), F.expr("try_cast(v as array<variant>)")))
    entries = F.coalesce(F.map_entries("fields"), F.transform("items", lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))
    rows = taken.select("id", "at", "path", F.posexplode(entries).alias("k", "e"))
    path = F.when(F.col("e.key").isNull(), F.concat("path", F.lit(_ITEM))).otherwise(F.concat("path", F.lit(_KEY), "e.key"))
    return rows.select("id", F.concat("at", F.array(F.col("k").cast("int"))).alias("at"), path.alias("path"), F.col("path").alias("parent"), F.col("e.key").alias("name"), F.col("e.value").alias("v"))


def shape_rows(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """path, parent, name, level, depth, counts by kind, lengths and example of every path of the JSON texts, root first.

    Of an object's keys the first ``SHAPE_KEYS`` by name go on, and the row says how many more there are (n_more). Texts
    that are null or no JSON are left out. Objects deeper than ``SHAPE_DEPTH`` are counted, not taken apart. Only objects
    and arrays are written for the next level; scalars are summed where their object or array is taken apart.
    """
    spark = docs.sparkSession
    place, level, done = scratch(spark), 0, []
    root = docs.select(F.col(key).cast("string").alias("id"), F.array().cast("array<int>").alias("at"), F.lit("$").alias("path"), F.lit("").alias("parent"), F.lit(None).cast("string").alias("name"), F.expr(f"try_parse_json(`{text}`)").alias("v")).where("v is not null")
    root.write.parquet(f"{place}/level=0")
    values = spark.read.parquet(f"{place}/level=0")
    while True:
        depth = F.length("path") - F.length(F.replace(F.col("path"), F.lit(_KEY), F.lit("")))
        _summed(_described(values)).withColumn("depth", depth.cast("int")).write.parquet(f"{place}/paths/level={level}")
        rank = F.row_number().over(Window.partitionBy("parent", F.col("name").isNull()).orderBy("name"))
        listed = spark.read.parquet(f"{place}/paths/level={level}").drop("kinds").withColumns({"level": F.lit(level), "rank": F.when(F.col("name").isNotNull(), rank)})
        more = listed.groupBy("parent").agg(F.greatest(F.max("rank") - SHAPE_KEYS, F.lit(0)).alias("n_more")).withColumnRenamed("parent", "path")
        if done:
            done[-1] = done[-1].drop("n_more").join(more, "path", "left").fillna(0, ["n_more"])
        kept = listed.where((F.col("rank") <= SHAPE_KEYS) | F.col("rank").isNull()).drop("rank")
        done.append(kept.withColumn("n_more", F.lit(0)))
        holders = kept.where((F.col("n_object") + F.col("n_array") > 0) & (F.col("depth") < SHAPE_DEPTH)).select("path")
        level += 1
        if level == MOST_LEVELS or holders.isEmpty():
            break
        held = _described(values.join(holders, "path", "left_semi")).where("fields is not null or items is not null")
        held.select("id", "at", "path", "v").write.parquet(f"{place}/level={level}")
        values = _parts(spark.read.parquet(f"{place}/level={level}"))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def _labelled(nodes: DataFrame, below: DataFrame | None) -> DataFrame:
    """The rows of one level with their labels, from those of the level below."""
    if below is None:
        held = nodes.withColumns({"lines": F.lit(None).cast("array<struct<name:string,n_seen:bigint,label:string>>"), "inner": F.lit(None).cast("string")})
    else:
        own = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n_seen", "label"))))
        grouped = below.groupBy(F.col("parent").alias("path")).agg(own.alias("lines"), F.max(F.when(F.col("name").isNull(), F.col("label"))).alias("inner"))
        held = nodes.join(grouped, "path", "left")
    line = lambda x: F.concat(x["name"], F.when(x["n_seen"] < F.col("n_object"), "?").otherwise(""), F.lit(": "), x["label"])
    more = F.when(F.col("n_more") > 0, F.array(F.concat(F.lit("… "), F.col("n_more").cast("string"), F.lit(" more keys")))).otherwise(F.array().cast("array<string>"))
    held = held.withColumn("rows", F.concat(F.transform(F.coalesce("lines", F.array().cast("array<struct<name:string,n_seen:bigint,label:string>>")), line), more))
    flat = F.concat(F.lit("{"), F.array_join("rows", ", "), F.lit("}"))
    pad = F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.col("depth") + 1))
    wide = F.concat(F.lit("{"), pad, F.regexp_replace(F.array_join("rows", _KEY), _KEY, pad), F.lit("\n"), F.repeat(F.lit(" "), F.col("depth")), F.lit("}"))
    fields = F.when((F.size("rows") == 0) & (F.col("depth") >= SHAPE_DEPTH), "{…}").when((F.octet_length(flat) <= SHAPE_INLINE) & ~flat.contains("\n"), flat).otherwise(wide)
    span = F.concat(F.lit("["), F.col("least").cast("string"), F.when(F.col("least") == F.col("most"), "").otherwise(F.concat(F.lit("-"), F.col("most").cast("string"))), F.lit("]"))
    scalars = F.concat_ws("|", *[F.when(F.col(f"n_{k}") > 0, k) for k in ("string", "number", "bool")])
    label = F.concat_ws(
        "|", F.when(F.col("n_object") > 0, fields), F.when(F.col("n_array") > 0, F.concat(span, F.coalesce(F.concat(F.lit(" "), F.col("inner")), F.lit("")))),
        F.when(scalars != "", F.concat(scalars, F.coalesce(F.concat(F.lit(" ("), F.col("example"), F.lit(")")), F.lit("")))), F.when(F.col("n_null") > 0, "null"),
    )
    return held.select("path", "parent", "name", "n_seen", label.alias("label"))


def corpus_shape(docs: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """n_documents and shape of a corpus of JSON texts: one row with the shape that all of them have together.

    Keys come by name, with ? where some object lacks them; kinds are joined by |; scalars show the first example, by the
    document's key as text and the place in it. An empty corpus has no row.
    """
    rows = shape_rows(docs, text, key)
    label, level = None, rows.agg(F.max("level")).first()[0]
    while level is not None and level >= 0:
        label = _labelled(rows.where(F.col("level") == level), label)
        level -= 1
    if label is None:
        return rows.limit(0).select(F.col("n_seen").alias("n_documents"), F.col("path").alias("shape"))
    return label.select(F.col("n_seen").alias("n_documents"), F.col("label").alias("shape"))
