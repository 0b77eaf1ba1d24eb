"""Near-duplicate embeddings by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are projected on Gaussian directions, and each projection is cut into cells of ``WIDTH``; ``HASHES``
cells make a bucket of one table, and there are ``TABLES`` tables. Vectors that share a bucket are compared by their exact
cosine. A pair is counted in the first table where it meets, so counts need no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._graph import components
from ._ragged import U64, mix
from ._stage import saved

TABLES, HASHES, WIDTH = 16, 9, 1.0
#: A bucket of more vectors is cut into blocks of about so many, and pairs of blocks are separate groups.
BLOCK = 1_000


@lru_cache(8)
def directions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(projections, shifts) for vectors of one length; the same in every task."""
    rng = np.random.default_rng(1_000_003 + dim)
    return rng.standard_normal((dim, TABLES * HASHES)), rng.random(TABLES * HASHES) * WIDTH


def buckets(unit: np.ndarray) -> np.ndarray:
    """The bucket of each unit vector in each table, as (vectors, TABLES) int64."""
    a, b = directions(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), TABLES, HASHES)
    out = np.full((len(unit), TABLES), unit.shape[1], np.uint64)
    for k in range(HASHES):
        out = mix(out ^ cells[:, :, k], k + 1)
    return out.view(np.int64)


def _unit(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether valid) of rows of one length; a vector is valid if all is finite and not all is zero."""
    x = np.stack(rows).astype(np.float64)
    fine = np.isfinite(x).all(1)
    scale = np.abs(np.where(fine[:, None], x, 0)).max(1, initial=0)
    fine &= scale > 0
    x = np.where(fine[:, None], x, 0) / np.where(fine, scale, 1)[:, None]
    return x / np.where(fine, np.sqrt((x * x).sum(1)), 1)[:, None], fine


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, rep, copies, label, embedding) -> the same with ``spots``, the buckets in all tables; invalid vectors go."""
    for batch in batches:
        column = batch.column("embedding")
        values, offsets, gaps = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        rows = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        labels = batch.column("label").to_numpy()
        by_length: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            if len(row) and not gaps[k]:
                by_length.setdefault(len(row), []).append(k)
        for at in by_length.values():
            unit, fine = _unit([rows[k] for k in at])
            if not fine.any():
                continue
            at = np.array(at)[fine]
            spots = mix(buckets(unit[fine]).view(np.uint64) ^ mix(labels[at].astype(np.int64).view(np.uint64), 3)[:, None], 4).view(np.int64)
            out = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.FixedSizeListArray.from_arrays(pa.array(spots.ravel()), TABLES).cast(pa.list_(pa.int64()))], [*out.schema.names, "spots"])


def _compare(threshold: float):
    """Rows of one (table, bucket, block pair) after another -> per vector the copies it links to, and one edge of a spanning forest."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("spot", "table", "low", "high")], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            first = tuple(keys[0])
            if held and first != last:
                yield pa.Table.from_batches(held)
                held = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and a:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(keys[-1])
        if held:
            yield pa.Table.from_batches(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            n = group.num_rows
            if n < 2:
                continue
            group = group.combine_chunks()
            vectors = group.column("embedding").combine_chunks()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            unit, _ = _unit(list(flat.reshape(n, -1)) if len(flat) % n == 0 else [])
            spots = group.column("spots").combine_chunks().flatten().to_numpy().reshape(n, TABLES)
            table, copies = group.column("table")[0].as_py(), group.column("copies").to_numpy()
            block, low, high = group.column("block").to_numpy(), group.column("low")[0].as_py(), group.column("high")[0].as_py()
            links, root = np.zeros(n, np.int64), np.arange(n)
            left = np.flatnonzero(block == low)
            right = np.flatnonzero(block == high)
            for k in range(0, len(left), 256):
                part = left[k : k + 256]
                i, j = np.nonzero(unit[part] @ unit[right].T >= threshold)
                i, j = part[i], right[j]
                keep = i < j if low == high else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                if table:
                    met = np.zeros(len(i), bool)
                    for t in range(table):
                        met |= spots[i, t] == spots[j, t]
                    i, j = i[~met], j[~met]
                links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                while len(i):  # hang the larger root under the smaller until all links of this part agree
                    a, b = root[i], root[j]
                    if (a == b).all():
                        break
                    np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                    while (root[root] != root).any():
                        root = root[root]
            touched = np.flatnonzero(links)
            if len(touched):
                reps = group.column("rep").to_numpy()
                yield pa.record_batch({"class": group.column("class").combine_chunks().take(pa.array(touched)), "links": links[touched], "a": reps[touched], "b": reps[root[touched]]})

    return compare


def _label(vectors: DataFrame) -> Column:
    """The label as a long that equal labels share: itself if it is a whole number or a truth value, else 64 bits of a hash of its own type."""
    kind = vectors.schema["label"].dataType
    label = F.col("label")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return label.cast("long")
    return F.when(label.isNotNull(), F.xxhash64(label + 0 if isinstance(kind, T.FractionalType) else label))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included) and kept of every row.

    Rows link when their labels, of any type, are equal and not null and the cosine of their embeddings is at least threshold. Null,
    empty and zero vectors, and such with null or non-finite components, link with nothing, as do rows with a null
    vec_id, label, or different lengths. Cosines are in double precision; doubles are kept as they come. Equal vectors of a
    label (by 128 bits of hashes) are one class from the start, so copies are never compared; a large bucket is compared block by block. Every vector is in all tables, whatever the bucket's size. Rows
    that share a vec_id are counted each, and are one node of the graph. Other columns are ignored.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", _label(vectors).alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    same = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), "embedding", "label")))
    keyed = rows.withColumn("class", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), same))
    named = keyed.where("class is not null and embedding is not null and size(embedding) > 0")
    classes = named.groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    first = named.join(saved(classes, "vector-classes"), "class").where("vec_id = rep").select("class", "rep", "copies", "label", "embedding")
    hashed = saved(first.mapInArrow(_hashed, f"class string, rep long, copies long, label long, embedding {kind}, spots array<long>").dropDuplicates(["class"]), "vector-buckets")
    placed = hashed.select("class", F.posexplode("spots").alias("table", "spot"))
    sizes = placed.groupBy("table", "spot").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    full = placed.join(saved(sizes, "vector-sizes"), ["table", "spot"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    paired = full.select("class", "table", "spot", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("class", "table", "spot", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    loaded = paired.join(hashed, "class").select("table", "spot", "low", "high", "block", "class", "rep", "copies", "embedding", "spots")
    keys = ["spot", "table", "low", "high"]
    compared = loaded.repartition(*keys).sortWithinPartitions(*keys, "class").mapInArrow(_compare(threshold), "class string, links long, a long, b long")
    compared = saved(compared, "vector-links")
    links = compared.groupBy("class").agg(F.sum("links").alias("links"))
    found = components(compared.select("a", "b").distinct())
    ends = hashed.select("class", "rep", "copies").join(links, "class", "left").join(found, F.col("rep") == F.col("node"), "left")
    ends = saved(ends.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "vector-ends")
    out = keyed.select("vec_id", "class").join(ends, "class", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
