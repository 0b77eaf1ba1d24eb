"""Whitening of embeddings: covariance from upper-triangle column aggregates, components from LAPACK.

One Spark SQL expression for each pair of dimensions i <= j sums the product of both centred columns, and all are computed
in one aggregation with partial sums, so one row of sums reaches the driver, whatever the number of vectors.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import saved

#: Pairs of dimensions in one aggregation: all of up to 90 dimensions; more take several.
PAIRS = 4_096
SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond count as this.
MOST = 2.0**62


def fit_list(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id and x, whole numbers, of every vector that counts, written to the shared folder; the number of dimensions)."""
    v = F.col(column)
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != math.inf), F.lit(False)))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(SCALE * c.cast("double"), F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    good = saved(vectors.where(v.isNotNull() & finite & (F.size(v) > 0)).select("vec_id", whole.alias("x")), "whole-vectors")
    common = good.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0]["dim"] if common else 0
    return good.where(F.size("x") == dim), dim


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension)."""
    got = rows.select(F.count(F.lit(1)), *(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(dim))).first()
    return got[0], [int(s) for s in got[1:]] if got[0] else [0] * dim


def covariance(rows: DataFrame, column: str, means: list[float], n: int) -> np.ndarray:
    """Covariance (divisor n) of an array column around the means: each pair's centred products are summed by one expression."""
    dim = len(means)
    centred = [f"({column}[{i}] - {m!r}D)" for i, m in enumerate(means)]
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    out = np.zeros((dim, dim))
    for k in range(0, len(pairs), PAIRS):
        part = pairs[k : k + PAIRS]
        got = rows.selectExpr(*(f"sum({centred[i]} * {centred[j]}) as s{i}_{j}" for i, j in part)).first()
        for (i, j), total in zip(part, got, strict=True):
            out[i, j] = out[j, i] = total / n
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, at most so many; those that rounding made up go."""
    values, vectors = np.linalg.eigh(v)  # LAPACK's symmetric solver
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > max(values[0], 0) * len(values) * 1e-13).sum()) if len(values) else 0
    return values[: min(most, real)], vectors[:, : min(most, real)]


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component up to ``most``.

    Rows whose embedding is null, empty, or holds null or non-finite entries are dropped, as are those of another length than
    the most frequent one (of several, the longest). The others are scaled to whole numbers x = floor(1024 * c) + 100000 (beyond 2**62:
    2**62) and are the fit list. ``deviation`` is the exact sum over dimensions of (n * x - S)**2, null where no long can hold it.
    There are as many components as directions in which the vectors vary, at most ``most``: none, so no rows, for an empty
    table or equal vectors. Repeated and null ids come out as often as they came in. Other columns are ignored.
    """
    rows, dim = fit_list(vectors)
    n, totals = sums(rows, dim)
    means = [t / n for t in totals] if n else []
    v = covariance(rows, "x", means, n) if n else np.zeros((0, 0))
    values, axes = components(v, most)
    if not len(values):
        return rows.where("false").selectExpr("vec_id", "0 as component", "0L as n", "0L as deviation", "0D as whitened", "0D as explained", "0D as identity_error")
    centred = F.zip_with("x", F.array(*map(F.lit, means)), lambda c, m: c - m)
    shadow = lambda axis: F.aggregate(F.zip_with("centred", F.array(*map(F.lit, axis.tolist())), lambda c, a: c * a), F.lit(0.0), lambda s, c: s + c)
    white = F.array(*(shadow(axes[:, k] / math.sqrt(values[k])) for k in range(len(values))))
    exact = f"aggregate(zip_with(x, array({', '.join(f'{t}BD' for t in totals)}), (c, t) -> cast({n}BD * c - t as decimal(38,0))), 0BD, (s, c) -> cast(try_add(s, try_multiply(c, c)) as decimal(38,0)))"
    exact = exact.replace("0BD, (s", "cast(0 as decimal(38,0)), (s")
    seen = saved(rows.withColumn("centred", centred).select("vec_id", F.expr(f"try_cast({exact} as bigint)").alias("deviation"), white.alias("w")), "white-vectors")
    centre = list(seen.select(*(F.avg(F.col("w")[k]) for k in range(len(values)))).first())
    off = float(np.abs(covariance(seen, "w", centre, n) - np.eye(len(values))).max())
    share = F.array(*map(F.lit, (values / np.trace(v)).tolist()))
    out = seen.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, "k").alias("explained"), F.lit(off).alias("identity_error"))
