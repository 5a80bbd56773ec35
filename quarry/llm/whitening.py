"""Operator 13: whitening of embeddings by a principal component analysis over all rows.

Entries become integers, so the sums per dimension and n * x - S are exact and rows are centred without rounding before
anything is multiplied. MLlib's RowMatrix takes the Gramian of the centred rows in the executors; the driver gets d * d
numbers (d: the width of a vector, whatever the number of rows), solves for the eigenvectors, and sends the whitening
matrix back to mapInPandas. The Gramian of the whitened rows gives the distance from the identity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components with less than this share of the largest eigenvalue can't be told from rounding in doubles.
LEAST = 1e-10
#: Larger entries have no x that fits a long.
LARGEST = float(2**56)

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vector: Column) -> Column:
    """An array of numbers as the array of x; null where x does not fit."""
    return F.transform(vector, lambda c: F.when(F.abs(c.cast("double")) < LARGEST, F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))


def usable(vector: Column) -> Column:
    """Neither null, nor with entries that are null, not finite, or at least LARGEST in size."""
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def gramian(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Sum of the outer products of the arrays of doubles in rows' only column, summed up in the executors."""
    (name,) = rows.columns
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(name)).alias("v")), "v")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray()


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2 of each row, in integers; None beyond a long."""
    largest = max([0, int(np.abs(x).max()), *map(abs, sums)]) if x.size else 0
    if (n + 1) * largest < 2**62:
        away = n * x - np.array(sums, np.int64)
        if int(np.abs(away).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**63:
            return (away * away).sum(1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    return [d if d < 2**63 else None for d in (away * away).sum(1)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n with one rounding: the whole parts of S / n are subtracted in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole) - part


def whiten(rows: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component: OUT.

    rows needs the columns named; others are ignored. Vectors that are not usable() are dropped, and so are those of
    another width than the commonest (of equally common ones the largest). Repeated rows and null ids stay, as rows of
    their own. Components without variance (LEAST) have a null `whitened`, and identity_error is over the others; it is
    null if there is none. deviation is null beyond a long. No usable vector, or only empty ones, give no row.
    """
    spark = rows.sparkSession
    clean = rows.select(F.col(vec_id).cast("string").alias("vec_id"), F.col(embedding).alias("e")).where(usable(F.col("e"))).select("vec_id", integers(F.col("e")).alias("x"))
    top = clean.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if top is None or top["width"] == 0:
        return spark.createDataFrame([], OUT)
    width, n = top["width"], top["count"]
    clean = clean.where(F.size("x") == width)
    totals = clean.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()  # a row per dimension
    sums = [int(s) for _, s in sorted(map(tuple, totals))]

    def middle(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({"v": list(centred(np.stack(b["x"].to_numpy()), n, sums))})

    covariance = gramian(clean.select("x").mapInPandas(middle, "v array<double>"), n, width) / n
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    vector = vector * np.where(np.take_along_axis(vector, np.abs(vector).argmax(0)[None], 0) < 0, -1, 1)
    trace, k = float(np.trace(covariance)), len(value)
    kept = int(np.sum(value > max(LEAST * value[0], 0.0)))  # eigenvalues fall, so these come first
    fit = spark.sparkContext.broadcast((sums, vector[:, :kept] / np.sqrt(value[:kept])))

    def project(batches):
        s, matrix = fit.value
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": pd.array(exact_deviation(x, n, s), "Int64"), "w": list(centred(x, n, s) @ matrix)})

    out = clean.mapInPandas(project, "vec_id string, deviation long, w array<double>")
    error = None
    if kept:
        error = float(np.abs(gramian(out.select("w"), n, kept) / n - np.eye(kept)).max())
    explained = F.array(*[F.lit(max(0.0, float(v)) / trace if trace > 0 else None).cast("double") for v in value])
    each = out.select("vec_id", "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("component"))
    return each.select(
        F.col("vec_id").cast(rows.schema[vec_id].dataType).alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", F.get("w", F.col("component") - 1).alias("whitened"),
        F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of whiten() for all of `embeddings`, up to 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
