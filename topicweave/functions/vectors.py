"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import bound


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """The vector over its length, at least 1e-9."""
    return bound(F.greatest(norm(v), F.lit(1e-9)), lambda size: F.transform(doubles(v), lambda x: x / size))


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * alpha + y * (1 - alpha))


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, centroid: the mean of the vectors of each key, partly summed before the shuffle."""
    cells = rows.select(key, F.posexplode(doubles(F.col(vector))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("centroid"))


def nearest(rows: DataFrame, centres: DataFrame, row_key: str, vector: str = "embedding", centre_key: str = "topic_id") -> DataFrame:
    """row_key, the centre with the highest cosine (lowest key on a tie), and that cosine.

    Centres are one row a topic, so the optimizer sends them to the rows; the row's best is taken in place.
    """
    table = centres.select(F.collect_list(F.struct(F.col(centre_key).alias("k"), "centroid", norm(F.col("centroid")).alias("size"))).alias("centres"))
    paired = rows.select(row_key, vector, norm(F.col(vector)).alias("size")).join(table, how="cross")
    # Lengths are taken once a row and once a centre.
    sim = lambda c: F.when(F.col("size") * c["size"] == 0, F.lit(0.0)).otherwise(dot(F.col(vector), c["centroid"]) / (F.col("size") * c["size"]))
    best = F.array_max(F.transform("centres", lambda c: F.struct(F.round(sim(c), 9).alias("sim"), (-c["k"]).alias("minus"))))
    return paired.select(row_key, best.alias("b")).select(row_key, (-F.col("b.minus")).alias(centre_key), F.col("b.sim").alias("sim"))


def ranked(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """rows with `rank` from 1 in each group of `by`; the order must end in a tiebreak."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
