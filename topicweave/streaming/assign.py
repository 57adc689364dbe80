"""An extension: assigning arriving documents to frozen topics. State-free, so late rows need no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.vectors import cosine


def assign(stream: DataFrame, centres: list[tuple[int, list[float]]], least: float = -1.0) -> DataFrame:
    """The stream (or table) with topic_id and sim; below `least` a document stays unassigned (-1). Centres are one per topic."""
    table = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.array(*[F.lit(float(x)) for x in v]).alias("c")) for k, v in centres])
    best = F.array_max(F.transform(table, lambda t: F.struct(F.round(cosine(F.col("embedding"), t["c"]), 9).alias("sim"), (-t["k"]).alias("minus"))))
    scored = stream.withColumn("__best", best)
    return scored.withColumn("topic_id", F.when(F.col("__best.sim") >= least, -F.col("__best.minus")).otherwise(F.lit(-1))).withColumn("sim", F.col("__best.sim")).drop("__best")


def counts(assigned: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Documents per topic and time window; rows later than `late` are left out."""
    return assigned.withWatermark(time, late).groupBy(F.window(time, window), "topic_id").agg(F.count("*").alias("n"))
