"""Mixing sources to target weights, in DataFrame functions only.

Tokens are added up per source, each source's share follows from its weight,
and a document is emitted floor(rate) times plus once more when a hash of its
id falls below the fraction. The hash is MD5 over seed and id, so reruns and
other engines draw the same copies.

Defined results: a null text has size 0 and is emitted like any other; a very
long text is counted whole; a null source is a source of its own, after all
others; rows that share an id, or have none, share their draw, so rows repeated in
full are each emitted alike; a source whose share equals its cap (a tie) is
capped, which gives the same target; an empty table gives an empty result; columns
of any other name come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, as_row, materialise

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Sources that are sent to the rows at most.
MOST_SENT = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(per: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Sources with their weight by place in code point order; places are counted by partition, so no task holds all sources."""
    n = len(weights)
    low = F.lit((1 << 33) - 1)
    sorted_ = per.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    sorted_ = materialise(sorted_.withColumns({"part": F.shiftright("at", 33), "own": F.col("at").bitwiseAND(low)}), "sources")
    before, offsets = 0, []
    for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        offsets.append((r["part"], before % n))
        before += r["n"]
    table = per.sparkSession.createDataFrame(offsets, "part long, before long")
    place = F.pmod(F.col("own") + F.col("before"), F.lit(n)).cast("int")
    return sorted_.join(F.broadcast(table), "part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long").alias("weight"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source: source, source_size, target. `sized` has source and size.

    Targets are min(most * size, level * weight) with the level at which they add
    up to all sizes: what resharing the excess until none is above ends in. Each
    round shares what capped sources leave among the others and caps those above,
    in exact numbers; rounds are sums over sources, and end when none is added.
    """
    placed = _placed(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    whole = placed.withColumns({"cap": (F.col("source_size") * most).cast("decimal(25,0)"), "source_size": F.col("source_size").cast("long")})
    total, weight, n = whole.agg(F.sum(F.col("source_size").cast("decimal(25,0)")), F.sum("weight"), F.count("*")).first()
    rest, rest_weight, capped = int(total or 0), int(weight or 0), 0
    exact = lambda v: F.lit(str(v)).cast("decimal(25,0)")
    while True:
        is_capped = exact(rest) * F.col("weight").cast("decimal(12,0)") >= F.col("cap") * exact(rest_weight).cast("decimal(12,0)")
        size, gone, now = whole.filter(is_capped).agg(F.sum("cap"), F.sum("weight"), F.count("*")).first()
        if now == capped:
            break
        rest, rest_weight, capped = int(total) - int(size or 0), int(weight) - int(gone or 0), now
    shared = (exact(rest) * F.col("weight").cast("decimal(12,0)")).cast("double") / F.lit(float(max(rest_weight, 1)))
    return whole.select("source", "source_size", F.when(is_capped, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) with 52 bits from a hash of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """row (the input's columns as one struct), doc_id, size, source_size, target, and copies: the times the mix takes the row."""
    sized = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    # A row per source: sent to the rows if there are few, else joined, with hot sources left to adaptive splitting.
    targets = materialise(source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "target_source"), "targets")
    few = targets.count() <= MOST_SENT
    joined = sized.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("target_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return joined.select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, with the input's columns."""
    taken = with_copies(docs, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
