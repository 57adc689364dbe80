"""SimHash near-duplicates by tiled exact comparison.

Fingerprints follow from all word shingles of a whole text. Equal fingerprints
are one node. Nodes are compared exactly, tile against tile, with exclusive-or
and bit counts in numpy; tiles are ordered by population count, and a pair of
tiles whose counts differ by more than the radius is skipped, since such
fingerprints cannot be within it. To keep the comparisons near linear at scale,
nodes first meet by blocks of bits: of radius + k blocks, k agree in any pair
within the radius, so tiles are formed within groups that share k blocks and no
pair is lost. Groups larger than LARGEST are split, and their parts are compared
pair by pair in separate tasks. A task reports a spanning forest of what it
links, never all pairs.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a very long text's shingles are all counted, a block at a time; a bit set
in exactly half of the hashes (a tie) is 0; in `near_duplicates` a null id is
passed over for the component's smallest id unless there is no other; rows that repeat a text share a component; an empty table gives an empty
result; other columns of the input are ignored. Of each component one row stays
in `drop_near_duplicates`, the one with the smallest id (null ids come last, so
a document without an id stays unless another of its component does); where ids
tie, the smallest SHA-256 of the text decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_row, encoded, materialise, prepare
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 1024
#: Nodes of a group that one task compares alone.
LARGEST = 1 << 15
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text (UTF-8, already lower case) as an unsigned integer."""
    words = raw.split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        part = hashes[i : i + _BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), and the text's SHA-256 if asked for."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    more = [text_digest(text_col).alias("digest")] if digest else []

    def run(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(raw, shingle, seed) for raw in encoded(batch.column("text").to_pylist(), lower=True)]
        return {"doc_id": batch.column("doc_id"), "fp": np.array(found, dtype=np.uint64).view(np.int64)} | ({"digest": batch.column("digest")} if digest else {})

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more), run, f"doc_id {kind}, fp long" + (", digest string" if digest else ""))


def text_digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def block_masks(radius: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` blocks out of radius + agree."""
    n = radius + agree
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(blocks, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def agreeing_blocks(nodes: int, radius: int = RADIUS) -> int:
    """Blocks that must agree, so that an average group stays below a few thousand nodes."""
    agree = 1
    while nodes >> (64 * agree // (radius + agree)) > 4096 and agree < 6:
        agree += 1
    return agree


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Lower labels over the links a-b until they are settled."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def tile_links(fps: np.ndarray, radius: int, tile: int = TILE, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps (unsigned); with sides, of those between different sides."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    x = fps[order]
    bits = np.bitwise_count(x).astype(np.int16)
    half = None if side is None else side[order]
    n, label = len(x), np.arange(len(x))
    for i in range(0, n, tile):
        rows = x[i : i + tile]
        for j in range(i, n, tile):
            if bits[j] - bits[min(i + tile, n) - 1] > radius:
                break  # all later tiles have still larger population counts
            near = np.bitwise_count(rows[:, None] ^ x[None, j : j + tile]) <= radius
            if half is not None:
                near &= half[i : i + tile, None] != half[None, j : j + tile]
            a, b = np.nonzero(near)
            a, b = a + i, b + j
            if len(a := a[keep := a < b]):
                label = _roots(n, a, b[keep], label)
    moved = np.flatnonzero(label != np.arange(n))
    return x[moved], x[label[moved]]


def _compare(groups: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links within each group of rows that share the keys; `side` tells two parts of a group apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts):
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            fps = t.column("fp").to_numpy().view(np.uint64)
            if len(fps) < 2:
                return
            side = t.column("side").to_numpy()
            one = bool((side == side[0]).all())
            a, b = tile_links(fps, radius, side=None if one else side)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and tuple(c[0] for c in cols) != last
            cuts = [*np.flatnonzero(new), batch.num_rows]
            at = 0
            for k, cut in enumerate(cuts):
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if k < len(cuts) - 1:
                    yield from done(held)
                    held = []
                at = cut
            last = tuple(c[-1] for c in cols)
        yield from done(held)

    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) that connect what is within the radius; nodes: distinct fp."""
    spark = nodes.sparkSession
    agree = agreeing_blocks(nodes.count(), radius)
    masks = block_masks(radius, agree)
    meets = nodes.select("fp", F.posexplode(F.array(*map(F.lit, masks)))).select(F.col("pos").alias("choice"), F.col("fp").bitwiseAND(F.col("col")).alias("bits"), "fp")
    keys = ["choice", "bits"]
    big = meets.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > largest)
    big = materialise(big, "large-groups")
    small = meets.join(big, keys, "left_anti").select(*keys, "fp", F.lit(0).alias("side"))
    links = _compare(small, keys, radius)
    if big.isEmpty():
        return links
    parts = F.ceil(F.col("n") / (largest // 2)).cast("int")
    split = meets.join(big, keys).withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select(*keys, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "fp", "side")
    return links.unionAll(_compare(paired, [*keys, "i", "j"], radius))


def linked_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each linked fingerprint a with the least fingerprint b of its component; nodes: distinct fp."""
    stars = connected_components(fingerprint_links(nodes, radius))
    return stars.unionAll(stars.select(F.col("b").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest id it reaches, itself included)."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    firsts = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    whole = linked_fingerprints(firsts.select("fp"), radius)
    named = whole.join(firsts, whole["a"] == firsts["fp"]).select("fp", F.col("b").alias("root"), "first_id")
    named = materialise(named, "named")
    least = materialise(named.groupBy("root").agg(F.min("first_id").alias("least_id")), "least")  # written, so that a large component's rows can be split over tasks
    linked = named.join(least, "root").select(F.col("fp").alias("linked_fp"), "least_id")
    nodes = firsts.join(linked, firsts["fp"] == linked["linked_fp"], "left").select(F.col("fp").alias("node"), F.coalesce("least_id", "first_id").alias("component_id"))
    nodes = materialise(nodes, "components")  # both sides of the join are then plain exchanges, and a hot fingerprint can be split
    return fps.join(nodes, fps["fp"] == nodes["node"]).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the columns it came with, whatever their names and types.

    Survivors are named by id and text. Where rows repeat both, one stays: the one whose columns come last as JSON.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, digest=True), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    firsts = materialise(fps.groupBy("fp").agg(F.min(row).alias("first")), "nodes")
    whole = linked_fingerprints(firsts.select("fp"))
    rooted = firsts.join(whole, firsts["fp"] == whole["a"], "left").select(F.coalesce("b", "fp").alias("root"), "first")
    survivors = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    repeated = fps.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    survivors = survivors.join(repeated, F.col("kept_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_digest") == F.col("digest")), "left")
    survivors = materialise(survivors.select("kept_id", "kept_digest", F.col("n").isNotNull().alias("again")), "survivors")
    rows = docs.select(as_row(docs), F.col(f"`{id_col}`").alias("own_id"), text_digest(text_col).alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest"))
    once = rows.join(survivors.filter("not again"), same, "left_semi").select("row.*")
    again = survivors.filter("again")
    if again.isEmpty():
        return once
    few = rows.join(again, same, "left_semi").groupBy("own_id", "own_digest").agg(F.max_by("row", F.to_json("row")).alias("row"))
    return once.unionAll(few.select("row.*"))
