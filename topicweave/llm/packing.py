"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The covering
program (fewest configurations that hold every length as often as it occurs) is
solved by multiplicative weights: a length's weight falls as it is covered, and
a knapsack dynamic program prices the best configurations at these weights. The
solution covers every length in full, and scaled weights bound any cover from
below. It is rounded down; for what is left the program is solved again a few
times, and the last few pieces go by best fit.
Only the histogram, at most one number per length, reaches the driver. Pieces
find their place by their rank among pieces of their length, which is counted
in two steps so that a length shared by most pieces is no single task's load.

Defined results: with `added`, an added token written out in a text is that one
token, as the tokenizers file has it by default (the queries ask for this); else
it is spelled out. A null or empty text is one end token; a very long text is
tokenised whole, by its own task, and cut; rows that repeat an id, or whose id is
null, are packed each for itself and told apart by `row_key`, a number of the
input row; pieces of equal length are interchangeable, so ties are broken by id,
piece and content; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, materialise, prepare

CAPACITY = 2048
END_ID = 0
ROUNDS = 240
PER_ROUND = 96
#: How strongly the part of its demand that was covered lowers a length's weight, and how near to the best a configuration must be.
ETA = 0.1
SLACK = 0.002
#: Extra weight of long lengths at the start; they have fewer partners.
CURVE = 0.05
#: How often the program is solved again for what rounding leaves.
AGAIN = 5
#: Pieces that are ranked together.
RANKED = 2_000


# --- tokens ------------------------------------------------------------------


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level BPE files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


_PROBE = ["It's 2024: naïve café, 東京 🚀!\n\n  two  spaces\tand tabs <|endoftext|> 'LL x_y-z", "", " ", "aaaa" * 30, "  \r\n\x0b\x1c"]


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False):
    """A function from text to ids of the tokenizers file at path.

    With `added`, an added token written out in a text is that token, as the
    file's defaults have it; else it is spelled out like any other text. The
    file's own vocabulary also drives a faster library with the same merge rule;
    it is used where it gives the same ids on a set of awkward texts.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = not added
    tokens = [t for t in slow.get_added_tokens_decoder().values() if added or not t.special]
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    try:
        import tiktoken

        symbols = _byte_symbols()
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        written = [t.content for t in tokens]

        def both(text: str) -> list[int]:
            # A very long run without a break is slow to merge in the fast library, and added tokens are unknown to it.
            return plain(text) if len(text) >= 1_000_000 or any(w in text for w in written) else fast(text)

        if slow.normalizer is None and all(both(t) == plain(t) for t in _PROBE):

            return both
    except (ImportError, KeyError, ValueError):
        pass
    return plain


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32 of each piece, and its ids as bytes if asked for."""
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        encode, out = encoder(tokenizer, added), defaultdict(list)
        rows = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                raw = ids[a:b].tobytes()
                rows.append(row)
                out["piece"].append(k)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(raw))
                if keep_ids:
                    out["ids"].append(raw)
        return {c: batch.column(c).take(pa.array(rows, type=pa.int64())) for c in ("row_key", "doc_id")} | out

    source = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, run, f"row_key long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else ""))


# --- the plan ----------------------------------------------------------------


class _Pricing:
    """Unbounded knapsack over capacities, for given lengths and weights."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, capacity: int):
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
        upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for j in range(1, capacity + 1):
            best[j], take[j] = best[j - 1], -2
            if k := upto[j]:
                values = best[j - lengths[:k]] + weights[:k]
                i = int(values.argmax())
                if values[i] > best[j]:
                    best[j], take[j] = values[i], i
        self.lengths, self.weights, self.best, self.take, self.capacity = lengths, weights, best, take, capacity

    def with_item(self, i: int) -> list[int]:
        """The best configuration that holds item i."""
        found, j = [i], self.capacity - int(self.lengths[i])
        while j > 0:
            if self.take[j] == -2:
                j -= 1
            else:
                found.append(int(self.take[j]))
                j -= int(self.lengths[self.take[j]])
        return found

    def values(self) -> np.ndarray:
        return self.weights + self.best[self.capacity - self.lengths]


class Cover:
    """A fractional solution: amounts of configurations that cover the demand, the last weights, and the best dual bound."""

    def __init__(self, amounts: dict[tuple[int, ...], float], weights: np.ndarray, covered: np.ndarray, bound: float):
        self.amounts, self.weights, self.covered, self.bound = amounts, weights, covered, bound

    @property
    def objective(self) -> float:
        return sum(self.amounts.values())


def fractional_cover(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Cover:
    """The covering program, solved until every length is covered.

    A round prices the configurations of the lengths still open at their weights.
    Of the near-best, those whose lengths lag most are taken, each as often as
    its scarcest length allows, and the weight of each length is multiplied by
    exp(-ETA * the part of its demand that was covered). Weights over the value
    of the best configuration are feasible for the dual program; their worth is a
    lower bound on any cover. After ROUNDS all near-best configurations of a
    round are taken, so that it ends: each round covers at least one length.
    """
    covered = np.zeros(len(lengths))
    weights = lengths / capacity * (1 + CURVE * lengths / capacity)
    amounts: dict[tuple[int, ...], float] = defaultdict(float)
    bound, done = float(demand @ lengths) / capacity, 0
    while len(some := np.flatnonzero(covered < 1)):
        price = _Pricing(lengths[some], weights[some], capacity)
        if len(some) == len(lengths):
            bound = max(bound, float(demand @ weights) / price.best[capacity])
        value = price.values()
        good = np.flatnonzero(value >= (1 - SLACK) * value.max())
        picks = good[np.argsort(covered[some[good]] - lengths[some[good]] / capacity, kind="stable")]
        moved = np.zeros(len(lengths))
        for i in picks[: per_round if done < rounds else None]:
            kinds, times = np.unique(some[price.with_item(int(i))], return_counts=True)
            step = float(((1 - covered[kinds] - moved[kinds]) * demand[kinds] / times).min())
            if step > 1e-12:
                amounts[tuple(np.repeat(kinds, times).tolist())] += step
                moved[kinds] += step * times / demand[kinds]
        covered += moved
        covered[(1 - covered) * demand < 1e-6] = 1.0  # a millionth of a piece is an error of arithmetic
        weights = weights * np.exp(-ETA * moved)
        done += 1
    return Cover(amounts, weights, covered, bound)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in order of decreasing length, over groups of equal bins."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    filled = np.zeros(capacity + 1, dtype=bool)
    for i in np.argsort(-lengths, kind="stable"):
        size, m = int(lengths[i]), int(left[i])
        while m:
            open_at = np.flatnonzero(filled[size:])
            if len(open_at):
                room = size + int(open_at[0])
                items, k = bins[room].popitem()
                if k > m:
                    bins[room][items] = k - m
                filled[room] = bool(bins[room])
                n, items = min(k, m), (*items, int(i))
                room -= size
                m -= n
            else:
                each = min(m, capacity // size)
                n, items, room = m // each, (int(i),) * each, capacity - each * size
                m -= n * each
            bins[room][items] = bins[room].get(items, 0) + n
            filled[room] = True
    return [(items, n) for group in bins for items, n in group.items()]


def _rounded(lengths: np.ndarray, demand: np.ndarray, capacity: int, again: int = AGAIN) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations: those the program takes whole and full, then the same for what is left, at last best fit."""
    left, plan = demand.copy(), []
    for _ in range(again):
        some = np.flatnonzero(left)
        if not len(some):
            break
        took = 0
        for items, x in sorted(fractional_cover(lengths[some], left[some], capacity).amounts.items(), key=lambda e: (-e[1], e[0])):
            items = some[list(items)]
            kinds, times = np.unique(items, return_counts=True)
            n = min(int(x + 1e-9), int((left[kinds] // times).min()))
            if n > 0 and lengths[items].sum() == capacity:
                left[kinds] -= n * times
                plan.append((tuple(items.tolist()), n))
                took += n
        if not took:
            break
    return plan + _best_fit(lengths, left, capacity)


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (lengths, times) that hold every length as often as it occurs."""
    plan = [((capacity,), n)] if (n := histogram.get(capacity, 0)) else []
    lengths = np.array(sorted(k for k in histogram if k < capacity), dtype=np.int64)
    if not len(lengths):
        return plan
    demand = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    return plan + [(tuple(int(lengths[i]) for i in items), n) for items, n in _rounded(lengths, demand, capacity)]


class _Places:
    """Where the piece with a given length and rank goes."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        used, rows, base = defaultdict(int), [], 0
        for items, n in plan:
            at = 0
            for size in sorted(set(items), reverse=True):
                times = items.count(size)
                rows.append((size, used[size], times, base, at))
                used[size] += n * times
                at += size * times
            base += n
        rows.sort()
        self.size, self.first, self.times, self.base, self.at = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 5
        self.sizes, self.begin = np.unique(self.size, return_index=True)
        self.end = np.append(self.begin[1:], len(self.size))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.empty(len(length), dtype=np.int64)
        for size in np.unique(length):
            k = int(np.searchsorted(self.sizes, size))
            a, b = self.begin[k], self.end[k]
            hit = length == size
            row[hit] = a + np.searchsorted(self.first[a:b], rank[hit], side="right") - 1
        inside = rank - self.first[row]
        return self.base[row] + inside // self.times[row], self.at[row] + inside % self.times[row] * length


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """The pieces with `rank`, 0, 1, ... among those of their length."""
    parts = max(1, -(-total // RANKED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row_key", "piece"), F.lit(parts)).cast("int"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_rank"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row_key")) - 1
    return salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("offset_rank")).drop("salt", "own", "offset_rank")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row_key, sequence_id, offset; one row per piece. Pieces of an input row share its row_key."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids, added), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_Places(pack_histogram(histogram, capacity)))  # bounded by rounds and lengths, not by rows
    at = ranked(pieces, sum(histogram.values()))

    def run(batch: pa.RecordBatch) -> dict:
        sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
        return {n: batch.column(n) for n in batch.schema.names if n != "rank"} | {"sequence_id": sequence, "offset": offset}

    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "row_key", *["ids"] * keep_ids]
    kinds = dict(pieces.dtypes)
    return arrow_map(at.select(*keep, F.col("rank").cast("long")), run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids as little-endian bytes; needs pack(..., keep_ids=True). A group has at most `capacity` rows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
