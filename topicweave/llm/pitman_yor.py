"""Language-model scoring by a hierarchical Pitman-Yor model.

A token is drawn from the restaurant of the token before it; a new table there
orders its dish from the parent that all contexts share, the root restaurant over
words, and a new table there from a uniform base over all training types and one
unknown. Every training token has a context restaurant of its own. Seating is
sampled by Gibbs: in a sweep, the customers of each dish in each restaurant leave
and are seated anew given all others. The number of their tables is drawn from its
conditional, which needs generalised Stirling numbers: these are exact up to EXACT
customers, and beyond that from a saddle point corrected by an exact row. Other
dishes' tables enter as they stood after the last sweep. Predictive probabilities are averaged
over SAMPLES sweeps.

How it is dealt out:

1. Word counts name the head, the HEAD most frequent words at most. Only what is
   known of the head is ever sent to all tasks.
2. Tasks read texts in chunks of some millions of tokens. A chunk sends each of
   its distinct pairs of neighbours once, with its training count, to a bucket: by
   a hash of both words if both are of the head, else by the word that is not (by
   the context if neither is). So no bucket gets more of a hot word or pair than
   one row a chunk, and what a seating needs of words beyond the head lies in its
   bucket. Words and pairs travel sorted, as differences, some three bytes each.
3. Buckets add the chunks up. Pairs seen once have one table; the others are the
   state that is swept. What does not change is kept where it lies; of a sweep only
   tables are written, and only tables by word of the head, and two sums, reach the
   driver.
4. A pair of two words beyond the head lies in both words' buckets, and both draw
   the same number for it: after each sweep the context's bucket sends the tables of
   the context, and the word's bucket the root's customers and tables of the word, in
   an order both know. So no seating depends on where the head ends.
5. Buckets meet the chunks' pairs again and answer, in the order asked, with counts
   and tables; chunks put their texts' scores together.

Words are named by 64-bit hashes; with a million types the odds of one clash are
below one in ten million.

Defined results: a null or empty text is its end token alone; a very long text is
a chunk by itself; rows repeated in full are scored alike and, in training, counted
each; rows without an id are learned from; with no training row all tokens are
unknown and N is 0; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bucket_of, encoded, grouped_word_hashes, materialise, mix, prepare, release, sweep_shuffles, trim

MODULUS, HELD_OUT = 10, 0
#: Words of the head at most (their places are 16 bits), tokens of a chunk, and tokens a bucket should have at most.
HEAD = 65_000
CHUNK_TOKENS = 5 << 18
BUCKET_TOKENS = 1 << 22
BURN_IN, SAMPLES = 2, 4
STRENGTH = 1.0
EXACT = 128
#: The end of a text, as a token.
END = np.uint64(0xE7D0C0DE5EED0001)
#: Distinct words a task holds before it sends their counts on.
HELD = 1 << 20
#: Tokens that are counted at once, and bytes of text that are hashed at once: arrays of some megabytes.
COUNTED = 1 << 19
RUN_BYTES = 1 << 18
#: Bytes of an Arrow batch: the JVM holds two or three of them a task beside its heap.
BATCH_BYTES = 4 << 20
#: Numbers that the head's sums are cut into on their way to the driver.
SLICES = 16
#: An odd number and its inverse modulo 2**32: spreads pairs of places over buckets, and back.
_SPREAD = 0x9E3779B1
_BACK = pow(_SPREAD, -1, 1 << 32)


# --- tokens and their counts ---------------------------------------------------


def token_runs(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and past-last text, their tokens with an end after each text, tokens per text."""
    for i, j, hashes, per in grouped_word_hashes(encoded(texts, lower=True), RUN_BYTES):
        yield i, j, np.insert(hashes, np.cumsum(per), END), per + 1


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n, trained over all texts (text, learn); each task adds up what it has seen before it sends anything."""

    def tally(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums by word; takes what it is given away."""
        columns = list(zip(*held))
        held.clear()
        words = np.concatenate(columns.pop(0))
        order = np.argsort(words)
        words = words[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(words)), bool), words[1:] != words[:-1])))
        return words[first], *(np.add.reduceat(np.concatenate(columns.pop(0))[order], first, dtype=np.int64) for _ in range(2))

    def sent(words: np.ndarray, n: np.ndarray, trained: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(words), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(words[s].view(np.int64)), pa.array(n[s]), pa.array(trained[s])], names=["word", "n", "trained"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, size, held, known = [], 0, [], 0  # tokens as they come; counts, and how many
        for batch in batches:
            learn = np.array(batch.column("learn").to_pylist(), dtype=bool)
            for i, j, tokens, per in token_runs(batch.column("text").to_pylist()):
                met.append((tokens, np.ones(len(tokens), dtype=np.int8), np.repeat(learn[i:j], per)))
                size += len(tokens)
                if size >= COUNTED:
                    held.append(tally(met))
                    size = 0
                    known += len(held[-1][0])
                    if known >= HELD + HELD // 2:
                        held.append(tally(held))
                        known = len(held[0][0])
                        if known >= HELD:
                            yield from sent(*held.pop())
                            known = 0
        if met:
            held.append(tally(met))
        if held:
            yield from sent(*tally(held))
        trim()

    return texts.mapInArrow(run, "word long, n long, trained long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def head_limit(words: DataFrame, head: int) -> int:
    """The least count at which no more than `head` words are left; steps of counts are a few hundred at most."""
    steps = words.filter("trained > 0").groupBy(F.floor(F.log2("trained") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("trained").alias("least")).collect()
    total, limit = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["n"]
        if total > head:
            break
        limit = r["least"]
    return limit


class Head:
    """The most frequent words by hash, and their training counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def places(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the head, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[i] == words, i, -1)


# --- numbers on the way ---------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 and more, byte plane by byte plane, compressed."""
    out, c = [struct.pack("<I", len(arrays))], zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a).astype(np.uint64)
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        body = c.compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        out += [struct.pack("<QII", len(a), width, len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    (k,), at, out, d = struct.unpack_from("<I", blob), 4, [], zstandard.ZstdDecompressor()
    for _ in range(k):
        n, width, size = struct.unpack_from("<QII", blob, at)
        at += 16
        a = np.zeros((n, 8), dtype=np.uint8)
        a[:, :width] = np.frombuffer(d.decompress(blob[at : at + size], max_output_size=max(1, n * width)), dtype=np.uint8).reshape(width, n).T
        out.append(a.reshape(-1).view(np.uint64))
        at += size
    return out


def narrow(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays that are held for long, in four bytes a number where all of them fit."""
    return [a.astype(np.uint32) if int(a.max(initial=0)) < 1 << 32 else a for a in arrays]


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; np.cumsum undoes them."""
    return np.diff(a.astype(np.uint64), prepend=np.uint64(0))


def bucket_of_words(words: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Layout:
    """Distinct words and pairs of a chunk, in the order in which they are asked for.

    codes: place of each token among the chunk's words; per: tokens of each text;
    place: of each word in the head, or -1; end: the code of the end token. Words
    are in the order of their hashes. `hh` and so on hold the pairs (rows of `context`
    and `word`) of head or tail context and head or tail word.
    """

    def __init__(self, codes: np.ndarray, per: np.ndarray, place: np.ndarray, end: int):
        n = len(place)
        before = np.empty(len(codes), dtype=np.int64)
        before[1:] = codes[:-1]
        before[np.cumsum(per) - per] = end
        before *= n
        before += codes
        pairs, at = np.unique(before, return_inverse=True)
        self.pair_of = at.astype(np.int32)
        del before, at
        self.context, self.word = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        del pairs
        self.tail = np.cumsum(place < 0) - 1  # place among the words beyond the head
        where = lambda found: np.flatnonzero(found).astype(np.int32)
        a, b = (place.astype(np.int32)[w] for w in (self.context, self.word))
        hh = where((a >= 0) & (b >= 0))
        spread = ((a[hh].astype(np.uint64) << np.uint64(16) | b[hh].astype(np.uint64)) * np.uint64(_SPREAD)) & np.uint64(0xFFFFFFFF)
        order = np.argsort(spread)
        self.hh, self.spread = hh[order], spread[order]
        del hh, spread, order
        ht, th, tt = where((a >= 0) & (b < 0)), where((a < 0) & (b >= 0)), where((a < 0) & (b < 0))
        self.ht = ht[np.lexsort((a[ht], self.word[ht]))]
        self.th = th[np.lexsort((b[th], self.context[th]))]
        self.tt = tt  # by context, then word, as they are
        self.dish = tt[np.lexsort((self.context[tt], self.word[tt]))]
        self.place = place


_CHUNK = "kind byte, bucket long, chunk long, blob binary, ids array<{kind}>, row_keys array<long>"
_ASK, _TEXT, _ANSWER = 0, 1, 2


def deals(spark, n: int) -> list[int]:
    """For each of n partitions a number that is dealt to it, so that no two buckets share a task by chance."""
    rows = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()  # n rows
    found = {r["at"]: r["id"] for r in rows}
    return [found.get(k, 32 * n + k) for k in range(n)]


def chunks(docs: DataFrame, head, dealt: list[int], kind: str, most: int = CHUNK_TOKENS) -> DataFrame:
    """docs (row_key, doc_id, text, learn) as rows of pairs to be answered, by bucket, and rows of texts as codes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, buckets = to_arrow_schema(_parse_datatype_string(_CHUNK.format(kind=kind))), len(dealt)

    def row(kind: int, bucket: int, chunk: int, blob: bytes, ids=None, keys=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((kind, bucket, chunk, blob, ids, keys), out)], schema=out)

    def told(held: list, h: Head) -> Iterator[pa.RecordBatch]:
        tokens, per, learn = (np.concatenate([x[k] for x in held]) for k in range(3))
        keys, ids = ([v for x in held for v in x[k]] for k in (3, 4))
        held.clear()
        chunk = keys[0]  # row keys are unique, so the first names the chunk
        words, codes = np.unique(tokens, return_inverse=True)
        del tokens
        codes, trained = codes.astype(np.int32), np.repeat(learn, per)
        lay = Layout(codes, per, h.places(words), int(np.searchsorted(words, END)))
        n_pair = np.bincount(lay.pair_of, weights=trained, minlength=len(lay.word)).astype(np.int64)
        far = words[lay.place < 0]
        n_far = np.bincount(codes, weights=trained, minlength=len(words)).astype(np.int64)[lay.place < 0]
        del trained
        bounds = np.searchsorted(bucket_of_words(far, buckets), np.arange(buckets + 1))
        cut = lambda order, by: np.searchsorted(lay.tail[by[order]], bounds)
        hh_cut = np.searchsorted(lay.spread * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        dish = lay.dish[n_pair[lay.dish] > 0]
        cuts = [cut(lay.ht, lay.word), cut(lay.th, lay.context), cut(lay.tt, lay.context), cut(dish, lay.word)]
        others = [(lay.place, lay.context), (lay.place, lay.word), (words, lay.word), (words, lay.context)]
        owners = [lay.word, lay.context, lay.context, lay.word]
        for b in range(buckets):
            s = slice(bounds[b], bounds[b + 1])
            arrays = [steps(far[s]), n_far[s], steps(lay.spread[hh_cut[b] : hh_cut[b + 1]]), n_pair[lay.hh[hh_cut[b] : hh_cut[b + 1]]]]
            for order, c, (names, other), owner in zip((lay.ht, lay.th, lay.tt, dish), cuts, others, owners):
                part = order[c[b] : c[b + 1]]
                arrays += [np.bincount(lay.tail[owner[part]] - bounds[b], minlength=bounds[b + 1] - bounds[b]), names[other[part]], n_pair[part]]
            yield row(_ASK, dealt[b], chunk, packed(*arrays))
        del dish, cuts, others, owners, far, n_far, n_pair
        place, lay = lay.place, None
        # Texts keep their tokens by rank, as small numbers compress well.
        by_rank = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int32)
        rank[by_rank] = np.arange(len(words))
        blob = packed(rank[codes], per, by_rank, place + 1, [np.searchsorted(words, END)])
        yield row(_TEXT, -1, chunk, blob, ids, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            learn, keys, ids = np.array(batch.column("learn").to_pylist(), dtype=bool), batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            for i, j, tokens, per in token_runs(batch.column("text").to_pylist()):
                if size and size + len(tokens) > most:
                    yield from told(held, head.value)
                    size = 0
                held.append((tokens, per, learn[i:j], keys[i:j], ids[i:j]))
                size += len(tokens)
        if held:
            yield from told(held, head.value)
        trim()

    return docs.mapInArrow(run, _CHUNK.format(kind=kind))


# --- seating ------------------------------------------------------------------


@lru_cache(maxsize=8)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t) of a discount, c and t up to `most`."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        stay = np.where(c - 1 - discount * t > 0, s[c - 1, t] + np.log(np.maximum(c - 1 - discount * t, 1e-300)), -np.inf)
        s[c, 1 : c + 1] = np.logaddexp(s[c - 1, t - 1], stay)
    return s


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and salt alone, so that a lost task repeats itself."""
    h = mix(keys ^ mix(np.full(1, salt, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1 and more: Stirling's series at x + 4, brought back by one product."""
    y = x + 4.0
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(x * (x + 1) * (x + 2) * (x + 3))


class Crowds:
    """Logs of generalised Stirling numbers S(c, t) for any c, by the saddle point of ((1 - (1 - z)^d) / d)^t / t!.

    What the saddle point misses depends on t / c^d, nearly alone, and is read off the exact row at c = ROW.
    """

    ROW = 2048

    def __init__(self, discount: float):
        self.d = d = discount
        y = np.concatenate([np.geomspace(1e-7, 1, 3000), np.geomspace(1, 80, 3000)[1:]])  # -log(1 - z)
        z, phi = -np.expm1(-y), -np.expm1(-d * y) / d
        h = z * np.exp((1 - d) * y) / phi
        self.ratio, self.height, self.width = np.log(h), np.log(phi) - h * np.log(z), np.maximum(h * (1 + (1 - d) * z * np.exp(y) - h), 1e-9)
        row = np.full(self.ROW + 1, -np.inf)
        row[0] = 0.0
        for c in range(1, self.ROW + 1):
            t = np.arange(1, c + 1)
            stay = np.where(c - 1 - d * t > 0, row[1 : c + 1] + np.log(np.maximum(c - 1 - d * t, 1e-300)), -np.inf)
            row[1 : c + 1], row[0] = np.logaddexp(row[:c], stay), -np.inf
        t = np.arange(1, self.ROW - 1)
        self.share, self.missed = np.log(t / self.ROW**d), row[1 : self.ROW - 1] - self.saddle(np.full(len(t), self.ROW), t)

    def saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        r = np.log(c / t)
        return log_gamma(c + 1.0) - log_gamma(t + 1.0) + t * np.interp(r, self.ratio, self.height) - 0.5 * np.log(2 * math.pi * t * np.interp(r, self.ratio, self.width))

    def logs(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = np.log(t) - self.d * np.log(c)
        slope = (self.missed[1] - self.missed[0]) / (self.share[1] - self.share[0])
        return self.saddle(c, t) + np.interp(x, self.share, self.missed) + np.minimum(x - self.share[0], 0) * slope


@lru_cache(maxsize=8)
def crowds(discount: float) -> Crowds:
    return Crowds(discount)


def sample_crowds(keys: np.ndarray, customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, salt: int, points: int = 64) -> np.ndarray:
    """Tables of dishes with more than EXACT customers, from the same conditional: its bulk is bracketed, then drawn from on a grid."""
    s, out = crowds(discount), np.empty(len(keys), dtype=np.int64)
    u, v = uniforms(keys, salt), uniforms(keys, salt + 1)
    for k in range(0, len(keys), 2048):
        part = slice(k, k + 2048)
        c, p, a = customers[part, None].astype(np.float64), np.log(parent[part, None] * discount), (strength / discount + others[part])[:, None]
        log_mass = lambda t: s.logs(c, t) + t * p + log_gamma(t + a)  # noqa: E731, B023
        grid = np.exp(np.linspace(0, 1, points) * np.log(c))
        for _ in range(2):
            g = log_mass(grid)
            bulk = g > g.max(axis=1, keepdims=True) - 30
            first, last = bulk.argmax(axis=1), points - 1 - bulk[:, ::-1].argmax(axis=1)
            rows = np.arange(len(grid))
            low, high = grid[rows, np.maximum(first - 1, 0)], grid[rows, np.minimum(last + 1, points - 1)]
            grid = low[:, None] + np.linspace(0, 1, points) * (high - low)[:, None]
        # Cells of whole numbers of tables between `low` and `high`; a cell is one number where they are few.
        low, high = np.floor(low), np.minimum(np.ceil(high), c[:, 0])
        size = np.maximum(1, np.ceil((high - low + 1) / points))
        start = low[:, None] + np.arange(points) * size[:, None]
        middle = np.minimum(start + (size[:, None] - 1) / 2, c)
        g = np.where(start <= high[:, None], log_mass(middle), -np.inf)
        mass = np.cumsum(np.exp(g - g.max(axis=1, keepdims=True)), axis=1)
        cell = (mass < u[part, None] * mass[:, -1:]).sum(axis=1)
        out[part] = np.minimum(low + cell * size + np.floor(v[part] * size), c[:, 0]).astype(np.int64)
    return np.maximum(out, 1)


def sample_tables(keys: np.ndarray, customers: np.ndarray, parent: np.ndarray, others: np.ndarray, discount: float, strength: float, salt: int) -> np.ndarray:
    """Tables of each dish: customers seated anew; `parent` is the dish's probability there, `others` the restaurant's other tables."""
    tables = np.minimum(customers, 1).astype(np.int64)
    stirling = log_stirling(discount)
    u = uniforms(keys, salt)
    few = np.where(customers <= EXACT, customers, 0)
    order = np.argsort(few, kind="stable")
    edges = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    log_parent = np.log(parent)
    for c in range(2, EXACT + 1):
        rows = order[edges[c - 2] : edges[c - 1]]
        step = max(1, (1 << 19) // c)
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            t = np.arange(1, c + 1)
            logs = np.log(strength + discount * (others[r, None] + t[None, :] - 1))
            logs += log_parent[r, None]
            np.cumsum(logs, axis=1, out=logs)
            logs += stirling[c, 1 : c + 1]
            logs -= logs.max(axis=1, keepdims=True)
            np.exp(logs, out=logs)
            mass = np.cumsum(logs, axis=1)
            tables[r] = 1 + (mass < u[r, None] * mass[:, -1:]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = sample_crowds(keys[many], customers[many], parent[many], np.maximum(others[many], 0), discount, strength, salt)
    return tables


class Totals:
    """After a sweep: tables of the head's contexts, root customers and root tables of its words, and sums of the last two over all words."""

    def __init__(self, tables: np.ndarray, customers: np.ndarray, root: np.ndarray, all_customers: int, all_root: int):
        self.tables, self.customers, self.root, self.all_customers, self.all_root = tables.astype(np.int32), customers.astype(np.int32), root.astype(np.int32), all_customers, all_root


class Setup:
    """What every sweep shares: the head, discounts, the number of types, and totals so far."""

    def __init__(self, head: Head, low: float, root: float, types: int, history: list[Totals]):
        self.head, self.low, self.root, self.types, self.history = head, low, root, types, history

    @property
    def base(self) -> float:
        return 1.0 / (self.types + 1)

    def root_prob(self, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's predictive of words with so many customers and tables there."""
        return (customers - self.root * tables + (STRENGTH + self.root * totals.all_root) * self.base) / (STRENGTH + totals.all_customers)

    def seat_root(self, words: np.ndarray, totals: Totals, customers: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        return sample_tables(words, customers, np.full(len(words), self.base), np.maximum(totals.all_root - tables, 0), self.root, STRENGTH, 2_000_003 * sweep + 1)


_PARTS = ("ht", "th", "tt", "dish")
_SWEPT = ("hh", *_PARTS)


class Bucket:
    """The words and pairs of a bucket: all chunks' added up.

    words, counts: words beyond the head. hh: spread places and counts of pairs
    within the head. ht, th, tt, dish: owner (a row of words), the other word (a place
    in the head, or a hash) and counts.
    """

    def __init__(self, blobs: list[bytes]):
        asked = [narrow(unpacked(b)) for b in blobs]
        lists = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
        self.words, where = np.unique(np.concatenate(lists), return_inverse=True)
        self.counts = np.bincount(where, weights=np.concatenate([a[1] for a in asked]), minlength=len(self.words)).astype(np.int64)
        self.places = np.split(where.astype(np.int32), np.cumsum([len(x) for x in lists])[:-1])
        del where, lists
        for a in asked:  # what has been added up is let go
            a[0] = a[1] = None
        self.hh_of, self.hh, self.hh_n = self._summed([np.cumsum(a[2], dtype=np.uint64) for a in asked], [a[3] for a in asked])
        for a in asked:
            a[2] = a[3] = None
        self.of: dict[str, list[np.ndarray]] = {}
        self.owner, self.other, self.n = {}, {}, {}
        for k, name in enumerate(_PARTS):
            owners = [p[np.repeat(np.arange(len(p)), a[4 + 3 * k].astype(np.int64))] for p, a in zip(self.places, asked)]
            if name in ("tt", "dish"):  # a hash: named by a hash of both words
                other = np.concatenate([a[5 + 3 * k] for a in asked]).astype(np.uint64)
                owner = np.concatenate(owners)
                keys = mix(other ^ mix(owner.astype(np.uint64) + np.uint64(1)))
                found, first, where = np.unique(keys, return_index=True, return_inverse=True)
                self.owner[name], self.other[name] = owner[first], other[first]
                self.n[name] = np.bincount(where, weights=np.concatenate([a[6 + 3 * k] for a in asked]), minlength=len(found)).astype(np.int64)
                self.of[name] = np.split(where.astype(np.int32), np.cumsum([len(x) for x in owners])[:-1])
                del owner, keys, found, first, where
            else:
                keys = [(o.astype(np.uint64) << np.uint64(16)) | a[5 + 3 * k] for o, a in zip(owners, asked)]
                self.of[name], found, self.n[name] = self._summed(keys, [a[6 + 3 * k] for a in asked])
                self.owner[name], self.other[name] = (found >> np.uint64(16)).astype(np.int64), (found & np.uint64(0xFFFF)).astype(np.int64)
                del keys, found
            for a in asked:
                a[4 + 3 * k : 7 + 3 * k] = None, None, None

    @staticmethod
    def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)
        return np.split(where.astype(np.int32), np.cumsum([len(k) for k in keys])[:-1]), found, n

    def state(self, buckets: int) -> "State":
        back = (self.hh * np.uint64(_BACK)) & np.uint64(0xFFFFFFFF)
        left, right = (back >> np.uint64(16)).astype(np.int64), (back & np.uint64(0xFFFF)).astype(np.int64)
        pick = lambda name: (self.owner[name], self.other[name], self.n[name])
        once = lambda name: self.owner[name][self.n[name] == 1]
        return State.of(self.words, (left, right, self.hh_n), pick("ht"), pick("th"), once("tt"), once("dish"), pick("tt"), pick("dish"), buckets)

    def far(self, state: "State") -> np.ndarray:
        """Rows of `tt` in the order in which the state has them."""
        many = np.flatnonzero(self.n["tt"] > 1)
        return many[_met(self.words, [a[many] for a in (self.owner["tt"], self.other["tt"], self.n["tt"])], True, len(state.tt[3]))[0]]


def _met(words: np.ndarray, part: list[np.ndarray], context: bool, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs of two words beyond the head as both their buckets order them: that order; owners, keys, counts, and how many there are with each bucket."""
    owner, other, n = part
    key = mix(words[owner] ^ mix(other)) if context else mix(other ^ mix(words[owner]))
    peer = bucket_of_words(other, buckets)
    order = np.lexsort((key, peer))
    return order, [owner[order], key[order], n[order], np.bincount(peer, minlength=buckets)]


class State:
    """What is seated in a bucket: pairs of two customers and more, and the tables that pairs of one have.

    settled: words left out, which have one customer at the root and nothing that is swept.
    """

    def __init__(self, arrays: list[np.ndarray]):
        keys = (0, len(arrays) - 7, len(arrays) - 3)  # hashes
        signed = [a if k in keys else a.astype(np.int64) for k, a in enumerate(arrays)]
        self.words, self.fixed_tables, self.fixed_customers, self.head_tables, self.head_customers, self.settled, *rest = signed
        self.hh, self.ht, self.th, self.tt, self.dish = rest[0:3], rest[3:6], rest[6:9], rest[9:13], rest[13:17]

    def arrays(self) -> list[np.ndarray]:
        return [self.words, self.fixed_tables, self.fixed_customers, self.head_tables, self.head_customers, self.settled, *self.hh, *self.ht, *self.th, *self.tt, *self.dish]

    @classmethod
    def of(cls, words, hh, ht, th, tt_contexts, tt_words, tt=None, dish=None, buckets: int = 1) -> "State":
        """tt_contexts and tt_words: of pairs beyond the head that are seen once; tt and dish: of all of them, by context and by word."""
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        many = lambda part: [a[part[2] > 1] for a in part]
        one = lambda part, k: part[k][part[2] == 1]
        size = lambda a: int(a.max(initial=-1)) + 1
        tables = np.bincount(one(th, 0), minlength=len(words)) + np.bincount(tt_contexts, minlength=len(words))
        customers = np.bincount(one(ht, 0), minlength=len(words)) + np.bincount(tt_words, minlength=len(words))
        h = max(size(x) for x in (hh[0], hh[1], ht[1], th[1]))
        head_tables = np.bincount(one(hh, 0), minlength=h) + np.bincount(one(ht, 1), minlength=h)
        head_customers = np.bincount(one(hh, 1), minlength=h) + np.bincount(one(th, 1), minlength=h)
        met = [_met(words, many(part or nothing), context, buckets)[1] for part, context in ((tt, True), (dish, False))]
        return cls([words, tables, customers, head_tables, head_customers, np.zeros(1, np.int64), *many(hh), *many(ht), *many(th), *met[0], *met[1]])

    def slim(self) -> tuple["State", np.ndarray]:
        """Without the words that no sweep changes, and the rows of those that stay."""
        stays = self.fixed_customers > 1
        for owner in (self.ht[0], self.th[0], self.tt[0], self.dish[0]):
            stays[owner] = True
        row = np.cumsum(stays) - 1
        moved = lambda part: [row[part[0]], *part[1:]]
        fixed = [a[stays] for a in (self.words, self.fixed_tables, self.fixed_customers)]
        settled = self.settled + self.fixed_customers[~stays].sum()
        parts = [*self.hh, *moved(self.ht), *moved(self.th), *moved(self.tt), *moved(self.dish)]
        return State([*fixed, self.head_tables, self.head_customers, settled, *parts]), np.flatnonzero(stays)

    def now(self, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Tables of all pairs, and tables and root customers of the words."""
        add = lambda owner, name: np.bincount(owner, weights=t[name], minlength=len(self.words)).astype(np.int64)
        tables = self.fixed_tables + add(self.th[0], "th") + add(self.tt[0], "tt")
        return {**t, "tables": tables, "customers": self.fixed_customers + add(self.ht[0], "ht") + add(self.dish[0], "dish")}

    def start(self) -> dict[str, np.ndarray]:
        last = self.now({name: np.ones(len(getattr(self, name)[2]), dtype=np.int64) for name in _SWEPT})
        return {**last, "root": np.minimum(last["customers"], 1)}

    def stored(self, last: dict[str, np.ndarray]) -> bytes:
        return packed(*(last[name] for name in _SWEPT), last["root"])

    def restored(self, blob: bytes) -> dict[str, np.ndarray]:
        *t, root = (a.astype(np.int64) for a in unpacked(blob))
        return {**self.now(dict(zip(_SWEPT, t))), "root": root}

    def letters(self, last: dict[str, np.ndarray]) -> dict[int, bytes]:
        """For each bucket that pairs are shared with: tables of their contexts here; root customers and tables of their words here."""
        cuts = [np.concatenate(([0], np.cumsum(part[3]))) for part in (self.tt, self.dish)]
        found = {}
        for b in np.flatnonzero(self.tt[3] + self.dish[3]).tolist():
            contexts, words = (part[0][cut[b] : cut[b + 1]] for part, cut in zip((self.tt, self.dish), cuts))
            found[b] = packed(last["tables"][contexts], last["customers"][words], last["root"][words])
        return found

    def read(self, letters: dict[int, bytes]) -> list[np.ndarray]:
        """Of all letters, by bucket: tables of the contexts of `dish`, root customers and tables of the words of `tt`."""
        parts = [unpacked(letters[b]) for b in sorted(letters)]
        told = [np.concatenate([np.zeros(0, np.int64), *(p[k].astype(np.int64) for p in parts)]) for k in range(3)]
        if [len(a) for a in told] != [len(self.dish[0]), len(self.tt[0]), len(self.tt[0])]:
            raise ValueError("buckets differ on the pairs they share")
        return told

    def step(self, setup: Setup, totals: Totals, last: dict[str, np.ndarray], letters: dict[int, bytes], sweep: int) -> dict[str, np.ndarray]:
        """All pairs seated anew, given what was so after the last sweep, here and where the letters come from."""
        h, salt = setup.head.words, 2_000_003 * sweep
        keys = {"hh": mix(h[self.hh[0]] ^ mix(h[self.hh[1]])), "ht": mix(h[self.ht[1]] ^ mix(self.words[self.ht[0]])), "th": mix(self.words[self.th[0]] ^ mix(h[self.th[1]])), "tt": self.tt[1], "dish": self.dish[1]}
        context_tables, word_customers, word_root = self.read(letters)
        head_prob = setup.root_prob(totals, totals.customers, totals.root)
        own_prob = setup.root_prob(totals, last["customers"], last["root"])
        seat = lambda k, c, parent, all_: sample_tables(keys[k], c, parent, np.maximum(all_ - last[k], 0), setup.low, STRENGTH, salt)
        new = self.now({
            "hh": seat("hh", self.hh[2], head_prob[self.hh[1]], totals.tables[self.hh[0]]),
            "ht": seat("ht", self.ht[2], own_prob[self.ht[0]], totals.tables[self.ht[1]]),
            "th": seat("th", self.th[2], head_prob[self.th[1]], last["tables"][self.th[0]]),
            "tt": seat("tt", self.tt[2], setup.root_prob(totals, word_customers, word_root), last["tables"][self.tt[0]]),
            "dish": seat("dish", self.dish[2], own_prob[self.dish[0]], context_tables),
        })
        return {**new, "root": setup.seat_root(self.words, totals, new["customers"], last["root"], sweep)}

    def sweeps(self, setup: Setup) -> Iterator[dict[str, np.ndarray]]:
        """A bucket that is alone, at the start and after each sweep whose totals are known."""
        last = self.start()
        yield last
        for sweep, totals in enumerate(setup.history, 1):
            last = self.step(setup, totals, last, self.letters(last), sweep)
            yield last

    def head_sums(self, last: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables by context and customers by word of the head, as this bucket has them."""
        add = lambda places, w: np.bincount(places, weights=w, minlength=n)
        known = lambda a: np.pad(a, (0, n - len(a)))
        tables = known(self.head_tables) + add(self.hh[0], last["hh"]) + add(self.ht[1], last["ht"])
        customers = known(self.head_customers) + add(self.hh[1], last["hh"]) + add(self.th[1], last["th"])
        return tables.astype(np.int64), customers.astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows that share a key, of batches sorted by it."""
    held, last = [], None
    for batch in batches:
        for i in range(batch.num_rows):  # not all of a batch at once: blobs are copied
            r = batch.slice(i, 1).to_pylist()[0]
            if held and r[by] != last:
                yield last, held
                held = []
            last = r[by]
            held.append(r)
    if held:
        yield last, held


def states(asked: DataFrame, buckets: int) -> DataFrame:
    """bucket, blob, and how many pairs are seen once and twice, how many words beyond the head have one and two contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            b = Bucket([r["blob"] for r in rows])
            s = b.state(buckets)
            first = s.fixed_customers + np.bincount(s.ht[0], minlength=len(s.words)) + np.bincount(s.dish[0], minlength=len(s.words))
            pairs = [b.hh_n, *(b.n[k] for k in ("ht", "th", "tt"))]
            seen = [sum(int((n == k).sum()) for n in pairs) for k in (1, 2)]
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "blob": [packed(*s.slim()[0].arrays())], "once": [seen[0]], "twice": [seen[1]], "root_once": [int((first == 1).sum())], "root_twice": [int((first == 2).sum())]})
            del b, s, first, pairs, rows
        trim()

    dealt = asked.select("bucket", "chunk", "blob").repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "bucket long, blob binary, once long, twice long, root_once long, root_twice long")


_ROUND = "kind byte, bucket long, origin long, blob binary, own long, root long"
_SEATS, _LETTER, _SUMS = 0, 1, 2


def seated_anew(seated: DataFrame, before: DataFrame, shared, dealt: list[int], sweep: int, send: bool) -> DataFrame:
    """Each bucket after a sweep: its tables, letters to other buckets if they are still to be sent, and sums. `before` is the same after the last sweep."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, place_of = to_arrow_schema(_parse_datatype_string(_ROUND)), {d: k for k, d in enumerate(dealt)}

    def run(known: pa.Table, told: pa.Table) -> pa.Table:
        setup, bucket = shared.value, known.column("bucket")[0].as_py()
        s, rows = State(unpacked(known.column("blob")[0].as_py())), told.to_pylist()
        if sweep:
            last = s.restored(next(r["blob"] for r in rows if r["kind"] == _SEATS))
            last = s.step(setup, setup.history[-1], last, {r["origin"]: r["blob"] for r in rows if r["kind"] == _LETTER}, sweep)
        else:
            last = s.start()
        settled, origin = int(s.settled[0]), place_of[bucket]
        rows = [(_SEATS, bucket, origin, s.stored(last), 0, 0)]
        rows += [(_LETTER, dealt[b], origin, blob, 0, 0) for b, blob in (s.letters(last) if send else {}).items()]
        rows.append((_SUMS, bucket, origin, packed(*s.head_sums(last, len(setup.head.words))), int(last["customers"].sum()) + settled, int(last["root"].sum()) + settled))
        del s, last
        trim()
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    told = before.filter(F.col("kind") != _SUMS).select("kind", "bucket", "origin", "blob").repartition(len(dealt), "bucket")
    return seated.select("bucket", "blob").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, _ROUND)


def swept(table: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sums over all buckets after a sweep; tasks add their buckets up first, then slices of the head meet."""
    edges = np.linspace(0, n, SLICES + 1).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, customers, own, root = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                a, b = unpacked(r["blob"])
                tables, customers = tables + a.astype(np.int64), customers + b.astype(np.int64)
                own, root = own + r["own"], root + r["root"]
        rows = [(k, packed(tables[i:j], customers[i:j]), own * (k == 0), root * (k == 0)) for k, (i, j) in enumerate(zip(edges, edges[1:]))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["slice", "blob", "own", "root"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in _groups(batches, "slice"):
            total = [sum(a) for a in zip(*(unpacked(r["blob"]) for r in rows))]
            yield pa.RecordBatch.from_pydict({"slice": [k], "blob": [packed(*total)], "own": [sum(r["own"] for r in rows)], "root": [sum(r["root"] for r in rows)]})

    kinds = "slice long, blob binary, own long, root long"
    sums = table.filter(F.col("kind") == _SUMS).select("blob", "own", "root")
    rows = sums.mapInArrow(run, kinds).repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(add, kinds).collect()
    if not rows:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0
    parts = [unpacked(r["blob"]) for r in sorted(rows, key=lambda r: r["slice"])]
    tables, customers = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
    return tables, customers, sum(r["own"] for r in rows), sum(r["root"] for r in rows)


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Model:
    """A fitted model: the chunks, the setup with the totals of all sweeps, the number of training tokens, and the buckets after the averaged sweeps."""

    def __init__(self, table: DataFrame, dealt: list[int], setup: Setup, tokens: int, samples: int, rounds: list[DataFrame]):
        self.table, self.dealt, self.setup, self.tokens, self.samples, self.rounds = table, dealt, setup, tokens, samples, rounds


def fit(docs: DataFrame, head: int = HEAD, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """docs: doc_id, text, learn. Two passes over the texts, then sweeps over the seated pairs. The chunks hold all texts, learned from or not."""
    spark = docs.sparkSession
    prepare(spark, BATCH_BYTES)
    kind = dict(docs.dtypes)["doc_id"]
    counts = materialise(word_counts(docs.select("text", "learn")), "word-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"), F.count_if(F.col("trained") > 0).alias("types")).first()
    found = counts.filter(F.col("trained") >= head_limit(counts, min(head, HEAD))).select("word", "trained").toArrow()
    h = Head(found.column("word").to_numpy().view(np.uint64), found.column("trained").to_numpy())
    release(counts)
    del counts
    sweep_shuffles(spark)
    shared_head = spark.sparkContext.broadcast(h)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(sums["n"] or 0) // BUCKET_TOKENS))
    dealt = deals(spark, buckets)
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text", "learn")
    table = materialise(chunks(keyed, shared_head, dealt, kind), "chunks")
    with arrow_rows(spark, 64):  # rows of some hundred thousand bytes
        # Kept on executors' disks by bucket, so that a sweep shuffles only what is told; lost parts are made again from the chunks.
        seated = states(table.filter(F.col("kind") == _ASK), buckets).repartition(buckets, "bucket").persist(StorageLevel.DISK_ONLY)
        few = seated.agg(*[F.sum(c).alias(c) for c in ("once", "twice", "root_once", "root_twice")]).first()
        low = root = _discount(few["once"] or 0, few["twice"] or 0)  # the root's follows from the start
        history, rounds = [], [spark.createDataFrame([], _ROUND)]
        for sweep in range(burn_in + samples + 1):
            setup = Setup(h, low, root, sums["types"], history[-1:])
            shared = spark.sparkContext.broadcast(setup)
            rounds.append(materialise(seated_anew(seated, rounds[-1], shared, dealt, sweep, sweep < burn_in + samples), "sweep"))
            tables, customers, own, own_root = swept(rounds[-1], len(h.words))
            if not sweep:  # customers are contexts still: of the head here, of other words in the buckets' counts
                root = _discount(*((few[c] or 0) + int((customers == k).sum()) for k, c in ((1, "root_once"), (2, "root_twice"))))
            before = history[-1] if sweep else None
            seats = setup.seat_root(h.words, before, customers, before.root, sweep) if sweep else np.minimum(customers, 1)
            history.append(Totals(tables, customers, seats, int(customers.sum()) + own, int(seats.sum()) + own_root))
            shared.unpersist()
            if 0 < sweep <= burn_in + 1:  # the table before is none of the averaged ones
                release(rounds[-2])
        seated.unpersist()
        del seated
        sweep_shuffles(spark)
    return Model(table, dealt, Setup(h, low, root, sums["types"], history), sums["trained"] or 0, samples, rounds[-samples:])


# --- scoring ------------------------------------------------------------------


def answers(model: Model, _shared, kind: str) -> DataFrame:
    """For each chunk and bucket, in the order asked: counts, and tables of the averaged sweeps; of words also root customers and root tables."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out, samples, buckets = to_arrow_schema(_parse_datatype_string(_CHUNK.format(kind=kind))), model.samples, len(model.dealt)
    place_of = {d: k for k, d in enumerate(model.dealt)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            sweeps, rows = [r["blob"] for r in rows if r["chunk"] < 0], [r for r in rows if r["chunk"] >= 0]
            b = Bucket([r["blob"] for r in rows])
            full = b.state(buckets)
            s, stay = full.slim()
            known = {"hh": b.hh_n, **{name: b.n[name] for name in ("ht", "th", "tt")}}
            seats = {name: np.minimum(n, 1) * samples for name, n in known.items()}
            many = {"tt": b.far(full), **{name: np.flatnonzero(known[name] > 1) for name in ("hh", "ht", "th")}}
            for name, at in many.items():
                seats[name][at] = 0
            words = []
            for blob in sweeps:
                last = s.restored(blob)
                for name, at in many.items():
                    seats[name][at] += last[name]
                for name, fixed in (("tables", full.fixed_tables), ("customers", full.fixed_customers), ("root", np.minimum(full.fixed_customers, 1))):
                    words.append(fixed.astype(np.int32))
                    words[-1][stay] = last[name]
            del full
            for i, r in enumerate(rows):
                at = b.places[i]
                arrays = [b.counts[at], *(w[at] for w in words)]
                for name, place in (("hh", b.hh_of[i]), *((name, b.of[name][i]) for name in ("ht", "th", "tt"))):
                    arrays += [known[name][place], seats[name][place]]
                values = (_ANSWER, place_of[bucket], r["chunk"], packed(*arrays), None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, out)], schema=out)
            b = s = known = seats = many = words = last = sweeps = rows = at = None  # before the next bucket
        trim()

    asked = model.table.filter(F.col("kind") == _ASK).select("bucket", "chunk", "blob")
    for k, table in enumerate(model.rounds):  # sort first, in their order
        asked = asked.unionAll(table.filter(F.col("kind") == _SEATS).select("bucket", F.lit(k - samples).cast("long").alias("chunk"), "blob"))
    return asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _CHUNK.format(kind=kind))


class Told:
    """A chunk put together from its texts and the answers to it: counts of its words, and the averaged predictive of each of its pairs."""

    def __init__(self, rows: list[dict], setup: Setup, totals: list[Totals]):
        rank, per, by_rank, place, end = unpacked(rows[0]["blob"])  # the texts sort first, then answers by bucket
        self.per, place, by_rank = per.astype(np.int64), place.astype(np.int64) - 1, by_rank.astype(np.int64)
        self.codes = by_rank.astype(np.int32)[rank.astype(np.int32)]
        del rank, by_rank
        self.layout = lay = Layout(self.codes, self.per, place, int(end[0]))
        parts, samples = [narrow(unpacked(r["blob"])) for r in rows[1:]], len(totals)

        def told(k: int) -> np.ndarray:
            """Once each: what has been taken is let go."""
            found = np.concatenate([p[k] for p in parts]).astype(np.float64)
            for p in parts:
                p[k] = None
            return found

        near, far = place >= 0, place < 0
        self.count = count = np.zeros(len(place))
        count[near], count[far] = setup.head.counts[place[near]], told(0)
        n, seats = np.zeros(len(lay.word)), np.zeros(len(lay.word))
        for k, pairs in enumerate((lay.hh, lay.ht, lay.th, lay.tt)):
            n[pairs], seats[pairs] = told(1 + 3 * samples + 2 * k), told(2 + 3 * samples + 2 * k)
        self.prob = (n - setup.low * seats / samples) / (STRENGTH + count[lay.context])
        del n, seats
        for k, t in enumerate(totals):
            tables, customers, root = (np.zeros(len(place)) for _ in range(3))
            for a, head, j in ((tables, t.tables, 1), (customers, t.customers, 2), (root, t.root, 3)):
                a[near], a[far] = head[place[near]], told(3 * k + j)
            back = (STRENGTH + setup.low * tables) / (STRENGTH + count)
            self.prob += back[lay.context] * setup.root_prob(t, customers, root)[lay.word] / samples


def broadcasts(model: Model):
    """What scores need: the setup, and the totals that the averaged sweeps end in."""
    spark, setup = model.table.sparkSession, model.setup
    return spark.sparkContext.broadcast(Setup(setup.head, setup.low, setup.root, setup.types, [])), spark.sparkContext.broadcast(setup.history[-model.samples :])


def score(model: Model) -> DataFrame:
    """row_key, doc_id, n_tokens, n_known, base_score, score, perplexity of every row of the documents the model was fitted with."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = dict(model.table.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    id_type = to_arrow_type(_parse_datatype_string(kind))
    shared, last = broadcasts(model)
    floor = model.tokens + 0.1 * (model.setup.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "chunk"):
            told = Told(rows, shared.value, last.value)
            per, codes = told.per, told.codes
            owner = np.repeat(np.arange(len(per), dtype=np.int32), per)
            by_text = lambda v: np.bincount(owner, weights=v, minlength=len(per))  # noqa: E731, B023
            total = by_text(np.log10(told.prob)[told.layout.pair_of])
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[0]["row_keys"], type=pa.int64()), pa.array(rows[0]["ids"], type=id_type), pa.array(per), pa.array(by_text(told.count[codes] > 0).astype(np.int64)),
                pa.array(by_text(np.log10((told.count + 0.1) / floor)[codes])), pa.array(total), pa.array(10.0 ** (-total / per)),
            ], names=["row_key", "doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])
            del told, codes, owner, total, rows  # before the next chunk is put together
        trim()

    both = model.table.filter(F.col("kind") == _TEXT).unionAll(answers(model, shared, kind))
    met = both.repartition(2 * len(model.dealt), "chunk").sortWithinPartitions("chunk", "bucket")
    return met.mapInArrow(run, f"row_key long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fit on rows outside the held-out part, and score all."""
    held = lambda c: F.coalesce(bucket_of(c, MODULUS) == HELD_OUT, F.lit(False))
    model = fit(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (~held(id_col)).alias("learn")), **options)
    return score(model).select("doc_id", held("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
