"""Quality classifier: Bradley-Terry pairwise ranking.

A text's worth is a linear function of its features. Every pair of a text that
is labelled good and one labelled bad is a preference, won by the first with
probability sigmoid(worth difference); the logistic loss over such feature
differences is minimised. The score at the quantile that equals the labelled
share of bad texts becomes the threshold, and worth is mapped to (0, 1) so that
the threshold lies at THRESHOLD.

Features see the whole text: frequencies of pairs of character classes, hashed
words, and a few shapes of words and lines. Fitting reads every labelled text outside
the held-out part, and the loss is that of all pairs of them: a text's pull depends
on the other label's scores alone, and these are added up in BINS bins with the mean of
each, which is right to about 1e-4. A step takes two passes over the labelled texts' features, which
are computed once and stored sparsely; the threshold's quantiles are those of all their scores.

Defined results: a null text is scored as an empty one; a very long text's
features are counted over all of it; a score equal to the threshold (a tie) is
predicted 1; rows without an id are not held out, and have no label; a label
given twice counts once, and an id labelled both ways is an example of both; with
labels of only one kind, or none, every score is the constant PRIOR; rows
repeated in full are scored alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bucket_of, encoded, grouped_word_hashes, materialise, prepare, release, sums_by

MODULUS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PRIOR = 0.5
#: How far to either side of the quantile the threshold is taken from, as a part of each label's share.
MARGIN = 0.03
#: Steps at most, and the part of the first gradient's length at which they end.
STEPS, ENOUGH = 60, 1e-3
#: Bins of scores between -REACH and REACH; offsets within a bin are added up as whole numbers of 1 / UNIT.
BINS, REACH, UNIT = 1024, 32.0, float(1 << 40)
#: Bins that a quantile's range is cut into, over and over.
CUTS, ROUNDS = 512, 5
#: Bits of the map of labelled ids' hashes, by which texts without a label are passed over before the join.
SLOTS = 1 << 24
RIDGE = 2e-3
HASHED = 1024

#: Classes of bytes: letters, digits, white space, and each mark that junk text uses.
_MARKS = "#*$%&|<>!?.,;:'\"()[]{}/\\-_=+@~^`"
CLASSES = 5 + len(_MARKS) + 2
_CLASS = np.full(256, CLASSES - 1, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    if "a" <= _c <= "z":
        _CLASS[_b] = 0
    elif "A" <= _c <= "Z":
        _CLASS[_b] = 1
    elif "0" <= _c <= "9":
        _CLASS[_b] = 2
    elif _c == "\n":
        _CLASS[_b] = 4
    elif _b <= 0x20:
        _CLASS[_b] = 3
    elif _b >= 0x80:
        _CLASS[_b] = CLASSES - 2
    elif _c in _MARKS:
        _CLASS[_b] = 5 + _MARKS.index(_c)
SHAPES = 10
WIDTH = CLASSES * CLASSES + HASHED + SHAPES


def features(raws: list[bytes]) -> np.ndarray:
    """One row of WIDTH numbers per text (UTF-8)."""
    out = np.zeros((len(raws), WIDTH), dtype=np.float32)
    words_at = CLASSES * CLASSES
    for k, raw in enumerate(raws):
        if len(raw) > 1:
            cls = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
            pairs = np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=words_at)
            out[k, :words_at] = np.sqrt(pairs / (len(raw) - 1))
    for i, j, hashes, per in grouped_word_hashes(raws):
        owner = np.repeat(np.arange(j - i), per)
        slot = (hashes >> np.uint64(20)).astype(np.int64) % HASHED
        counts = np.bincount(owner * HASHED + slot, minlength=(j - i) * HASHED).reshape(j - i, HASHED)
        n = np.maximum(per, 1)[:, None]
        out[i:j, words_at : words_at + HASHED] = np.sqrt(counts / n)
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(hashes), dtype=np.int64)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = sums_by(fresh, per)
        size = np.array([len(r) for r in raws[i:j]])
        lines = np.array([r.count(b"\n") + 1 for r in raws[i:j]])
        shape = out[i:j, words_at + HASHED :]
        shape[:, 0] = np.log1p(per)
        shape[:, 1] = np.log1p(size / n[:, 0])
        shape[:, 2] = distinct / n[:, 0]
        shape[:, 3] = np.log1p(lines)
        shape[:, 4] = np.log1p(per / lines)
        shape[:, 5] = per < 20
        shape[:, 6] = per < 50
        shape[:, 7] = (per > 0) & (distinct / n[:, 0] < 0.3)
        shape[:, 8] = [len(set(r.split(b"\n"))) / (r.count(b"\n") + 1) for r in raws[i:j]]
        shape[:, 9] = per == 0
    return out


class Ranking:
    """Weights of the features, and the worth at the threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.worth(x) - self.cut, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


# --- the loss of all pairs -----------------------------------------------------------

_EDGES = np.linspace(-REACH, REACH, BINS + 1)
_MIDDLE = (_EDGES[1:] + _EDGES[:-1]) / 2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def binned(scores: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each label (bad, good) the rows in each bin, and the sum of their offsets from its middle."""
    at = np.clip(((scores + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)
    off, key = np.clip(scores - _MIDDLE[at], -1, 1), at + BINS * good
    n, sums = np.bincount(key, minlength=2 * BINS), np.bincount(key, weights=off, minlength=2 * BINS)
    return np.stack([n.reshape(2, BINS), np.rint(sums * UNIT).astype(np.int64).reshape(2, BINS)])


class Pulls:
    """The loss of all pairs, and the derivative by a row's score, from binned scores."""

    def __init__(self, bins: np.ndarray):
        n, off = bins.astype(np.float64)
        share = n / n.sum(axis=1, keepdims=True)
        at = _MIDDLE + off / UNIT / np.maximum(n, 1)
        bad, good = n[0] > 0, n[1] > 0
        gap = at[0, bad][:, None] - at[1, good][None]
        self.loss = float(share[0, bad] @ np.logaddexp(0, gap) @ share[1, good])
        total = n.sum(axis=1)
        self.good = -(_sigmoid(at[0, bad][None] - _EDGES[:, None]) @ share[0, bad]) / total[1]
        self.bad = (_sigmoid(_EDGES[:, None] - at[1, good][None]) @ share[1, good]) / total[0]

    def of(self, scores: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(good, np.interp(scores, _EDGES, self.good), np.interp(scores, _EDGES, self.bad))


def minimised(bins, gradient, width: int, ridge: float = RIDGE, steps: int = STEPS, enough: float = ENOUGH) -> np.ndarray:
    """Weights of the least loss by limited-memory quasi-Newton steps. bins(w): binned scores; gradient(w, pulls): of the pairs' loss."""
    w = np.zeros(width)
    pulls = Pulls(bins(w))
    loss, g, past = pulls.loss, gradient(w, pulls), []
    first = np.linalg.norm(g)
    for _ in range(steps):
        if np.linalg.norm(g) <= enough * first:
            break
        d, back = -g, []
        for s, y in reversed(past):
            back.append((s @ d) / (s @ y))
            d = d - back[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else min(1.0, 0.1 / np.linalg.norm(g)))
        for (s, y), alpha in zip(past, reversed(back)):
            d = d + (alpha - (y @ d) / (s @ y)) * s
        size, slope = 1.0, g @ d
        for _ in range(12):
            there = w + size * d
            pulls = Pulls(bins(there))
            now = pulls.loss + ridge / 2 * (there @ there)
            if now <= loss + 1e-4 * size * slope:
                break
            size /= 3
        else:
            break
        new = gradient(there, pulls) + ridge * there
        if (there - w) @ (new - g) > 1e-12:
            past = [*past, (there - w, new - g)][-12:]
        w, loss, g = there, now, new
    return w


def fit_pairs(x: np.ndarray, n: int, share_bad: float, steps: int = STEPS, ridge: float = RIDGE) -> Ranking:
    """Bradley-Terry weights of rows at hand, and the quantile threshold; the first n rows are good. x is scaled in place."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.02)
    x -= mean
    x /= scale
    good = np.arange(len(x)) < n
    w = minimised(lambda w: binned(x @ w, good), lambda w, pulls: pulls.of(x @ w, good) @ x, x.shape[1], ridge, steps)
    s = x @ w
    weight = np.where(good, (1 - share_bad) / n, share_bad / (len(x) - n))
    order = np.argsort(s)
    mass = np.cumsum(weight[order])
    cut = np.mean([s[order][min(len(s) - 1, int(np.searchsorted(mass, q)))] for q in quantiles(share_bad)])
    return Ranking(mean, scale, w, float(cut))


def quantiles(share_bad: float) -> tuple[float, float]:
    """Both sides of the quantile: the threshold is half-way between the upper part of the bad share and the lower part of the good."""
    return share_bad * (1 - MARGIN), share_bad + (1 - share_bad) * MARGIN


# --- labelled texts -------------------------------------------------------------------


class Sparse:
    """Features of labelled rows: whether they are good, how many numbers each has, places and numbers."""

    def __init__(self, batch: pa.RecordBatch):
        read = lambda c, t: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=t)
        self.good, self.per, self.at, self.x = read("good", bool), read("per", np.int32), read("at", np.uint16), read("x", np.float32)
        self.owner = np.repeat(np.arange(len(self.per)), self.per)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.x * w[self.at], minlength=len(self.per))

    def back(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.x * c[self.owner], minlength=WIDTH)


class Labelled:
    """Stored features of all labelled rows; `added` is one pass, in which tasks add up and the driver adds one array a task."""

    def __init__(self, table: DataFrame):
        self.table, self.mean, self.scale = table, np.zeros(WIDTH), np.ones(WIDTH)

    def added(self, fn) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    one = fn(Sparse(batch))
                    total = one if total is None else total + one
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], names=["x", "kind"])

        found = self.table.mapInArrow(run, "x binary, kind string").toArrow().to_pylist()
        return sum(np.frombuffer(r["x"], dtype=r["kind"]) for r in found) if found else np.zeros(0)

    def scores(self, w: np.ndarray):
        """The scores of a task's rows, as a function of them."""
        u = w / self.scale
        shift = float(self.mean @ u)
        return lambda rows: rows.dot(u) - shift

    def bins(self, w: np.ndarray) -> np.ndarray:
        score = self.scores(w)
        return self.added(lambda rows: binned(score(rows), rows.good).ravel()).reshape(2, 2, BINS)

    def gradient(self, w: np.ndarray, pulls: Pulls) -> np.ndarray:
        score = self.scores(w)

        def one(rows: Sparse) -> np.ndarray:
            c = pulls.of(score(rows), rows.good)
            return np.append(rows.back(c), c.sum())

        total = self.added(one)
        return (total[:-1] - self.mean * total[-1]) / self.scale

    def fit(self) -> Ranking | None:
        def moments(rows: Sparse) -> np.ndarray:
            squares = np.bincount(rows.at, weights=rows.x.astype(np.float64) ** 2, minlength=WIDTH)
            return np.concatenate([rows.back(np.ones(len(rows.per))), squares, [len(rows.per), rows.good.sum()]])

        total = self.added(moments)
        if not len(total) or not 0 < total[-1] < total[-2]:
            return None
        n = total[-2]
        self.mean = total[:WIDTH] / n
        self.scale = np.sqrt(np.maximum(total[WIDTH : 2 * WIDTH] / n - self.mean**2, 0)) + 0.02
        w = minimised(self.bins, self.gradient, WIDTH)
        score, wanted = self.scores(w), [q * n for q in quantiles(1 - total[-1] / n)]
        low, high, below = np.full(2, -REACH), np.full(2, REACH), np.zeros(2)
        for k in range(ROUNDS):  # each quantile's range is narrowed to one of its bins

            def counts(rows: Sparse, low=low.copy(), width=(high - low) / CUTS, first=k == 0) -> np.ndarray:
                s = score(rows)
                at = [np.floor((s - a) / b).astype(np.int64) for a, b in zip(low, width)]
                at = [np.clip(p, 0, CUTS - 1) if first else p[(p >= 0) & (p < CUTS)] for p in at]
                return np.concatenate([np.bincount(p, minlength=CUTS) for p in at])

            width = (high - low) / CUTS
            for j, n_in in enumerate(self.added(counts).reshape(2, CUTS)):
                mass = below[j] + np.cumsum(n_in)
                at = min(CUTS - 1, int(np.searchsorted(mass, wanted[j])))
                below[j] = mass[at] - n_in[at]
                low[j], high[j] = low[j] + at * width[j], low[j] + (at + 1) * width[j]
        return Ranking(self.mean, self.scale, w, float(low.mean()))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """Stored features of every labelled text outside the held-out part, packed by batches.

    Features are computed where the texts are, for those whose id's hash is that of a labelled id (a map of fixed size); the
    join by id that follows is exact, and moves features only.
    """
    kind = dict(docs.dtypes)[id_col]
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    known = labels.filter(bucket_of(id_col, MODULUS) != HELD_OUT).filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    marks = known.withColumn("slot", slot).groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(SLOTS // 64, dtype=np.int64)
    bits[marks.column("at").to_numpy()] = marks.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batch: pa.RecordBatch) -> dict:
        at = batch.column("slot").to_numpy()
        some = np.flatnonzero(shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
        x = features(encoded(batch.column("text").take(pa.array(some)).to_pylist()))
        places = [np.flatnonzero(r) for r in x]
        return {"id": batch.column("id").take(pa.array(some)), "at": [p.astype(np.uint16).tobytes() for p in places], "x": [r[p].tobytes() for r, p in zip(x, places)]}

    def pack(batch: pa.RecordBatch) -> dict:
        at, x = (batch.column(c).to_pylist() for c in ("at", "x"))
        return {"good": [(batch.column("label").to_numpy() == 1).tobytes()], "per": [np.array([len(a) // 2 for a in at], dtype=np.int32).tobytes()], "at": [b"".join(at)], "x": [b"".join(x)]}

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull()).withColumn("slot", slot)
    rows = arrow_map(texts, run, f"id {kind}, at binary, x binary").join(known, "id").select("label", "at", "x")
    return materialise(arrow_map(rows.sortWithinPartitions("label", "x", "at"), pack, "good binary, per binary, at binary, x binary"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Ranking | None:
    """Learn from all labelled rows outside the held-out part; None if there are not both labels."""
    prepare(docs.sparkSession)
    table = labelled(docs, labels, label_col, id_col, text_col)
    try:
        return Labelled(table).fit()
    finally:
        release(table)


def ranked(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        m, n = shared.value, batch.num_rows
        score = m.score(features(encoded(batch.column("text").to_pylist()))) if m else np.full(n, PRIOR)
        return {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    scored = arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(bucket_of("doc_id", MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
