"""Matrix models over token counts: LDA and NMF."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions.lineage import checkpointed

from .clustering import added, settled
from .keywords import tfidf

TOP = 10
#: Batches of an LDA pass at most, and the change of the objective below which NMF stops.
PARTS = 8
SETTLED = 1e-5


def _argmax(dist: str) -> F.Column:
    return (F.array_position(dist, F.array_max(dist)) - 1).cast("int")


def with_unassigned(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """doc_idx, topic_id, topic_dist of all documents; those without tokens have -1 and zeros."""
    return docs.select("doc_idx").join(found, "doc_idx", "left").select("doc_idx", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"), F.coalesce("topic_dist", F.array_repeat(F.lit(0.0), k)).alias("topic_dist"))


def _checked(docs: DataFrame) -> tuple[DataFrame, int]:
    used = docs.filter(F.size("tokens") > 0).select("doc_idx", "tokens")
    n = used.count()
    if n < 2:
        raise ValueError("a matrix model needs two documents with tokens")
    return used, n


def fit_lda(docs: DataFrame, k: int, seed: int, most_words: int = 2000, passes: int = 20) -> tuple[DataFrame, DataFrame]:
    """Assignments (doc_idx, topic_id, topic_dist) and words (topic_id, token, weight, rank).

    A pass takes at most PARTS batches, each a job over the rows, so the number of jobs does not grow with the rows.
    """
    used, n = _checked(docs)
    data = settled(used, n=n)
    counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=most_words).fit(data)
    k, batch = max(2, min(k, len(counter.vocabulary) - 1)), max(128, math.ceil(n / PARTS))
    matrix = counter.transform(data).select("doc_idx", "features").cache()
    model = LDA(k=k, seed=seed, optimizer="online", maxIter=passes * math.ceil(n / batch), learningOffset=50.0, learningDecay=0.7, subsamplingRate=min(1.0, batch / n)).fit(matrix)
    found = model.transform(matrix).select("doc_idx", vector_to_array("topicDistribution").alias("topic_dist")).withColumn("topic_id", _argmax("topic_dist"))
    vocabulary = F.array(*map(F.lit, counter.vocabulary))
    topics = model.describeTopics(TOP).select(F.col("topic").alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"))
    words = topics.filter("t.termWeights > 0").select("topic_id", F.element_at(vocabulary, F.col("t.termIndices") + 1).alias("token"), F.col("t.termWeights").alias("weight"), (F.col("pos") + 1).alias("rank"))
    return with_unassigned(docs, found, k), words


class NMF:
    """Frobenius factors by multiplicative updates.

    H (topics by words, bounded by most_words) is sent to the rows; each row solves
    its own weights given H, and adds its part of WtV and WtW, which is all that
    is gathered. So no row state is kept between rounds and nothing grows with the rows.
    """

    def __init__(self, k: int, seed: int, most_words: int = 2000, rounds: int = 30, inner: int = 15):
        self.k, self.seed, self.most_words, self.rounds, self.inner = k, seed, most_words, rounds, inner

    def fit(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Assignments (doc_idx, topic_id, topic_dist) and words (topic_id, token, weight, rank)."""
        used, n = _checked(docs)
        used = checkpointed(used)
        spark = docs.sparkSession
        words = used.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(self.most_words)
        vocabulary = sorted(r["token"] for r in words.collect())
        place = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "token string, j int")
        kept = used.select("doc_idx", F.explode("tokens").alias("token")).join(F.broadcast(place), "token").groupBy("doc_idx").agg(F.collect_list("token").alias("tokens"))
        weights = tfidf(kept).join(F.broadcast(place), "token")
        cells = weights.groupBy("doc_idx").agg(F.array_sort(F.collect_list(F.struct("j", "weight"))).alias("cells"))
        rows = settled(cells.select("doc_idx", F.col("cells.j").alias("js"), F.col("cells.weight").alias("ws")), n=n).cache()
        k, v = min(self.k, len(vocabulary)), len(vocabulary)
        try:
            h, before = self._start(rows, k, v), math.inf
            for _ in range(self.rounds):
                wtv, wtw, square = self._sums(rows, h)
                for _ in range(self.inner):
                    h *= wtv / np.maximum(wtw @ h, 1e-12)
                now = square - 2 * float((wtv * h).sum()) + float((wtw * (h @ h.T)).sum())
                if before - now <= SETTLED * square:
                    break
                before = now
            found = checkpointed(rows.mapInArrow(self._weigh(h), "doc_idx long, topic_dist array<double>")).withColumn("topic_id", _argmax("topic_dist"))
        finally:
            rows.unpersist()
        best = [(t, vocabulary[j], float(h[t, j]), r + 1) for t in range(k) for r, j in enumerate(np.argsort(-h[t], kind="stable")[:TOP]) if h[t, j] > 0]
        return with_unassigned(docs, found, k), spark.createDataFrame(best, "topic_id int, token string, weight double, rank int")

    def _weights(self, batch: pa.RecordBatch, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows' weights given H, and their cells: row, word, value. Rows stay sparse."""
        row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("js").offsets.to_numpy()))
        js, ws = batch.column("js").flatten().to_numpy(), batch.column("ws").flatten().to_numpy()
        target = np.stack([np.bincount(row, weights=ws * one[js], minlength=batch.num_rows) for one in h], axis=1)
        gram = h @ h.T
        w = np.maximum(target, 1e-9) / np.maximum(np.diag(gram), 1e-12)
        for _ in range(2 * self.inner):
            w *= target / np.maximum(w @ gram, 1e-12)
        return w, row, js, ws

    def _weigh(self, h: np.ndarray):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    w = self._weights(batch, h)[0]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_idx"), pa.array(list(w), pa.list_(pa.float64()))], names=["doc_idx", "topic_dist"])

        return run

    def _gathered(self, rows: DataFrame, make, width: int) -> np.ndarray:
        """Sum over all rows of what `make` gives per batch: an array of `width` numbers."""

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                if batch.num_rows:
                    total += make(batch)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

        return added(rows.mapInArrow(run, "x binary"))

    def _sums(self, rows: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k, v = h.shape

        def make(batch):
            w, row, js, ws = self._weights(batch, h)
            wtv = [np.bincount(js, weights=ws * w[row, t], minlength=v) for t in range(k)]
            return np.concatenate([*wtv, (w.T @ w).reshape(-1), [ws @ ws]])

        out = self._gathered(rows, make, k * v + k * k + 1)
        return out[: k * v].reshape(k, v), out[k * v : -1].reshape(k, k), float(out[-1])

    def _start(self, rows: DataFrame, k: int, v: int, steps: int = 5) -> np.ndarray:
        """Leading right singular vectors by subspace iteration, the heavier signed part of each, zeros filled with the mean."""
        size = min(v, k + 8)
        basis = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(v, size)))[0]

        def product(now):
            def make(batch):
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("js").offsets.to_numpy()))
                js, ws = batch.column("js").flatten().to_numpy(), batch.column("ws").flatten().to_numpy()
                y = np.stack([np.bincount(row, weights=ws * one[js], minlength=batch.num_rows) for one in now.T], axis=1)
                return np.concatenate([np.bincount(js, weights=ws * y[row, t], minlength=v) for t in range(now.shape[1])])

            return self._gathered(rows, make, v * now.shape[1]).reshape(now.shape[1], v).T

        for _ in range(steps):
            image = product(basis)
            basis = np.linalg.qr(image)[0]
        image = product(basis)
        values, turns = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        top = (basis @ turns)[:, ::-1][:, :k].T
        top *= np.where(np.abs(top.min(axis=1)) > top.max(axis=1), -1, 1)[:, None]
        scale = np.sqrt(np.sqrt(np.maximum(values[::-1][:k], 1e-12)))
        h = np.maximum(top, 0) * scale[:, None]
        h[h <= 0] = max(float(h.mean()), 1e-6)
        return h
