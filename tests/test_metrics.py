"""Metric operators on small literals, and partition invariance."""

import numpy as np
import pytest

from topicweave.operators import metrics as E


def vectors(spark, rows):
    return spark.createDataFrame([(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(rows)], "doc_idx long, topic_id int, embedding array<double>")


def blobs(spark, n_per=20, k=3, dim=8, seed=0, shuffle=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(c, centres[c] + rng.normal(scale=0.05, size=dim)) for c in range(k) for _ in range(n_per)]
    labels = rng.permutation([c for c, _ in rows]) if shuffle else [c for c, _ in rows]
    return vectors(spark, [(int(t), v) for t, (_, v) in zip(labels, rows)])


def value(df):
    return df.first()[0]


def test_coherence_and_separation(spark):
    assert value(E.coherence_macro(vectors(spark, [(0, [1, 0])]))) == 1.0
    assert value(E.separation(vectors(spark, [(0, [1, 0]), (1, [0, 1])]))) == pytest.approx(1.0)
    assert value(E.separation(vectors(spark, [(0, [1, 0])]))) == 0.0
    assert value(E.coherence_macro(blobs(spark))) > value(E.coherence_macro(blobs(spark, shuffle=True)))


def test_silhouette_equals_brute_force(spark):
    rows = blobs(spark, shuffle=True)
    data = rows.collect()
    x, lab = np.array([r["embedding"] for r in data]), np.array([r["topic_id"] for r in data])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(len(x)):
        same = lab == lab[i]
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert value(E.silhouette(rows)) == pytest.approx(np.mean(s))
    blocked = E.silhouette_samples(rows.repartition(7), "topic_id", block=16).agg({"silhouette": "avg"}).first()[0]
    assert blocked == pytest.approx(np.mean(s))
    assert value(E.silhouette(blobs(spark))) > 0.7
    assert value(E.silhouette(vectors(spark, [(0, [1, 0]), (0, [0, 1]), (0, [1, 1])]))) == 0.0


def topics(spark, *keywords):
    return spark.createDataFrame(list(enumerate(keywords)), "topic_id int, keywords array<string>")


def test_words(spark):
    assert value(E.diversity(topics(spark, ["a", "b"], ["c", "d"]), 2)) == 1.0
    assert value(E.diversity(topics(spark, ["a", "b"], ["a", "b"]), 2)) == 0.5
    docs = spark.createDataFrame([(i, ["x", "y"] if i < 10 else []) for i in range(20)], "doc_idx long, tokens array<string>")
    assert value(E.npmi(topics(spark, ["x", "y"]), docs)) > 0.9
    apart = spark.createDataFrame([(i, ["x"] if i % 2 else ["y"]) for i in range(20)], "doc_idx long, tokens array<string>")
    assert value(E.npmi(topics(spark, ["x", "y"]), apart)) == 0.0
    assert value(E.npmi(topics(spark, ["x"], []), docs)) == 0.0


def test_coverage(spark):
    r = E.coverage(vectors(spark, [(t, [1]) for t in (0, 0, 1, 1, -1, -1, -1, -1)])).first()
    assert (r["coverage"], r["n_topics_found"], r["topic_size_std"], r["topic_size_min"]) == (0.5, 2, 0.0, 2)


def labelled(spark, pairs):
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(pairs)], "doc_idx long, topic_id int, label string")


def test_external(spark):
    perfect = E.external(labelled(spark, [(i % 2, "ab"[i % 2]) for i in range(20)])).first()
    assert (perfect["nmi"], perfect["ari"], perfect["purity"], perfect["label_coverage"], perfect["n_label_classes"]) == (pytest.approx(1), 1.0, 1.0, 1.0, 2)
    assert E.external(labelled(spark, [(i % 2, "ab"[i % 2] if i < 5 else None) for i in range(20)])).count() == 0
    assert E.external(labelled(spark, [(0 if i % 2 else -1, "ab"[i % 2]) for i in range(30)])).count() == 0
