"""Topic metrics. Inputs: docs(doc_idx, topic_id, ...); -1 marks an unassigned document."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.functions.lineage import checkpointed
from topicweave.functions.vectors import centroids, cosine

BLOCK = 2048


def topic_coherence(rows: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """topic_id, n, coherence: mean cosine of members to their raw mean; 1 for a topic of one."""
    members = rows.filter(F.col(topic) >= 0)
    joined = members.join(centroids(members, topic, vector), topic)
    return joined.groupBy(topic).agg(F.count("*").alias("n"), F.avg(cosine(F.col(vector), F.col("centroid"))).alias("mean")).select(topic, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.col("mean")).alias("coherence"))


def coherence_macro(rows: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    return topic_coherence(rows, topic, vector).agg(F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("coherence_emb"))


def centroid_pairs(rows: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    """topic_a, topic_b, cosine of the means of each pair of topics, a < b; topics are few."""
    c = centroids(rows.filter(F.col(topic) >= 0), topic, vector)
    a, b = c.select(F.col(topic).alias("topic_a"), F.col("centroid").alias("ca")), c.select(F.col(topic).alias("topic_b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("topic_a") < F.col("topic_b")).select("topic_a", "topic_b", cosine(F.col("ca"), F.col("cb")).alias("cosine"))


def separation(rows: DataFrame, topic: str = "topic_id", vector: str = "embedding") -> DataFrame:
    return centroid_pairs(rows, topic, vector).agg(F.coalesce(F.avg(1 - F.col("cosine")), F.lit(0.0)).alias("separation"))


def silhouette_samples(rows: DataFrame, label: str, vector: str = "embedding", key: str = "doc_idx", block: int = BLOCK) -> DataFrame:
    """doc key, label, silhouette (Euclidean) of every row, exactly.

    Rows are dealt into blocks of about `block` rows; a task measures one block
    against another and adds up distances by label, so no task holds more than
    two blocks and only sums are shuffled. A row alone in its label has 0.
    """
    n = rows.count()
    parts = max(1, math.ceil(n / block))
    # Sums are as wide as there are labels, which are few; distances never leave the task.
    base = rows.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn("mine", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    left = base.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("mine", "other", "k", "label", "v", F.lit(0).alias("side"))
    right = base.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(F.col("with").alias("mine"), F.col("mine").alias("other"), "k", "label", "v", F.lit(1).alias("side"))

    def sums(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1)
        k, lab = t.column("k").to_numpy(), t.column("label").to_numpy()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return pa.table({"k": pa.array([], pa.int64()), "label": pa.array([], pa.int32()), "to": pa.array([], pa.int32()), "total": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        x, y = v[a], v[b]
        names, where = np.unique(lab[b], return_inverse=True)
        hot = np.zeros((len(b), len(names)))
        hot[np.arange(len(b)), where] = 1
        total = np.empty((len(a), len(names)))
        yy = (y * y).sum(axis=1)
        for i in range(0, len(a), 256):
            part = x[i : i + 256]
            d = np.maximum((part * part).sum(axis=1)[:, None] + yy[None] - 2 * part @ y.T, 0)
            d[k[a][i : i + 256, None] == k[b][None]] = 0.0
            total[i : i + 256] = np.sqrt(d) @ hot
        m = len(names)
        return pa.table({"k": np.repeat(k[a], m), "label": np.repeat(lab[a], m), "to": np.tile(names, len(a)), "total": total.reshape(-1), "n": np.tile(hot.sum(axis=0).astype(np.int64), len(a))})

    kind = dict(base.dtypes)["k"]
    far = left.unionAll(right).groupBy("mine", "other").applyInArrow(sums, f"k {kind}, label int, to int, total double, n long").groupBy("k", "label", "to").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own, others = F.col("to") == F.col("label"), F.col("to") != F.col("label")
    per = far.groupBy("k", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(others, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).when(F.greatest("a", "b") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select(F.col("k").alias(key), "label", value.alias("silhouette"))


def silhouette(rows: DataFrame, topic: str = "topic_id", vector: str = "embedding", key: str = "doc_idx", noise: bool = False) -> DataFrame:
    """Mean silhouette; without noise -1 is left out. 0 with under three rows, under two labels, or as many labels as rows."""
    used = rows if noise else rows.filter(F.col(topic) >= 0)
    name = "silhouette_noise" if noise else "silhouette"
    facts = used.agg(F.count("*").alias("n"), F.countDistinct(topic).alias("k"))
    mean = silhouette_samples(used, topic, vector, key).agg(F.avg("silhouette").alias("s"))
    bad = (F.col("n") < 3) | (F.col("k") < 2) | (F.col("k") >= F.col("n"))
    return facts.join(mean, how="cross").select(F.when(bad, F.lit(0.0)).otherwise(F.coalesce("s", F.lit(0.0))).alias(name))


# --- words ---------------------------------------------------------------------


def npmi_pairs(topics: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """topic_id, w1, w2, npmi of the keyword pairs that occur together often enough.

    topics: topic_id, keywords (normalised); docs: doc_idx, tokens. Frequencies
    are by document, over all documents, those without tokens included. One pass
    over the documents: their keywords meet by document, not topic by topic.
    """
    words = topics.select("topic_id", F.posexplode(F.slice(F.array_distinct("keywords"), 1, most)).alias("place", "w"))
    vocabulary = words.select("w").distinct()
    # Written once: texts are read and cut into tokens for all three uses below.
    seen = docs.select("doc_idx", F.explode(F.array_distinct("tokens")).alias("w")).join(vocabulary, "w")
    seen = checkpointed(seen)
    single = seen.groupBy("w").agg(F.count("*").alias("c"))
    a, b = words.select("topic_id", F.col("w").alias("x"), F.col("place").alias("px")), words.select("topic_id", F.col("w").alias("y"), F.col("place").alias("py"))
    pairs = a.join(b, "topic_id").filter("px < py").select("topic_id", F.least("x", "y").alias("w1"), F.greatest("x", "y").alias("w2"))
    wanted = pairs.select("w1", "w2").distinct()
    both = seen.select("doc_idx", F.col("w").alias("w1")).join(seen.select("doc_idx", F.col("w").alias("w2")), "doc_idx").filter("w1 < w2").join(wanted, ["w1", "w2"]).groupBy("w1", "w2").agg(F.count("*").alias("c12"))
    total = docs.agg(F.count("*").cast("double").alias("n"))
    joined = pairs.join(both, ["w1", "w2"]).join(single.select(F.col("w").alias("w1"), F.col("c").alias("c1")), "w1").join(single.select(F.col("w").alias("w2"), F.col("c").alias("c2")), "w2").join(total, how="cross")
    p12 = F.col("c12") / F.col("n")
    value = F.ln(p12 / ((F.col("c1") / F.col("n")) * (F.col("c2") / F.col("n")))) / -F.ln(p12)
    return joined.filter((F.col("c12") >= 2) & (F.col("c1") >= 2) & (F.col("c2") >= 2) & (F.col("c12") < F.col("n"))).select("topic_id", "w1", "w2", value.alias("npmi"))


def npmi_by_topic(topics: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    """topic_id, npmi: mean over its pairs, 0 without one; topics without keywords are left out."""
    means = npmi_pairs(topics, docs, most).groupBy("topic_id").agg(F.avg("npmi").alias("m"))
    return topics.filter(F.size("keywords") > 0).select("topic_id").join(means, "topic_id", "left").select("topic_id", F.coalesce("m", F.lit(0.0)).alias("npmi"))


def npmi(topics: DataFrame, docs: DataFrame, most: int = 10) -> DataFrame:
    return npmi_by_topic(topics, docs, most).agg(F.coalesce(F.avg("npmi"), F.lit(0.0)).alias("npmi"))


def diversity(topics: DataFrame, most: int = 10) -> DataFrame:
    """Distinct words among all topics' first `most`, over topics times `most`."""
    words = topics.select(F.explode(F.slice("keywords", 1, most)).alias("w")).agg(F.countDistinct("w").alias("d"))
    return words.join(topics.agg(F.count("*").alias("k")), how="cross").select(F.when(F.col("k") > 0, F.col("d") / (F.col("k") * most)).otherwise(F.lit(0.0)).alias("diversity"))


# --- coverage and labels ---------------------------------------------------------


def coverage(rows: DataFrame, topic: str = "topic_id") -> DataFrame:
    """coverage, n_topics_found, topic_size_std (population), topic_size_min, topic_size_max."""
    sizes = rows.groupBy(topic).agg(F.count("*").alias("n"))
    own = F.col(topic) >= 0
    size = F.when(own, F.col("n"))
    return sizes.agg(
        F.coalesce(F.sum(size) / F.sum("n"), F.lit(0.0)).cast("double").alias("coverage"), F.count(size).alias("n_topics_found"),
        F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("topic_size_std"), F.coalesce(F.min(size), F.lit(0)).alias("topic_size_min"), F.coalesce(F.max(size), F.lit(0)).alias("topic_size_max"),
    )


def contingency(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Counts of each pair of labels that both are there, by group; -1 counts as absent in a."""
    used = rows.filter((F.col(a) >= 0) & F.col(b).isNotNull())
    return used.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _margins(table: DataFrame, *by: str) -> DataFrame:
    total = table.groupBy(*by).agg(F.sum("n").alias("total"))
    rows, cols = table.groupBy(*by, "a").agg(F.sum("n").alias("na")), table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    keyed = table.join(rows, [*by, "a"]).join(cols, [*by, "b"])
    return keyed.join(total, [*by]) if by else keyed.join(total, how="cross")


def nmi(table: DataFrame) -> DataFrame:
    """Normalised mutual information, arithmetic mean of the entropies; 0 when both are 0."""
    m = _margins(table)
    mutual = F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))))
    # Entropies from the joint table: each marginal probability enters once per cell, weighted by the cell's share of it.
    ha, hb = F.sum(-F.col("n") / F.col("total") * F.ln(F.col("na") / F.col("total"))), F.sum(-F.col("n") / F.col("total") * F.ln(F.col("nb") / F.col("total")))
    return m.agg(mutual.alias("mi"), ha.alias("ha"), hb.alias("hb")).select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.greatest("mi", F.lit(0.0)) / (F.col("ha") + F.col("hb"))).otherwise(F.lit(0.0)).alias("nmi"))


def ari(table: DataFrame, *by: str) -> DataFrame:
    """Adjusted Rand index, by group; 1 where there is nothing to tell apart."""
    pairs = lambda c: c * (c - 1) / 2
    cells = table.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("total"))
    rows = table.groupBy(*by, "a").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("in_a"))
    cols = table.groupBy(*by, "b").agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("in_b"))
    joined = cells.join(rows, [*by]).join(cols, [*by]) if by else cells.join(rows, how="cross").join(cols, how="cross")
    expected = F.col("in_a") * F.col("in_b") / pairs(F.col("total"))
    most = (F.col("in_a") + F.col("in_b")) / 2
    value: Column = F.when((F.col("total") < 2) | (most == expected), F.lit(1.0)).otherwise((F.col("same") - expected) / (most - expected))
    return joined.select(*by, F.col("total").alias("n"), value.alias("ari"))


def purity(table: DataFrame) -> DataFrame:
    return table.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n")).agg((F.sum("best") / F.sum("n")).cast("double").alias("purity"))


def external(rows: DataFrame, topic: str = "topic_id", label: str = "label") -> DataFrame:
    """nmi, ari, purity, label_coverage, n_label_classes; no row unless enough rows carry a label and a topic."""
    table = contingency(rows, topic, label)
    facts = rows.agg(F.count("*").alias("docs"), F.count(label).alias("labelled"))
    used = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("a").alias("topics"), F.countDistinct("b").alias("n_label_classes"))
    gate = (F.col("labelled") >= F.greatest(F.lit(10), F.floor(F.col("docs") * 0.5))) & (F.col("n") >= 10) & (F.col("topics") >= 2) & (F.col("n_label_classes") >= 2)
    every = facts.join(used, how="cross").filter(gate).join(nmi(table), how="cross").join(ari(table).select("ari"), how="cross").join(purity(table), how="cross")
    return every.select("nmi", "ari", "purity", (F.col("n") / F.col("docs")).alias("label_coverage"), "n_label_classes")


def suite(rows: DataFrame, topics: DataFrame, label: str | None = None) -> DataFrame:
    """One wide row of all metrics. rows: doc_idx, topic_id, embedding, tokens; topics: topic_id, keywords."""
    docs = rows.select("doc_idx", "tokens")
    parts = [coherence_macro(rows), separation(rows), silhouette(rows), silhouette(rows, noise=True), npmi(topics, docs), diversity(topics), coverage(rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # one row each
    return out.join(external(rows, label=label), how="left") if label else out


def per_topic(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_id, label, size, coherence, keywords, largest first."""
    c = topic_coherence(rows).select("topic_id", F.col("n").alias("size"), "coherence")
    return topics.join(c, "topic_id").orderBy(F.col("size").desc(), "topic_id")
