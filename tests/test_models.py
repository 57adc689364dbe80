"""Clustering, models, statistics and experiments, by their properties."""

import hashlib
import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import clustering as C
from topicweave.operators import exports, keyphrases as K, statistics as S
from topicweave.plans import configs as cfg
from topicweave.plans import experiments as X
from topicweave.plans import models as P
from topicweave.sources import runs as R
from topicweave.sources import services as V

from test_metrics import blobs, vectors


def labels(df):
    return {r["doc_idx"]: r["topic_id"] for r in df.collect()}


def same_partition(a, b):
    return len({(a[i], b[i]) for i in a}) == len(set(a.values())) == len(set(b.values()))


def test_kmeans_is_partition_invariant(spark):
    rows = blobs(spark)
    truth = labels(rows)
    found = [labels(C.kmeans(rows.repartition(n), 3, 1, 3)) for n in (1, 5)]
    assert found[0] == found[1] and same_partition(found[0], truth)
    assert C.kmeans_best_k(rows, 2, 5, 1, restarts=2)[1] == 3


def test_hdbscan_finds_blobs_in_blocks(spark):
    rows = blobs(spark, n_per=25)
    truth = labels(rows)
    for block in (1000, 20):
        found = labels(C.hdbscan(rows.repartition(3), 8, block=block))
        inside = {i: t for i, t in found.items() if t >= 0}
        assert len(inside) > 60 and same_partition(inside, {i: truth[i] for i in inside})
    assert set(labels(C.hdbscan(rows, 60)).values()) == {-1}


def test_kmeans_numbers_and_ties(spark):
    """Clusters are numbered by their smallest key; equally cheap fits give one labelling for any partitions."""
    rows = vectors(spark, [(0, p) for p in [(0, 0), (0, 1), (1, 0), (1, 1)] for _ in range(5)])  # two equally good cuts
    found = [labels(C.kmeans(rows.repartition(n), 2, 3)) for n in (1, 5, 13)]
    assert found[0] == found[1] == found[2] and found[0][0] == 0
    truth = labels(blobs(spark, n_per=15, k=4))
    assert labels(C.kmeans(blobs(spark, n_per=15, k=4).repartition(7), 4, 1)) == truth
    assert labels(C.kmeans(rows, 1, 0)) == dict.fromkeys(range(20), 0) and len(set(labels(C.kmeans(rows.limit(3), 9, 0)).values())) <= 3


def test_density_blocks_equal_the_whole(spark):
    """Core distances and the tree's weight against all pairs at once; fewer edges than rows reach the driver."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5))
    x[10] = x[20]
    rows = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "k long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 6]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)
    want = C._prim(reach)[2].sum()
    for parts in (1, 7):
        cores = C.core_distances(rows.repartition(4), 7, parts)
        assert np.allclose([r["core"] for r in cores.orderBy("k").collect()], core)
        edges = C.reachability_tree(rows, cores, parts).toPandas()
        assert len(edges) == 89 and np.isclose(edges["w"].sum(), want)
    a, b = np.triu_indices(90, 1)
    f = C.spanning_forest(a, b, reach[a, b])
    assert len(f) == 89 and np.isclose(reach[a, b][f].sum(), want)


@pytest.mark.parametrize("dims, neighbours", [(5, 30), (12, 4), (2, 600)])
def test_density_measures_all_pairs_without_shuffling_them(spark, dims, neighbours):
    """Copies, ties and far rows among many leaves; tasks read all rows where they lie, so what is shuffled does not grow with rows times tasks."""
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(250, dims)), rng.normal(size=(200, dims)) * 0.1 + 4, np.repeat(rng.normal(size=(5, dims)), 30, axis=0), rng.integers(0, 2, (50, dims)), np.full((1, dims), 90.0)])
    rows = spark.createDataFrame([(7 * i, [float(v) for v in p]) for i, p in enumerate(x)], "k long, v array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, neighbours - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, 0)
    for parts in (1, 6):
        cores = C.core_distances(rows, neighbours, parts)
        plan = cores._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "CartesianProduct" in plan
        assert np.allclose([r["core"] for r in cores.orderBy("k").collect()], core, atol=1e-6)
        edges = C.reachability_tree(rows, cores, parts).toPandas()
        assert len(edges) == len(x) - 1 == len(C.spanning_forest(*(edges[c].to_numpy() for c in "abw")))
        assert np.allclose(np.sort(edges["w"]), np.sort(C._prim(reach)[2]), atol=1e-6)


def test_stored_tables_keep_no_shuffle(spark):
    from topicweave.functions.lineage import stored

    folder = lambda: sum(len(names) for top in (spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()) for _, _, names in os.walk(str(top)) for names in [[n for n in names if n.startswith("shuffle_")]])
    before = folder()
    out = stored(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(100):  # files go side by side with what follows
        if folder() <= before:
            break
        time.sleep(0.1)
    assert folder() <= before and out.count() == 10


def test_tokens_come_through_the_join(spark):
    rows = [(0, ["a b", "", "é"]), (1, []), (2, [""]), (3, ["x"])]
    docs = spark.createDataFrame(rows, "doc_idx long, tokens array<string>")
    got = P.with_tokens(docs, docs.select("doc_idx", F.lit(1).alias("topic_id"))).collect()
    assert sorted((r["doc_idx"], r["tokens"]) for r in got) == rows


def test_hashed_vectors_are_sums_over_all_trigrams():
    texts = ["", " ", "abc abc abc", "é日本\U0001f600 x", "the river of the river"]
    for text, got in zip(texts, V.HashEmbedder(16).embed(texts)):
        want, padded = np.zeros(16), f"  {text}  "
        for i in range(len(padded) - 2):
            digest = hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest()
            want[int.from_bytes(digest[:4], "little") % 16] += 1 if digest[4] & 1 else -1
        assert np.allclose(got, want / max(np.linalg.norm(want), 1e-9))


def test_fill_outliers(spark):
    rows = blobs(spark).withColumn("topic_id", F.when(F.col("doc_idx") % 7 == 0, -1).otherwise(F.col("topic_id")))
    before, after = labels(rows), {r["doc_idx"]: r for r in C.fill_outliers(rows).collect()}
    assert all(after[i]["topic_id"] == t and not after[i]["was_outlier"] for i, t in before.items() if t >= 0)
    assert {r["topic_id"] for r in after.values()} == {0, 1, 2} and len(after) == 60


def test_refine(spark):
    rows = blobs(spark).withColumn("topic_id", F.when(F.col("doc_idx") == 0, 2).otherwise(F.col("topic_id")))
    anchors = P.centroids(rows, "topic_id").withColumnRenamed("centroid", "anchor")
    found, moved = C.refine(rows, anchors, 1.0)
    assert labels(found)[0] == 0 and moved[0] == 1 and moved[-1] == 0


def test_merging(spark):
    assert C.merged_ids([(1, 3), (3, 5)], [1, 2, 3, 5]) == {1: 0, 2: 1, 3: 0, 5: 0}
    assert set(labels(C.merge_similar(blobs(spark), -1.0)[0]).values()) == {0}


def test_representatives(spark):
    rows = blobs(spark, n_per=100)
    found = [sorted(r["doc_idx"] for r in C.representatives(rows, 60).collect()) for _ in range(2)]
    assert found[0] == found[1] and len(set(found[0])) == 60 and {i // 100 for i in found[0]} == {0, 1, 2}
    assert C.representatives(rows, 0).count() == 300 == C.representatives(rows, 500).count()


@pytest.fixture(scope="module")
def corpus(spark):
    a, b = "river water bridge flood rain", "market price trade bank share"
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice((a if i < 20 else b).split(), 9)), "w" if i < 20 else "m", f"s{i % 2}") for i in range(40)]
    return P.checkpointed(X.prepare(spark.createDataFrame(rows, "doc_idx long, text string, label string, source_id string"), V.HashEmbedder))


@pytest.mark.parametrize("config", [
    cfg.LdaConfig(n_topics=2, passes=10), cfg.NmfConfig(n_topics=2, rounds=10), cfg.DensityConfig(least_cluster=5, reduce_to=3, assign_outliers=True),
    cfg.KeyphraseConfig(n_topics=2), cfg.AnchorConfig(n_topics=2), cfg.AnchorConfig(least_cluster=5, alpha=1.0, core_fraction=0.5),
])
def test_models_keep_the_contract(corpus, config):
    a = P.fit(config, corpus, 3)
    found = labels(a.assignments)
    assert sorted(found) == list(range(40)) and all(isinstance(t, int) for t in found.values())
    topics = {r["topic_id"]: r for r in a.topics.collect()}
    assert topics and {t for t in found.values() if t >= 0} <= set(topics)
    assert all(t["label"] and t["keywords"] for t in topics.values())
    assert all(labels(P.fit(config, corpus.repartition(n), 3).assignments) == found for n in (1, 5))


def test_documents_without_tokens_stay_out(spark):
    docs = spark.createDataFrame([(0, ["aa", "bb"]), (1, []), (2, ["cc", "aa"]), (3, ["bb", "cc"])], "doc_idx long, tokens array<string>")
    found, _ = P.M.NMF(2, 0, rounds=3).fit(docs)
    assert {r["doc_idx"]: r["topic_id"] for r in found.collect()}[1] == -1
    with pytest.raises(ValueError):
        P.M.fit_lda(docs.filter("doc_idx = 1"), 2, 0)


def test_configs():
    c = cfg.AnchorConfig()
    assert c.hash() == cfg.AnchorConfig().hash() != cfg.AnchorConfig(alpha=0.3).hash()
    assert cfg.restored({"name": "lda", "n_topics": 7, "unknown": 1}) == cfg.LdaConfig(n_topics=7)
    out = cfg.common_conditions([cfg.preset("keyphrase"), cfg.preset("density"), cfg.preset("lda")], n_topics=20, least_cluster=9, most_asked=500)
    assert (out[0].n_topics, out[0].most_topics, out[1].least_cluster, out[2].n_topics) == (20, 20, 9, 20)
    assert "asked" not in out[0].label and "size" in out[1].label and len(cfg.PRESETS) == 10
    assert cfg.common_conditions([c]) == [c]


def test_breaker_and_failures(spark):
    class Failing:
        def ping(self):
            return "up"

        def chat(self, *_, **__):
            raise OSError("down")

    docs = spark.createDataFrame([(i, "some text here") for i in range(20)], "doc_idx long, text string").coalesce(1)
    with pytest.raises(Exception, match="in a row"):
        K.extract(docs, Failing, "m").collect()
    assert [r["keyphrases"] for r in K.extract(docs.limit(3), Failing, "m").collect()] == [[], [], []]


def test_embedding_cache(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c d")], "doc_idx long, text string")
    out, new = V.embed(rows, V.HashEmbedder, "hash64")
    assert new.count() == 2 and out.filter("embedding is null").count() == 0
    _, again = V.embed(rows, V.HashEmbedder, "hash64", new)
    assert again.count() == 0
    cache = V.KeyValueCache(spark, f"file://{tmp_path}/kv")
    client = V.CachedClient(V.EchoClient(), cache)
    assert client.chat("m", "one two three") == client.chat("m", "one two three") and (client.hits, client.misses) == (1, 1)


def test_answers_are_asked_for_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    class Counting(V.EchoClient):
        def chat(self, model, prompt, **options):
            import uuid

            (log / uuid.uuid4().hex).touch()
            if "broken" in prompt:
                raise OSError("down")
            return "[1]" if prompt.startswith("Which") else super().chat(model, prompt, **options)

    cache = V.KeyValueCache(spark, f"file://{tmp_path}/kv")
    docs = spark.createDataFrame([(0, "one two three four"), (1, "one two three four"), (2, "five six"), (3, "broken"), (4, None)], "doc_idx long, text string")
    first = sorted(K.extract(docs, Counting, "m", cache=cache).collect())
    assert [list(r["keyphrases"]) for r in first] == [["one two", "three four"], ["one two", "three four"], ["five six"], [], first[4]["keyphrases"]]
    asked = len(list(log.iterdir()))
    assert asked == 4 and sorted(K.extract(docs, Counting, "m", cache=cache).collect()) == first and len(list(log.iterdir())) == asked + 1  # what failed is asked again
    found = spark.createDataFrame([(0, "t", ["a", "b"]), (1, "broken", ["c"])], "doc_idx long, text string, keyphrases array<string>")
    assert sorted(map(tuple, K.keep_by_model(found, Counting, "m", cache).collect())) == [(0, ["b"]), (1, ["c"])]
    assert sorted(map(tuple, K.keep_by_model(found, V.EchoClient, "m").collect())) == [(0, ["a", "b"]), (1, ["c"])]


def runs(spark, table):
    return spark.createDataFrame([(m, s, "npmi", float(v)) for m, vs in table.items() for s, v in enumerate(vs)], "model string, seed long, metric string, value double")


def test_statistics(spark):
    long = runs(spark, {"a": [0.80, 0.85, 0.83, 0.88, 0.82], "b": [0.75, 0.78, 0.80, 0.79, 0.77]})
    r = S.paired_tests(long, "a", ["b", "c"], "npmi").orderBy("baseline").collect()
    diffs = np.array([0.05, 0.07, 0.03, 0.09, 0.05])
    t = diffs.mean() / (diffs.std(ddof=1) / np.sqrt(5))
    x = np.linspace(t, 4000, 4_000_001)
    density = 0.375 * (1 + x * x / 4) ** -2.5  # Student's t with four degrees of freedom
    tail = 2 * float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())
    assert r[0]["n_pairs"] == 5 and r[0]["t_stat"] == pytest.approx(t) and r[0]["t_p"] == pytest.approx(tail, abs=1e-5)
    assert r[0]["wilcoxon_p"] == pytest.approx(0.0625, abs=0.02) and r[0]["holm_p"] == r[0]["t_p"] and r[0]["cohen_d"] == pytest.approx(diffs.mean() / diffs.std(ddof=1))
    assert S.wilcoxon_p_value([0.1, 0.2, 0.3, 0.4, 0.5]) == 0.0625 and S.wilcoxon_p_value([1, -2, 3, 4, 5]) == pytest.approx(2 * 3 / 32)
    assert r[1]["n_pairs"] == 0 and r[1]["holm_p"] is None
    s = S.summarise(runs(spark, {"a": [0.7, 0.8, 0.9]})).first()
    assert s["mean"] == pytest.approx(0.8) and s["std"] == pytest.approx(0.1)
    assert S.t_p_value(2.0, 10) == pytest.approx(0.07339, abs=1e-4) and S.wilcoxon_p_value([0, 0]) == 1.0
    text = exports.markdown(long, ["npmi"]) + exports.latex(long, ["npmi"]) + exports.csv_text(long, ["npmi"])
    assert "**0.8360" in text and "\\textbf{0.836" in text and "npmi_mean" in text


def test_stability(spark):
    base = [i % 3 for i in range(30)]
    rows = [("m", "h", s, i, (t + s * 4) % 3 if s < 2 else t) for s in range(3) for i, t in enumerate(base)]
    r = S.stability(spark.createDataFrame(rows, "model string, config_hash string, seed long, doc_idx long, topic_id int")).first()
    assert (r["n_seeds"], r["n_pairs"], r["stability_ari_mean"]) == (3, 3, 1.0)


def test_recommendation_rules():
    assert X.pick_topics({2: 0.5, 5: 0.46, 8: 0.44}) == 5 and X.pick_topics({}) == 10
    assert X.pick_topics({2: -0.2, 5: -0.1, 8: -0.3}) == 5 and X.pick_topics({3: 0.1, 9: -0.5}) == 3
    assert X.tried_topics(100, 3) == [2, 3, 4, 5, 6] and X.tried_topics(5, 1) == [4] and X.tried_topics(100) == list(X.TRIED)


def test_phrase_keywords_and_themes(spark, corpus):
    items = spark.createDataFrame([(0, 0, "river bank", 0), (0, 1, "flood", 0), (1, 0, "flood", 0), (2, 0, "market", 1), (3, 0, None, 1), (4, 0, "noise", -1)], "doc_idx long, pos int, kp string, topic_id int")
    assert [(r["topic_id"], r["token"], r["rank"]) for r in K_words(items).collect()] == [(0, "flood", 1), (0, "river bank", 2), (1, "market", 1)]
    fitted = P.fit(cfg.KeyphraseConfig(n_topics=2), corpus, 3)
    assert any(" " in k for r in fitted.topics.collect() for k in r["keywords"])  # whole phrases

    class Themes(V.EchoClient):
        def chat(self, model, prompt, **options):
            return 'Theme: "Water"' if prompt.startswith("Name the theme") else super().chat(model, prompt, **options)

    assert {r["label"] for r in P.fit(cfg.AnchorConfig(n_topics=2), corpus, 3, P.Services(client=Themes)).topics.collect()} == {"Water"}


def K_words(items):
    return P.Q.frequent_phrases(items).orderBy("topic_id", "rank")


def test_members_and_detail(spark):
    rows = spark.createDataFrame([(i, f"d{i}", "x" * (300 - i), i % 2) for i in range(6)], "doc_idx long, doc_id string, text string, topic_id int")
    assert [(r["doc_id"], len(r["text"])) for r in P.Q.members(rows, 1).collect()] == [("d1", 200), ("d3", 200), ("d5", 200)]
    assert sorted(tuple(r) for r in P.Q.detail(rows).collect()) == [(0, 3, 0), (1, 3, 1)]


def test_presets_are_checked_at_once():
    assert cfg.unknown_presets(["lda", "x", "nmf", "y"]) == ["x", "y"] and [c.name for c in cfg.presets(["lda", "anchor"])] == ["lda", "anchor"]
    with pytest.raises(KeyError, match="'x', 'y'"):
        cfg.presets(["x", "lda", "y"])


def test_recommend(spark):
    assert 4 <= X.recommend_topics(blobs(spark, n_per=40, k=5, dim=16, seed=0))[0] <= 6
    papers = blobs(spark, n_per=40, k=5, dim=16, seed=0).withColumn("source_id", F.concat(F.lit("s"), F.col("doc_idx") % 2))
    assert X.recommend_topics(papers, "papers")[0] <= 4
    assert (X.recommend_least_cluster(60_000, 20), X.recommend_asked(100, 20)) == (150, 100)


def test_experiment_resumes(spark, corpus, tmp_path):
    store = R.RunStore(spark, f"file://{tmp_path}/runs")
    configs = [cfg.AnchorConfig(n_topics=2), cfg.LdaConfig(n_topics=2, passes=-1)]
    first = list(X.run_experiment(configs, [1], corpus, store, "e", label="label"))
    assert [r["status"] for r in first] == ["done", "failed"] and first[1]["error"]
    assert set(first[0]["metrics"]) >= {"coherence_emb", "npmi", "diversity", "coverage", "nmi", "runtime_sec"} and len(first[0]["assignments"]) == 40
    again = list(X.run_experiment(configs, [1], corpus, store, "e"))
    assert [r["model_name"] for r in again] == ["lda"]
    stored = store.load("e")
    assert stored.count() == 2 and R.experiments(stored).first()["n_runs"] == 2
    assert S.long_metrics(R.for_statistics(stored)).filter("metric = 'npmi'").count() == 1


def test_workspaces(spark, tmp_path):
    w = R.Workspaces(spark, f"file://{tmp_path}/w")
    assert w.list().count() == 0
    key = w.save("my / run", {"assignments": np.array([0, 1, -1]), "artifacts": {"big": list(range(30_000)), "small": [1]}})
    assert w.load(key)["assignments"] == [0, 1, -1] and set(w.load(key)["artifacts"]) == {"small"}
    assert w.list().count() == 1 and w.delete(key) and w.list().count() == 0
    assert json.dumps({"a": {1}}, default=R.plain) == '{"a": [1]}'


def test_judge(spark, corpus):
    class Judge(V.EchoClient):
        def chat(self, *_, **__):
            return 'Marks: {"clarity": 4, "consistency": 9, "distinctiveness": 2}'

    rows = corpus.withColumn("topic_id", (F.col("doc_idx") % 2).cast("int"))
    topics = spark.createDataFrame([(0, "a", ["x"]), (1, "b", ["y"])], "topic_id int, label string, keywords array<string>")
    assert X.judge(rows, topics, P.Services(client=Judge), "m") == {"judge_clarity": 4.0, "judge_distinctiveness": 2.0, "judge_overall": 3.0}


def test_streamed_documents_get_frozen_topics(spark, tmp_path):
    from topicweave.streaming import assign

    rows = blobs(spark)
    rows.write.parquet(f"{tmp_path}/in")
    centres = [(r["topic_id"], r["centroid"]) for r in P.centroids(rows, "topic_id").collect()]
    stream = assign.assign(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").withColumnRenamed("topic_id", "truth"), centres)
    q = stream.writeStream.format("memory").queryName("assigned").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from assigned")
    assert got.count() == 60 and got.filter("truth <> topic_id").count() == 0


def test_vectors_helper(spark):
    assert vectors(spark, [(0, [1, 0])]).count() == 1
