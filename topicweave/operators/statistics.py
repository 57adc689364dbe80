"""Statistics over runs. runs: model, config_hash, seed, status, metrics map<string,double>, assignments array<int>."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import ari

#: Metrics of which more is better; of all others less is.
HIGHER = ("coherence_emb", "separation", "silhouette", "silhouette_noise", "npmi", "diversity", "coverage", "nmi", "ari", "purity", "stability_ari", "judge_clarity", "judge_consistency", "judge_distinctiveness", "judge_groundedness", "judge_overall")
CORE = ("coherence_emb", "npmi", "diversity", "silhouette", "separation", "nmi", "ari", "purity", "coverage", "n_topics_found", "runtime_sec")


def long_metrics(runs: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """model, config_hash, seed, metric, value of finished runs; a metric that no run has is simply absent."""
    rows = runs.filter("status = 'done'").select("model", "config_hash", "seed", F.explode("metrics").alias("metric", "value"))
    return rows.filter(F.col("metric").isin(*metrics)) if metrics else rows


def wide(long: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """model, seed and one column per metric."""
    return long.groupBy("model", "seed").pivot("metric", list(metrics)).agg(F.first("value"))


def summarise(long: DataFrame) -> DataFrame:
    """model, metric, n, mean, std: by configuration and shown by name; sample deviation, 0 for one run."""
    return long.groupBy("model", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def best_flags(summary: DataFrame) -> DataFrame:
    """The summary with is_best: the highest mean where more is better, else the lowest, within 1e-12."""
    every = W.partitionBy("metric")
    best = F.when(F.col("metric").isin(*HIGHER), F.max("mean").over(every)).otherwise(F.min("mean").over(every))
    return summary.withColumn("is_best", F.abs(F.col("mean") - best) < 1e-12)


def pretty(summary: DataFrame) -> DataFrame:
    """model, metric, shown: `mean ± std`, the best in bold."""
    body = F.format_string("%.4f ± %.4f", "mean", "std")
    return best_flags(summary).select("model", "metric", F.when(F.col("is_best"), F.concat(F.lit("**"), body, F.lit("**"))).otherwise(body).alias("shown"))


def paired_differences(long: DataFrame, proposed: str, metric: str) -> DataFrame:
    """baseline, seed, a, b, diff over the seeds that both have."""
    rows = long.filter(F.col("metric") == metric).select("model", "seed", "value").filter(F.col("value").isNotNull())
    a = rows.filter(F.col("model") == proposed).select("seed", F.col("value").alias("a"))
    b = rows.filter(F.col("model") != proposed).select(F.col("model").alias("baseline"), "seed", F.col("value").alias("b"))
    return b.join(a, "seed").select("baseline", "seed", "a", "b", (F.col("a") - F.col("b")).alias("diff"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """baseline, n_pairs, mean_diff, t_stat, cohen_d; with fewer than two pairs all but the count are null."""
    facts = pairs.groupBy("baseline").agg(F.count("*").alias("n_pairs"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd"))
    ok = F.col("n_pairs") >= 2
    return facts.select(
        "baseline", "n_pairs", F.when(ok, F.col("m")).alias("mean_diff"),
        F.when(ok & (F.col("sd") > 0), F.col("m") / (F.col("sd") / F.sqrt("n_pairs"))).alias("t_stat"),
        F.when(ok, F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(F.lit(0.0))).alias("cohen_d"),
    )


def holm(rows: DataFrame, p: str = "p", key: str = "baseline") -> DataFrame:
    """rows with holm_p: step-down adjusted p-values; null stays null. Comparisons are few, one window suffices."""
    known = rows.filter(F.col(p).isNotNull())
    order = W.orderBy(p, key)
    step = known.withColumn("place", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy()))
    raised = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("place") + 1) * F.col(p))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return step.withColumn("holm_p", raised).drop("place", "m").unionByName(rows.filter(F.col(p).isNull()).withColumn("holm_p", F.lit(None).cast("double")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: int) -> float:
    """Two-sided p of Student's t."""
    return regularised_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def wilcoxon_p_value(diffs: Sequence[float]) -> float:
    """Two-sided signed-rank p: exact for up to 50 differences without ties or zeros, else by the normal; 1 if all are 0."""
    d = [x for x in diffs if x != 0]
    if not d or all(abs(x) < 1e-8 for x in diffs):
        return 1.0
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    ranks, i, tied = [0.0] * len(d), 0, 0.0
    while i < len(d):
        j = i
        while j + 1 < len(d) and abs(d[order[j + 1]]) == abs(d[order[i]]):
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        tied += (j - i + 1) ** 3 - (j - i + 1)
        i = j + 1
    plus, n = sum(r for r, x in zip(ranks, d) if x > 0), len(d)
    least = min(plus, n * (n + 1) / 2 - plus)
    if tied == 0 and len(d) == len(diffs) and n <= 50:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(least) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48)
    return math.erfc(abs(least - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def paired_tests(long: DataFrame, proposed: str, baselines: Sequence[str], metric: str) -> DataFrame:
    """baseline, n_pairs, mean_diff, t_stat, t_p, wilcoxon_p, cohen_d, holm_p. A row per baseline and few seeds, so p-values are found on the driver."""
    spark = long.sparkSession
    pairs = paired_differences(long, proposed, metric)
    facts = {r["baseline"]: r for r in paired_summary(pairs).collect()}
    diffs = {r["baseline"]: r["d"] for r in pairs.groupBy("baseline").agg(F.collect_list("diff").alias("d")).collect()}
    rows = []
    for b in baselines:
        f = facts.get(b)
        if not f or f["n_pairs"] < 2:
            rows.append((b, f["n_pairs"] if f else 0, None, None, None, None, None))
            continue
        t = f["t_stat"] if f["t_stat"] is not None else (math.inf if f["mean_diff"] else math.nan)
        p = None if math.isnan(t) else t_p_value(t, f["n_pairs"] - 1)
        rows.append((b, f["n_pairs"], f["mean_diff"], t, p, wilcoxon_p_value(diffs[b]), f["cohen_d"]))
    return holm(spark.createDataFrame(rows, "baseline string, n_pairs long, mean_diff double, t_stat double, t_p double, wilcoxon_p double, cohen_d double"), "t_p")


def seed_pair_ari(assignments: DataFrame, key: str = "doc_idx", least: int = 10) -> DataFrame:
    """model, config_hash, seed_a, seed_b, n, ari over documents that both seeds assign. assignments: model, config_hash, seed, key, topic_id."""
    own = assignments.filter("topic_id >= 0")
    by = ["model", "config_hash"]
    a = own.select(*by, key, F.col("seed").alias("seed_a"), F.col("topic_id").alias("a"))
    b = own.select(*by, key, F.col("seed").alias("seed_b"), F.col("topic_id").alias("b"))
    table = a.join(b, [*by, key]).filter("seed_a < seed_b").groupBy(*by, "seed_a", "seed_b", "a", "b").agg(F.count("*").alias("n"))
    return ari(table, *by, "seed_a", "seed_b").filter(F.col("n") >= least)


def stability(assignments: DataFrame, key: str = "doc_idx") -> DataFrame:
    """model, n_seeds, n_pairs, stability_ari_mean, _std, _min by configuration, steadiest first; runs of unequal length are not compared."""
    by = ["model", "config_hash"]
    lengths = assignments.groupBy(*by, "seed").agg(F.count("*").alias("length"))
    seeds = lengths.groupBy(*by).agg(F.count("*").alias("n_seeds"))
    pairs = seed_pair_ari(assignments, key)
    sides = pairs.join(lengths.select(*by, F.col("seed").alias("seed_a"), F.col("length").alias("la")), [*by, "seed_a"]).join(lengths.select(*by, F.col("seed").alias("seed_b"), F.col("length").alias("lb")), [*by, "seed_b"]).filter("la = lb")
    out = sides.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("ari").alias("stability_ari_mean"), F.coalesce(F.stddev_samp("ari"), F.lit(0.0)).alias("stability_ari_std"), F.min("ari").alias("stability_ari_min"))
    return out.join(seeds, by).select("model", "n_seeds", "n_pairs", "stability_ari_mean", "stability_ari_std", "stability_ari_min").orderBy(F.col("stability_ari_mean").desc(), "model")


def common_seeds(long: DataFrame, a: str, b: str) -> DataFrame:
    seeds = lambda m: long.filter(F.col("model") == m).select("seed").distinct()
    return seeds(a).intersect(seeds(b))


def box_data(long: DataFrame) -> DataFrame:
    """model, metric, values in the order of seeds."""
    return long.groupBy("model", "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "value"))), lambda p: p["value"]).alias("values"))
