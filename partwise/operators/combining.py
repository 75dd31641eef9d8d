"""Comparing and merging signatures of many models and cohorts.

Signatures are rows ``(cohort, model_id, rank, signature_id, feature, weight)``,
clusters ``(cluster_id, signature_id)``.  Sums over features run in Spark; only
a cosine graph over clusters, small by nature, is solved on the driver.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.kernels import nmf, small
from partwise.operators.analysis import cosines
from partwise.session import cut

#: Clusters up to which the graph of similar ones is solved on the driver.
MOST_CLUSTERS = 5_000


def support(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Per cluster: signatures, models and cohorts it draws on."""
    ids = signatures.select("signature_id", "model_id", "cohort").distinct()
    return members.join(ids, "signature_id").groupBy("cluster_id").agg(
        F.count_distinct("signature_id").alias("n_signatures"), F.count_distinct("model_id").alias("n_models"), F.count_distinct("cohort").alias("n_cohorts")
    )


def cohort_specific(members: DataFrame, signatures: DataFrame, proportion: float = 0.95) -> DataFrame:
    """Per cluster, cohort and rank: share of the cohort's models of that rank that hold the cluster, and whether it reaches ``proportion``."""
    ids = signatures.select("signature_id", "model_id", "cohort", "rank").distinct()
    models = ids.groupBy("cohort", "rank").agg(F.count_distinct("model_id").alias("of"))
    held = members.join(ids, "signature_id").groupBy("cluster_id", "cohort", "rank").agg(F.count_distinct("model_id").alias("n"))
    rows = held.join(models, ["cohort", "rank"])
    return rows.select("cluster_id", "cohort", "rank", (F.col("n") / F.col("of")).alias("share")).withColumn("specific", F.col("share") >= proportion)


def means(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(cluster_id, feature, weight)``: mean over a cluster's signatures, absent features as 0."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    sums = members.join(signatures, "signature_id").groupBy("cluster_id", "feature").agg(F.sum("weight").alias("s"))
    return sums.join(sizes, "cluster_id").select("cluster_id", "feature", (F.col("s") / F.col("n")).alias("weight"))


def top_features(members: DataFrame, signatures: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` heaviest features of each cluster by mean weight."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "feature")
    return means(members, signatures).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def merge_similar(members: DataFrame, signatures: DataFrame, threshold: float = 0.9, rounds: int = 20) -> DataFrame:
    """Merge clusters whose means are alike, maximal cliques first and disjoint, until none are; a merged cluster bears its first member's name."""
    spark = members.sparkSession
    for _ in range(rounds):
        table = means(members, signatures).withColumnRenamed("cluster_id", "signature")
        near = cosines(table, table).where((F.col("a") < F.col("b")) & (F.col("cosine") > threshold)).orderBy("a", "b").limit(MOST_CLUSTERS * 20 + 1).collect()
        if len(near) > MOST_CLUSTERS * 20:
            raise ValueError("too many similar clusters for the driver")
        if not near:
            return members
        names = sorted({r["a"] for r in near} | {r["b"] for r in near})
        place = {n: i for i, n in enumerate(names)}
        taken: set[int] = set()
        goal = []
        for clique in small.cliques(len(names), {(place[r["a"]], place[r["b"]]) for r in near}):
            free = [c for c in clique if c not in taken]
            if len(free) > 1:
                taken.update(free)
                goal += [(names[c], names[free[0]]) for c in free]
        moved = spark.createDataFrame(goal, "cluster_id string, goal string")
        members = cut(members.join(F.broadcast(moved), "cluster_id", "left").select(F.coalesce("goal", "cluster_id").alias("cluster_id"), "signature_id"))
    raise RuntimeError(f"clusters did not settle within {rounds} rounds")


def low_support(members: DataFrame, signatures: DataFrame, required: float = 0.2, floor: int = 2) -> DataFrame:
    """Clusters with their support by models and whether it is under ``required`` (a share of all models) or they have fewer than ``floor`` signatures."""
    total = signatures.agg(F.count_distinct("model_id").alias("total"))
    need = F.greatest(F.lit(1), F.least(F.ceil(F.col("total") * required), F.col("total")))
    rows = support(members, signatures).crossJoin(total).withColumn("needed", need)
    return rows.withColumn("low", (F.col("n_models") < F.col("needed")) | (F.col("n_signatures") < floor))


def weighed_support(members: DataFrame, signatures: DataFrame, by: str = "model", sizes: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, support)``: distinct signatures, models or cohorts of a cluster; with ``sizes`` ``(cohort, n_samples)`` each counts as its cohort's samples."""
    if by not in ("signature", "model", "cohort"):
        raise ValueError("support is by signature, model or cohort")
    if sizes is not None and by == "signature":
        raise ValueError("signatures aren't weighed by samples")
    key = {"signature": "signature_id", "model": "model_id", "cohort": "cohort"}[by]
    held = members.join(signatures.select("signature_id", "model_id", "cohort").distinct(), "signature_id").select("cluster_id", "cohort", key).distinct()
    if sizes is None:
        return held.groupBy("cluster_id").agg(F.count_distinct(key).alias("support"))
    return held.join(sizes, "cohort").groupBy("cluster_id").agg(F.sum("n_samples").alias("support"))


def dense_means(members: DataFrame, signatures: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Features, clusters and their mean weights as a matrix; ``ValueError`` beyond ``MOST_CLUSTERS`` clusters or 50 million cells."""
    table = means(members, signatures)
    shape = table.agg(F.count_distinct("feature").alias("m"), F.count_distinct("cluster_id").alias("k")).first()
    if shape["k"] > MOST_CLUSTERS or shape["m"] * shape["k"] > 50_000_000:
        raise ValueError(f"{shape['k']} clusters over {shape['m']} features are too many for a task")
    grid = table.toPandas().pivot(index="feature", columns="cluster_id", values="weight").fillna(0.0).sort_index().sort_index(axis=1)
    return grid.index.tolist(), grid.columns.tolist(), grid.to_numpy(float)


def as_mixture(one: np.ndarray, others: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Cosine of a column with its fit by others, and which of these make up ``share`` of the weight."""
    p, _, _ = nmf.fit(one[None, :], others.shape[1], fixed=others.T, max_iter=2000)
    fitted = others @ p[0]
    length = float(np.linalg.norm(one) * np.linalg.norm(fitted))
    order = np.argsort(-p[0], kind="stable")
    before = np.concatenate([[0.0], np.cumsum(p[0][order])[:-1]]) / max(float(p[0].sum()), nmf.EPS)
    used = np.zeros(len(p[0]), bool)
    used[order[before < share]] = True
    return (float(one @ fitted) / length if length else 0.0), used


def linear_combinations(members: DataFrame, signatures: DataFrame, threshold: float = 0.9, least_ratio: float = 0.5, by: str = "model", sizes: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, fit, components)`` of clusters that others make up, each judged against all others.

    Others need at least ``least_ratio`` of the cluster's support, and there must be two of them; components are
    what makes up 0.99 of the weight.  A task a cluster; the means, of checked size, are broadcast.
    """
    spark = members.sparkSession
    _, names, grid = dense_means(members, signatures)
    known = {r["cluster_id"]: float(r["support"]) for r in weighed_support(members, signatures, by, sizes).collect()}
    sent = spark.sparkContext.broadcast((names, grid, known))

    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        names, grid, known = sent.value
        for block in batches:
            out = []
            for i in block["id"]:
                fit = [j for j in range(len(names)) if j != i and known[names[j]] / known[names[i]] >= least_ratio]
                if len(fit) < 2:
                    continue
                near, used = as_mixture(grid[:, i], grid[:, fit], 0.99)
                if near >= threshold:
                    out.append((names[i], near, [names[j] for j, u in zip(fit, used, strict=True) if u]))
            yield pd.DataFrame(out, columns=["cluster_id", "fit", "components"])

    return spark.range(len(names)).mapInPandas(run, "cluster_id string, fit double, components array<string>")


def reduced_combinations(members: DataFrame, signatures: DataFrame, threshold: float = 0.9, least_ratio: float = 0.5, by: str = "model", sizes: DataFrame | None = None) -> DataFrame:
    """``(cluster_id, of, components)`` of clusters to remove, judged one after another from the best supported.

    A mixture of clusters that all have more than ``least_ratio`` of its support goes itself
    (``of`` is its own name); otherwise its poorly supported components go in its stead
    (``of`` names the mixture).  What is gone takes no part further on.  Each step depends on the
    last, over the means of checked size, so it runs on the driver.
    """
    _, names, grid = dense_means(members, signatures)
    known = {r["cluster_id"]: float(r["support"]) for r in weighed_support(members, signatures, by, sizes).collect()}
    todo = sorted(range(len(names)), key=lambda i: (known[names[i]], names[i]))
    gone: dict[int, tuple[str, list[str]]] = {}
    while todo:
        i = todo.pop()
        while i not in gone:
            rest = [j for j in range(len(names)) if j not in gone and j != i]
            if not rest:
                break
            near, used = as_mixture(grid[:, i], grid[:, rest], 0.98)
            if near < threshold:
                break
            parts = [j for j, u in zip(rest, used, strict=True) if u]
            weak = [j for j in parts if known[names[j]] / known[names[i]] <= least_ratio]
            for j in weak or [i]:
                gone[j] = (names[i], [names[p] for p in parts])
        todo = [j for j in todo if j not in gone]
    rows = [(names[j], of, parts) for j, (of, parts) in sorted(gone.items())]
    return members.sparkSession.createDataFrame(rows, "cluster_id string, of string, components array<string>")


def without(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Clusters but for those that are to go."""
    return members.join(gone.select("cluster_id"), "cluster_id", "left_anti")


def needed_support(members: DataFrame, signatures: DataFrame, required: int | float, by: str = "model", sizes: DataFrame | None = None) -> int:
    """Required support: a number as it is, a share of all, at least 1 and at most all."""
    key = {"signature": "signature_id", "model": "model_id", "cohort": "cohort"}[by]
    every = signatures.select("cohort", key).distinct()
    if sizes is None:
        total = every.select(key).distinct().count()
    else:
        total = int(every.join(sizes, "cohort").agg(F.sum("n_samples")).first()[0] or 0)
    need = required if isinstance(required, int) else int(np.ceil(total * required))
    return max(1, min(need, total))


def unsupported(
    members: DataFrame, signatures: DataFrame, x: DataFrame, required: int | float = 0.2, floor: int = 2, by: str = "model", sizes: DataFrame | None = None, exempt: tuple[str, ...] = (), retain_alpha: float = 0.05
) -> DataFrame:
    """``(cluster_id, reason, fit_without, fit_others, p)`` of the clusters to remove.

    ``floor``: fewer member signatures.  ``support``: under the required support, unless exempt, and kept all the same
    only if leaving it out of the model of all well-supported clusters and itself fits
    samples worse than leaving out any other does, by Kruskal-Wallis at ``retain_alpha``.  A task
    a cluster refits every leave-one-out model; the matrix ``x`` and the means, of checked size, are broadcast.
    """
    spark = members.sparkSession
    sizes_of = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    small_ones = [r["cluster_id"] for r in sizes_of.where(F.col("n") < floor).orderBy("cluster_id").collect()]
    rows = [(c, "floor", None, None, None) for c in small_ones]
    schema = "cluster_id string, reason string, fit_without double, fit_others double, p double"
    left = members.where(~F.col("cluster_id").isin(small_ones)) if small_ones else members
    need = needed_support(members, signatures, required, by, sizes)
    low = [r["cluster_id"] for r in weighed_support(left, signatures, by, sizes).where(F.col("support") < need).orderBy("cluster_id").collect() if r["cluster_id"] not in exempt]
    done = spark.createDataFrame(rows, schema)
    if not low:
        return done
    if retain_alpha <= 0:
        return done.unionByName(spark.createDataFrame([(c, "support", None, None, None) for c in low], schema))
    features, names, grid = dense_means(left, signatures)
    wide = x.select("sample").distinct().count()
    if wide * len(features) > 50_000_000:
        raise ValueError("the matrix is too large to be sent to tasks")
    v = x.toPandas().pivot(index="feature", columns="sample", values="value").reindex(features).fillna(0.0).to_numpy(float)
    good = [k for k, n in enumerate(names) if n not in low]
    sent = spark.sparkContext.broadcast((names, grid, v, good))

    def fits(w: np.ndarray, v: np.ndarray) -> np.ndarray:
        p, _, _ = nmf.fit(v.T, w.shape[1], fixed=w.T, max_iter=2000)
        y = w @ p.T
        length = np.linalg.norm(v, axis=0) * np.linalg.norm(y, axis=0)
        return np.where(length > 0, (v * y).sum(axis=0) / np.where(length > 0, length, 1), 0.0)

    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        names, grid, v, good = sent.value
        for block in batches:
            out = []
            for c in block["cluster_id"]:
                use = [names.index(c), *good]
                without_own = fits(grid[:, use[1:]], v) if good else np.zeros(v.shape[1])
                others = [fits(grid[:, [u for u in use if u != k]], v) for k in good]
                rest = np.concatenate(others) if others else np.ones(v.shape[1])
                _, p = small.kruskal(without_own, rest)
                if not (without_own.mean() < rest.mean() and p <= retain_alpha):
                    out.append((c, "support", float(without_own.mean()), float(rest.mean()), float(p)))
            yield pd.DataFrame(out, columns=["cluster_id", "reason", "fit_without", "fit_others", "p"])

    tested = spark.createDataFrame([(c,) for c in low], "cluster_id string").repartition(len(low)).mapInPandas(run, schema)
    return done.unionByName(tested)


def label_by_match(members: DataFrame, signatures: DataFrame, other: DataFrame) -> DataFrame:
    """``(cluster_id, label, pair_cosine)``: each cluster by the signature of another model that it is matched with, ``name (cosine)``; without one ``Cluster <n>``, its place by name from 0."""
    from partwise.operators.models import match

    table = means(members, signatures).withColumnRenamed("cluster_id", "signature")
    pairs = match(cosines(table, other)).select(F.col("a").alias("cluster_id"), "b", "pair_cosine")
    every = table.select(F.col("signature").alias("cluster_id")).distinct()
    place = F.row_number().over(Window.orderBy("cluster_id")) - 1
    label = F.coalesce(F.format_string("%s (%.2f)", "b", "pair_cosine"), F.concat(F.lit("Cluster "), place.cast("string")))
    return every.join(pairs, "cluster_id", "left").select("cluster_id", F.when(F.col("b").isNotNull(), label).otherwise(F.concat(F.lit("Cluster "), place.cast("string"))).alias("label"), "pair_cosine")


def member_similarity(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """``(cluster_id, a, b, cosine)``, a < b, of the members of each cluster; pairs are made within clusters only."""
    ids = members.join(signatures, "signature_id").select("cluster_id", "signature_id", "feature", "weight")
    norms = ids.groupBy("cluster_id", "signature_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    a, b = norms.withColumnsRenamed({"signature_id": "a", "norm": "na"}), norms.withColumnsRenamed({"signature_id": "b", "norm": "nb"})
    left, right = ids.withColumnsRenamed({"signature_id": "a", "weight": "x"}), ids.withColumnsRenamed({"signature_id": "b", "weight": "y"})
    dots = left.join(right, ["cluster_id", "feature"]).where("a < b").groupBy("cluster_id", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    pairs = a.join(b, "cluster_id").where("a < b").join(dots, ["cluster_id", "a", "b"], "left")
    return pairs.select("cluster_id", "a", "b", F.when(F.col("na") * F.col("nb") > 0, F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).otherwise(0.0).alias("cosine"))


def feature_variance(members: DataFrame, signatures: DataFrame, n: int = 5, unit: bool = False) -> DataFrame:
    """``(cluster_id, feature, place, signature_id, weight)``: the members' weights of each cluster's ``n`` heaviest features, absent ones as 0."""
    if unit:
        length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("signature_id")))
        signatures = signatures.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(0.0))
    top = top_features(members, signatures, n).select("cluster_id", "feature", "place")
    cells = members.join(top, "cluster_id").join(signatures.select("signature_id", "feature", "weight"), ["signature_id", "feature"], "left")
    return cells.select("cluster_id", "feature", "place", "signature_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def scaled_plane(signatures: DataFrame, seed: int = 0, most: int = 5_000) -> DataFrame:
    """``(signature_id, cohort, model_id, rank, mds1, mds2)``: metric scaling of 1 - cosine of at most ``most`` signatures."""
    table = signatures.select("feature", F.col("signature_id").alias("signature"), "weight")
    if table.select("signature").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} signatures")
    grid = cosines(table, table).toPandas().pivot(index="a", columns="b", values="cosine").sort_index().sort_index(axis=1)
    points = small.smacof(1 - grid.to_numpy(float), 2, seed)
    rows = [(n, float(p[0]), float(p[1])) for n, p in zip(grid.index, points, strict=True)]
    plane = signatures.sparkSession.createDataFrame(rows, "signature_id string, mds1 double, mds2 double")
    return signatures.select("signature_id", "cohort", "model_id", "rank").distinct().join(plane, "signature_id")


def alone(signatures: DataFrame) -> DataFrame:
    """Every signature a cluster of its own: how combining starts."""
    return signatures.select(F.col("signature_id").alias("cluster_id"), "signature_id").distinct()


def as_signatures(weights: DataFrame, cohort: str, model_id: str, rank: int) -> DataFrame:
    """A model's weights ``(feature, signature, weight)`` as signatures of a cohort, named ``cohort:model:signature``."""
    return weights.select(F.lit(cohort).alias("cohort"), F.lit(model_id).alias("model_id"), F.lit(rank).alias("rank"), F.concat(F.lit(f"{cohort}:{model_id}:"), "signature").alias("signature_id"), "feature", "weight")


def combine(signatures: DataFrame, x: DataFrame, merge_threshold: float = 0.9, split_threshold: float = 0.9, prune: bool = True, required: int | float = 0.2, alpha: float = 0.05) -> DataFrame:
    """One model out of many: ``(cluster_id, feature, weight)`` after merging what is alike, taking out linear combinations, and pruning what has little support."""
    members = merge_similar(alone(signatures), signatures, merge_threshold)
    members = cut(without(members, linear_combinations(members, signatures, split_threshold, 0.0)))
    if prune:
        members = cut(without(members, unsupported(members, signatures, x, required, floor=1, retain_alpha=alpha)))
    return means(members, signatures)
