"""Fitting and applying models: transform with fixed weights, multi-start decomposition, matching of models."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.kernels import nmf, small
from partwise.operators.holdout import dense_matrix
from partwise.session import cut, discard

#: Weights of a model that a task may hold.
MOST_WEIGHTS = 50_000_000


def held(w: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Features, signatures in order and the dense weights of a model; ``ValueError`` if it is too large for a task."""
    w = cut(w.select("feature", "signature", "sig_ord", "weight"))
    shape = w.agg(F.count_distinct("feature").alias("m"), F.count_distinct("signature").alias("k")).first()
    if shape["m"] * shape["k"] > MOST_WEIGHTS:
        raise ValueError("the model is too large to be sent to tasks; use transform_joined")
    rows = w.toPandas()
    discard(w)
    names = rows[["sig_ord", "signature"]].drop_duplicates().sort_values("sig_ord")["signature"].tolist()
    dense = rows.pivot(index="feature", columns="signature", values="weight").fillna(0.0).sort_index()[names]
    return dense.index.tolist(), names, dense.to_numpy(float)


def transform(x: DataFrame, w: DataFrame, rounds: int = 200, tol: float = 0.0) -> DataFrame:
    """H of new samples under fixed weights: ``(sample, signature, sig_ord, weight)``.

    Kullback-Leibler updates from the constant start sqrt(mean / k), where the
    mean is that of the whole matrix over the model's features; up to ``rounds``
    of them, fewer for samples that gain less than ``tol`` in ten.  Given that mean each
    sample stands alone: features are numbered by a join, samples gathered one by
    one and mapped in Arrow batches; one shuffle by sample.  The weights, of
    checked size, are broadcast once to each executor.
    """
    spark = x.sparkSession
    features, names, dense = held(w)
    place = F.broadcast(spark.createDataFrame(list(zip(features, range(len(features)), strict=True)), "feature string, at int"))
    rows = x.join(place, "feature").groupBy("sample").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("v"), F.sum("value").alias("s"))
    # The samples are few beside the cells: written once, they give the mean and then the result.
    rows = cut(rows)
    totals = rows.agg(F.sum("s").alias("s"), F.count("*").alias("n")).first()
    begin = math.sqrt((totals["s"] or 0.0) / (len(features) * max(totals["n"], 1)) / len(names))
    sent = spark.sparkContext.broadcast(dense)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        weights = sent.value
        for block in batches:
            for lo in range(0, len(block), 1024):
                part = block.iloc[lo : lo + 1024]
                v = dense_block(part["at"], part["v"], len(weights))
                yield long_weights(part["sample"], names, nmf.apply_fixed(v, weights, begin, rounds, tol))

    return rows.select("sample", "at", "v").mapInPandas(run, "sample string, signature string, sig_ord int, weight double")


def dense_block(at: pd.Series, values: pd.Series, m: int) -> np.ndarray:
    """Features x samples from each sample's feature numbers and values."""
    v = np.zeros((m, len(at)))
    for j, (places, xs) in enumerate(zip(at, values, strict=True)):
        v[np.asarray(places, int), j] = xs
    return v


def long_weights(samples: pd.Series, names: list[str], h: np.ndarray) -> pd.DataFrame:
    """A block's weights (signatures x samples) as rows."""
    k = len(names)
    return pd.DataFrame({"sample": np.repeat(samples.to_numpy(), k), "signature": np.tile(names, len(samples)), "sig_ord": np.tile(np.arange(1, k + 1, dtype=np.int32), len(samples)), "weight": h.T.ravel()})


def transform_joined(x: DataFrame, w: DataFrame, begin: float, rounds: int) -> DataFrame:
    """The same without holding the model anywhere: each round is a join and two aggregations.  For models of any size."""
    mass = w.groupBy("signature", "sig_ord").agg(F.sum("weight").alias("mass"))
    h = x.select("sample").distinct().crossJoin(mass.select("signature", "sig_ord")).withColumn("weight", F.lit(begin))
    cells = x.where("value > 0")
    for _ in range(rounds):
        pairs = w.select("feature", "signature", F.col("weight").alias("a")).join(h.select("sample", "signature", F.col("weight").alias("b")), "signature")
        fitted = pairs.groupBy("feature", "sample").agg(F.sum(F.col("a") * F.col("b")).alias("y"))
        ratio = cells.join(fitted, ["feature", "sample"]).select("feature", "sample", (F.col("value") / F.col("y")).alias("q"))
        top = ratio.join(w.select("feature", "signature", F.col("weight").alias("a")), "feature").groupBy("sample", "signature").agg(F.sum(F.col("a") * F.col("q")).alias("top"))
        h = h.join(top, ["sample", "signature"], "left").join(mass.select("signature", "mass"), "signature")
        h = h.select("sample", "signature", "sig_ord", (F.col("weight") * F.coalesce("top", F.lit(0.0)) / F.col("mass")).alias("weight"))
    return h


FITTED = "model_id string, rank int, seed long, n_iter int, features array<string>, samples array<string>, w array<double>, h array<double>, cosine_similarity double, r_squared double, rss double, l2_norm double, beta_divergence double"


def decompose(x: DataFrame, ranks: list[int], starts: int = 100, seed: int = 0, init: str = "random", **options) -> DataFrame:
    """One row a fit: ids, measures, and both factors as arrays (row-major).  Inits without randomness start once.

    The matrix, of checked size, is broadcast once; a task is a (rank, seed), largest ranks first.
    """
    n = 1 if init in ("nndsvd", "nndsvda") else starts
    spark = x.sparkSession
    features, samples, v = dense_matrix(x)
    sent = spark.sparkContext.broadcast((features, samples, v))
    listed = [(int(r), int(seed * 1_000_003 + r * 1_009 + s)) for r in sorted(ranks, reverse=True) for s in range(n)]
    tasks = spark.createDataFrame(listed, "rank int, seed long").repartition(max(1, min(len(listed), 10_000)), "rank", "seed")

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        features, samples, v = sent.value
        for block in blocks:
            out = []
            for rank, own in zip(block["rank"].tolist(), block["seed"].tolist(), strict=True):
                w, h, rounds = nmf.fit(v, rank, init=init, seed=own, **options)
                got = nmf.measures(v, w @ h)
                kept = {k: got[k] for k in ("cosine_similarity", "r_squared", "rss", "l2_norm")}
                out.append({"model_id": f"k{rank}-s{own}", "rank": rank, "seed": own, "n_iter": rounds, "features": features, "samples": samples, "w": w.ravel(), "h": h.ravel(), **kept, "beta_divergence": got["reconstruction_error"]})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FITTED.split(", ")])

    return tasks.mapInPandas(run, FITTED)


def weights_of(models: DataFrame) -> DataFrame:
    """Fits as ``(model_id, feature, signature, sig_ord, weight)``."""
    cells = models.select("model_id", "rank", "features", F.posexplode("w").alias("p", "weight"))
    at, k = F.floor(F.col("p") / F.col("rank")).cast("int"), (F.col("p") % F.col("rank") + 1).cast("int")
    return cells.select("model_id", F.get("features", at).alias("feature"), F.concat(F.lit("S"), k).alias("signature"), k.alias("sig_ord"), "weight")


def sample_weights_of(models: DataFrame) -> DataFrame:
    """Fits as ``(model_id, sample, signature, sig_ord, weight)``."""
    cells = models.select("model_id", F.size("samples").alias("n"), "samples", F.posexplode("h").alias("p", "weight"))
    at, k = (F.col("p") % F.col("n")).cast("int"), (F.floor(F.col("p") / F.col("n")) + 1).cast("int")
    return cells.select("model_id", F.get("samples", at).alias("sample"), F.concat(F.lit("S"), k).alias("signature"), k.alias("sig_ord"), "weight")


def match(pairs: DataFrame, group: str | None = None) -> DataFrame:
    """Pairs of signatures of greatest total cosine, by group if named: ``([group,] a, b, pair_cosine)``."""
    held_by = group or "_all"
    table = pairs if group else pairs.withColumn("_all", F.lit(0))
    kind = table.schema[held_by].dataType.simpleString()

    def run(block: pd.DataFrame) -> pd.DataFrame:
        grid = block.pivot(index="a", columns="b", values="cosine").sort_index().sort_index(axis=1)
        found = small.assign(grid.to_numpy(float))
        return pd.DataFrame([(block[held_by].iloc[0], grid.index[i], grid.columns[j], grid.iat[i, j]) for i, j in found], columns=[held_by, "a", "b", "pair_cosine"])

    out = table.groupBy(held_by).applyInPandas(run, f"`{held_by}` {kind}, a string, b string, pair_cosine double")
    return out if group else out.drop("_all")
