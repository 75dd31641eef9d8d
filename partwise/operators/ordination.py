"""Principal coordinates of samples, features or signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.kernels import small
from partwise.operators import matrix
from partwise.operators.analysis import bray_curtis, cosines

#: Points that the eigenvalues of one task may be of.
MOST_POINTS = 5_000
DISTANCES = ("braycurtis", "cosine")


def table_of(on: str, w: DataFrame, h: DataFrame, x: DataFrame | None) -> DataFrame:
    """``(item, axis, value)``: samples by signature (``h``), by fitted features (``wh``) or by features (``x``), or signatures by feature (``signatures``)."""
    if on == "h":
        return h.select(F.col("sample").alias("item"), F.col("signature").alias("axis"), F.col("weight").alias("value"))
    if on == "wh":
        return matrix.product(w, h).select(F.col("sample").alias("item"), F.col("feature").alias("axis"), F.col("fitted").alias("value"))
    if on == "signatures":
        return w.select(F.col("signature").alias("item"), F.col("feature").alias("axis"), F.col("weight").alias("value"))
    if on == "x" and x is not None:
        return x.select(F.col("sample").alias("item"), F.col("feature").alias("axis"), "value")
    raise ValueError(f"no table {on!r}: h, wh, x or signatures")


def distances(table: DataFrame, distance: str = "braycurtis", wisconsin: bool = True, sqrt: bool = True) -> DataFrame:
    """``(i, j, distance)``, i < j, of items that have mass."""
    if distance not in DISTANCES:
        raise ValueError(f"no distance {distance!r}")
    alive = table.groupBy("axis").agg(F.sum("value").alias("t")).where("t > 0").select("axis")
    t = table.join(alive, "axis", "left_semi")
    t = matrix.wisconsin(t, "axis", "item") if wisconsin else t
    if distance == "braycurtis":
        pairs = bray_curtis(t, "item", "axis")
    else:
        named = t.select(F.col("axis").alias("feature"), F.col("item").alias("signature"), F.col("value").alias("weight"))
        pairs = cosines(named, named).where("a < b").select(F.col("a").alias("i"), F.col("b").alias("j"), (1 - F.col("cosine")).alias("distance"))
    return pairs.withColumn("distance", F.sqrt(F.greatest("distance", F.lit(0.0)))) if sqrt else pairs


def coordinates(pairs: DataFrame, axes: int = 2) -> DataFrame:
    """``(item, axis, value, share)`` from ``(i, j, distance)``: principal coordinates, and the share of each axis; at most ``MOST_POINTS`` items."""
    items = pairs.select(F.col("i").alias("item")).unionByName(pairs.select(F.col("j").alias("item"))).distinct()
    if items.limit(MOST_POINTS + 1).count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} items to ordinate")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(block["i"]) | set(block["j"]))
        at = pd.Series(range(len(names)), index=names)
        m = np.zeros((len(names), len(names)))
        i, j = at[block["i"]].to_numpy(), at[block["j"]].to_numpy()
        m[i, j] = m[j, i] = block["distance"].to_numpy(float)
        points, share = small.principal_coordinates(m, axes)
        k = points.shape[1]
        return pd.DataFrame({"item": np.repeat(names, k), "axis": np.tile(np.arange(1, k + 1, dtype=np.int32), len(names)), "value": points.ravel(), "share": np.tile(share, len(names))})

    return pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "item string, axis int, value double, share double")


def arrows(points: DataFrame, table: DataFrame) -> DataFrame:
    """``(variable, axis, value)``: the covariance of each of the table's axes with each standardised coordinate, as a biplot's arrows."""
    n = points.select("item").distinct().agg(F.count("*").alias("n"))
    sd = points.groupBy("axis").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("mean"))
    mean = table.groupBy(F.col("axis").alias("variable")).agg(F.sum("value").alias("total"))
    both = table.select("item", F.col("axis").alias("variable"), F.col("value").alias("v")).join(points.select("item", "axis", F.col("value").alias("p")), "item").join(sd, "axis")
    sums = both.groupBy("variable", "axis").agg(F.sum(F.col("v") * (F.col("p") - F.col("mean"))).alias("s"), F.first("sd").alias("sd"))
    return sums.join(mean, "variable").crossJoin(n).select("variable", "axis", F.when(F.col("sd") > 0, F.col("s") / (F.col("n") - 1) / F.col("sd")).otherwise(0.0).alias("value"))


def pcoa(w: DataFrame, h: DataFrame, x: DataFrame | None = None, on: str = "h", distance: str = "braycurtis", wisconsin: bool = True, sqrt: bool = True, axes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Coordinates and arrows of one of a model's tables."""
    table = table_of(on, w, h, x)
    points = coordinates(distances(table, distance, wisconsin, sqrt), axes)
    return points, arrows(points, table)
