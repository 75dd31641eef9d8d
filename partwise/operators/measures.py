"""Fit measures of a model against a matrix, as aggregate columns over ``value`` and ``fitted``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _x() -> Column:
    return F.col("value")


def _y() -> Column:
    return F.col("fitted")


def paired(x: DataFrame, fitted: DataFrame) -> DataFrame:
    """Cells with their fitted values; a cell that either lacks is 0 there."""
    both = x.join(fitted, ["feature", "sample"], "full")
    return both.select("feature", "sample", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("fitted", F.lit(0.0)).alias("fitted"))


def rss() -> Column:
    return F.sum((_x() - _y()) * (_x() - _y()))


def r_squared() -> Column:
    spread = F.var_pop("value") * F.count("value")
    return F.when(spread > 0, 1 - rss() / spread)


def cosine() -> Column:
    length = F.sqrt(F.sum(_x() * _x()) * F.sum(_y() * _y()))
    return F.when(length > 0, F.sum(_x() * _y()) / length)


def l2_norm() -> Column:
    return F.sqrt(rss())


def kullback_leibler() -> Column:
    return F.sum(F.when(_x() > 0, _x() * F.log(_x() / _y())).otherwise(0.0) - _x() + _y())


def frobenius() -> Column:
    return rss() / 2


def itakura_saito() -> Column:
    return F.sum(_x() / _y() - F.log(_x() / _y()) - 1)


def quality(pairs: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """One row of the seven measures."""
    zero = lambda t, name: t.agg((1 - F.count_if(F.col("weight") != 0) / F.count("*")).alias(name))
    fit = pairs.agg(cosine().alias("cosine_similarity"), r_squared().alias("r_squared"), rss().alias("rss"), l2_norm().alias("l2_norm"), kullback_leibler().alias("beta_divergence"))
    return fit.crossJoin(zero(w, "sparsity_w")).crossJoin(zero(h, "sparsity_h"))


def model_fit(pairs: DataFrame) -> DataFrame:
    """Cosine of each sample with its fit; 0 for a sample without mass."""
    return pairs.groupBy("sample").agg(F.coalesce(cosine(), F.lit(0.0)).alias("model_fit"))
