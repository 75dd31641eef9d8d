"""Reading a model: dominant and representative signatures, orders, consensus, agreement of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representative(h: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per sample the largest shares up to and including the one that reaches ``threshold``; ``h`` is scaled by sample."""
    order = Window.partitionBy("sample").orderBy(F.desc("weight"), "sig_ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    first = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("weight"), "sig_ord")) == 1
    return h.where("weight is not null").withColumn("representative", (before < threshold) | first)


def primary(h: DataFrame) -> DataFrame:
    """Per sample the signature of the largest weight, ties to the first in order; null where all weights are 0."""
    best = F.max(F.when(F.col("weight") > 0, F.struct("weight", (-F.col("sig_ord")).alias("o"), "signature")))
    return h.groupBy("sample").agg(best.alias("best")).select("sample", F.col("best.signature").alias("primary_signature"))


def monodominant(h: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per sample whether one share reaches ``threshold``, and whose; ``h`` is scaled by sample."""
    best = F.max(F.struct("weight", (-F.col("sig_ord")).alias("o"), "signature")).alias("best")
    one = h.groupBy("sample").agg(best).select("sample", "best.*")
    over = F.coalesce(F.col("weight") >= threshold, F.lit(False))
    return one.select("sample", over.alias("is_monodominant"), F.when(over, F.col("signature")).alias("signature_name"))


def weight_order(w: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Features in descending order within each signature, from 1; weights over ``threshold`` only."""
    order = Window.partitionBy("signature").orderBy(F.desc("weight"), "feature")
    return w.where(F.col("weight") > threshold).withColumn("order", F.row_number().over(order))


def names_by_weight(w: DataFrame, cumulative: float = 0.4, most_chars: int = 10, most: int = 5, delimiter: str = "+", number: bool = True, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Label of each signature from its heaviest features.

    They are those that representativeness up to ``cumulative`` of the weight
    keeps, ``most`` of them, always the first and then whole ones while their
    letters fit ``most_chars``; joined, cleaned (blanks become underscores), and cut to
    ``most_chars`` at last.  ``number`` puts ``S<i>_`` before.
    """
    by = Window.partitionBy("signature").orderBy(F.desc("share"), "feature")
    total = F.sum("weight").over(Window.partitionBy("signature"))
    shares = w.withColumn("share", F.when(total != 0, F.col("weight") / total)).where("share is not null")
    before = F.coalesce(F.sum("share").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = shares.select("signature", "sig_ord", "feature", before.alias("before"), F.row_number().over(by).alias("r"))
    kept = ranked.where(((F.col("before") < cumulative) & (F.col("r") <= most)) | (F.col("r") == 1))
    letters = F.sum(F.length("feature")).over(Window.partitionBy("signature").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    fit = kept.withColumn("letters", letters).where((F.col("letters") <= most_chars) | (F.col("r") == 1))
    lists = fit.groupBy("signature", "sig_ord").agg(F.sort_array(F.collect_list(F.struct("r", "feature"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["feature"]), delimiter)
    label = F.substring(clean(joined) if clean else F.replace(joined, F.lit(" "), F.lit("_")), 1, most_chars)
    return lists.select("signature", (F.concat(F.lit("S"), F.col("sig_ord"), F.lit("_"), label) if number else label).alias("label"))


def consensus(h: DataFrame) -> DataFrame:
    """``(model_id, i, j, c)``, i >= j: 1 for samples that share a signature of maximal weight; other pairs are absent.

    Samples join on (model, signature), so pairs are made only within a
    signature; the result is quadratic in a signature's samples by definition.
    """
    top = F.max("weight").over(Window.partitionBy("model_id", "sample"))
    held = h.withColumn("top", top).where(F.col("weight") == F.col("top")).select("model_id", "signature", "sample")
    a, b = held.withColumnRenamed("sample", "i"), held.withColumnRenamed("sample", "j")
    return a.join(b, ["model_id", "signature"]).where("i >= j").select("model_id", "i", "j").distinct().withColumn("c", F.lit(1.0))


def mean_consensus(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``(rank, i, j, c)``: share of a rank's models that put i and j together; ``runs`` is ``(model_id, rank)``."""
    counts = runs.groupBy("rank").agg(F.count("*").alias("n_runs"))
    summed = pairs.join(runs, "model_id").groupBy("rank", "i", "j").agg(F.sum("c").alias("c"))
    return summed.join(counts, "rank").select("rank", "i", "j", (F.col("c") / F.col("n_runs")).alias("c"))


def dispersion(mean: DataFrame, n_samples: int, symmetric: bool = True) -> DataFrame:
    """Sum of 4 (c - 1/2)^2 over all cells, by their number.

    ``symmetric=False`` counts every cell above the diagonal as a 0, which adds
    1 each, as the original formula's code does.
    """
    n = float(n_samples)
    part = 4 * (F.col("c") - 0.5) * (F.col("c") - 0.5)
    off = F.sum(F.when(F.col("i") != F.col("j"), part).otherwise(0.0))
    stored = F.count_if(F.col("i") != F.col("j"))
    diagonal = F.sum(F.when(F.col("i") == F.col("j"), part).otherwise(0.0))
    absent = n * (n - 1) / 2 - stored
    below = off + absent
    total = diagonal + (below * 2 if symmetric else below + n * (n - 1) / 2)
    return mean.groupBy("rank").agg((total / (n * n)).alias("dispersion"))


def cosines(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(a, b, cosine)`` of all signatures of two weight tables; without shared features it is 0."""
    dot = a.select("feature", F.col("signature").alias("a"), F.col("weight").alias("x")).join(b.select("feature", F.col("signature").alias("b"), F.col("weight").alias("y")), "feature")
    dot = dot.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    size = lambda t, name, norm: t.groupBy(F.col("signature").alias(name)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(norm))
    every = size(a, "a", "na").crossJoin(size(b, "b", "nb")).join(dot, ["a", "b"], "left")
    length = F.col("na") * F.col("nb")
    return every.select("a", "b", F.when(length > 0, F.coalesce("dot", F.lit(0.0)) / length).otherwise(0.0).alias("cosine"))


def best_off(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each assigned pair the greatest cosine of its first signature with any other; null if there is no other."""
    other = pairs.join(assigned.select("a", F.col("b").alias("own")), "a").where(F.col("b") != F.col("own"))
    top = other.groupBy("a").agg(F.max("cosine").alias("max_off_cosine"))
    return assigned.join(pairs, ["a", "b"]).join(top, "a", "left").select("a", "b", F.col("cosine").alias("pair_cosine"), "max_off_cosine")


def top_models(models: DataFrame, criterion: str, n: int) -> DataFrame:
    """The best ``n`` models of each rank with their position; losses ascend, similarities descend, ties go to the lower seed."""
    rising = {"rss", "l2_norm", "beta_divergence"}
    if criterion not in rising | {"cosine_similarity", "r_squared"}:
        raise ValueError(f"no criterion {criterion!r}")
    order = F.asc(criterion) if criterion in rising else F.desc(criterion)
    return models.withColumn("position", F.row_number().over(Window.partitionBy("rank").orderBy(order, "seed"))).where(F.col("position") <= n)


def bray_curtis(x: DataFrame, key: str = "sample", other: str = "feature", value: str = "value") -> DataFrame:
    """``(i, j, distance)``, i < j, of all samples that have mass; sums over the shared ``other`` axis."""
    x = x.withColumn("_mass", F.sum(value).over(Window.partitionBy(key))).where("_mass > 0").drop("_mass")
    a = x.select(other, F.col(key).alias("i"), F.col(value).alias("p"))
    b = x.select(other, F.col(key).alias("j"), F.col(value).alias("q"))
    both = a.join(b, other).where("i < j")
    return both.groupBy("i", "j").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / F.sum(F.col("p") + F.col("q"))).alias("distance"))
