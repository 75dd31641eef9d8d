"""The tables that plots are drawn from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.operators import holdout, matrix, measures, stats
from partwise.operators.analysis import weight_order

#: Models of more samples are saved without the plots that draw each sample.
MOST_DRAWN_SAMPLES = 250


def selected(every: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> list[str]:
    """Measures to show, in order; ``ValueError`` for names that don't exist."""
    if unknown := (set(include or ()) | set(exclude or ())) - set(every):
        raise ValueError(f"no measures {sorted(unknown)}")
    return [m for m in every if (include is None or m in include) and m not in (exclude or ())]


def selection(table: DataFrame, by: str = "rank", include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    """``(rank or alpha, shuffle, measure, value, facet_ord, label)`` of results with a row a shuffle; alphas are labelled in scientific notation."""
    shown = selected(holdout.MEASURES, include, exclude)
    long = table.select(by, "shuffle", *shown).unpivot([by, "shuffle"], shown, "measure", "value")
    place = F.array_position(F.array(*map(F.lit, shown)), F.col("measure")).cast("int")
    label = F.format_string("%.2e", F.col(by).cast("double")) if by == "alpha" else F.col(by).cast("string")
    return long.select(by, "shuffle", "measure", "value", place.alias("facet_ord"), label.alias("label"))


def stars(points: DataFrame, suggested: DataFrame, by: str = "rank") -> DataFrame:
    """``(measure, rank, y)``: where a suggestion is marked, a tenth of the facet's range over its highest value; ``suggested`` is ``(measure, suggested)``."""
    facets = points.groupBy("measure").agg(F.max("value").alias("top"), F.min("value").alias("low"))
    known = suggested.where("suggested is not null")
    return known.join(facets, "measure", "left").select("measure", F.col("suggested").alias(by), (F.col("top") + 0.1 * (F.col("top") - F.col("low"))).alias("y"))


def regularisation(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points ``(alpha, shuffle, measure, value, ...)`` of R2, and the star of the best alpha."""
    points = selection(holdout.summary(results), "alpha", ["r_squared"])
    best = holdout.best_alpha(results).select(F.lit("r_squared").alias("measure"), F.col("best_alpha").alias("suggested"))
    return points, stars(points, best, "alpha")


def stability(curve: DataFrame, near: float = 0.02) -> DataFrame:
    """``(measure, rank, value, suggested)`` of stability measures ``(measure, rank, value)``, without rank 1."""
    found = holdout.suggest_rank_stability(curve, near)
    return holdout.without_rank_one(curve).join(found.withColumnRenamed("suggested", "at"), "measure", "left").select("measure", "rank", "value", F.coalesce(F.col("rank") == F.col("at"), F.lit(False)).alias("suggested"))


def model_fit(pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(sample, model_fit[, grp], mean_fit)``; samples that only one side knows stay, with null for the rest.  ``groups`` is ``(sample, grp)``."""
    fit = measures.model_fit(pairs)
    if groups is None:
        return fit.crossJoin(fit.agg(F.avg("model_fit").alias("mean_fit")))
    both = fit.join(groups, "sample", "full")
    return both.withColumn("mean_fit", F.avg("model_fit").over(Window.partitionBy("grp")))


def ribbon(samples: DataFrame, groups: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """``(sample, grp, grp_ord)``: each sample's group, ``NA`` without one, groups in the order given or by name, ``NA`` last."""
    held = samples.select("sample").distinct().join(groups.select("sample", "grp"), "sample", "left").select("sample", F.coalesce("grp", F.lit("NA")).alias("grp"))
    if order is not None:
        place = F.array_position(F.array(*map(F.lit, order)), F.col("grp")).cast("int")
        return held.withColumn("grp_ord", F.when(place > 0, place).otherwise(len(order) + 1))
    names = held.select("grp").distinct().withColumn("grp_ord", F.row_number().over(Window.orderBy((F.col("grp") == "NA").cast("int"), "grp")).cast("int"))
    return held.join(F.broadcast(names), "grp").select("sample", "grp", "grp_ord")


def ribbon_report(samples: DataFrame, groups: DataFrame) -> DataFrame:
    """``(problem, n)``: samples that lack a group (``missing``), and groups of samples that don't exist (``extra``)."""
    known = samples.select("sample").distinct()
    lacking = known.join(groups.where("grp is not null").select("sample"), "sample", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing").alias("problem"), "n")
    return lacking.unionByName(groups.select("sample").distinct().join(known, "sample", "left_anti").agg(F.count("*").alias("n")).select(F.lit("extra").alias("problem"), "n"))


def feature_weights(w: DataFrame, threshold: float = 0.04, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(feature, signature, rel_weight, label)`` of shares of at least ``threshold``."""
    shares = matrix.scaled(w, "w").where(F.col("weight") >= threshold)
    return shares.select("feature", "signature", F.col("weight").alias("rel_weight"), (label(F.col("feature")) if label else F.col("feature")).alias("label"))


def weight_distribution(w: DataFrame, threshold: float = 0.0, log: bool = True) -> DataFrame:
    """``(signature, order, weight)``, with log10(1 + weight) if ``log``."""
    rows = weight_order(w, threshold)
    return rows.select("signature", "order", (F.log10(1 + F.col("weight")) if log else F.col("weight")).alias("weight"))


def discrete_metadata(values: DataFrame, metadata: DataFrame, formatter: Callable[[Column, Column, Column], Column] | None = None, **options) -> DataFrame:
    """``(sample, md, grp, signature, sig_ord, value, significance, x, y)``: values by group, and each panel's mark and its place.

    ``values`` is ``(sample, signature, sig_ord, value)``, ``metadata`` ``(sample, md, grp)``.  ``formatter`` writes a mark from p, the locally
    and the globally adjusted p.  The mark stands over the panel's highest value, amid its groups.
    """
    known = metadata.where("grp is not null")
    points = known.join(values, "sample")
    tests = stats.univariate(values.select("sample", "signature", "value"), known, **options)
    mark = formatter(F.col("p"), F.col("local_adj_p"), F.col("global_adj_p")) if formatter else stats.written(F.col("p"), F.col("global_adj_p"))
    marks = tests.select("md", "signature", mark.alias("significance"))
    panels = points.groupBy("md", "signature").agg((F.max("value") + 0.1 * (F.max("value") - F.min("value"))).alias("y"), ((F.count_distinct("grp") + 1) / 2).alias("x"))
    return points.join(marks.join(panels, ["md", "signature"], "left"), ["md", "signature"], "left")


def continuous_metadata(values: DataFrame, metadata: DataFrame) -> DataFrame:
    """``(sample, md, md_value, signature, sig_ord, value)`` of numeric fields; ``metadata`` is ``(sample, md, grp)``."""
    return metadata.where("grp is not null").join(values, "sample").select("sample", "md", F.col("grp").cast("double").alias("md_value"), "signature", "sig_ord", "value")


def to_draw(n_samples: int) -> list[str]:
    """Plots that are saved with a model of so many samples."""
    each = ["model_fit_point", "relative_weight", "pcoa"]
    return ["model_fit", "feature_weight", "weight_distribution", *(each if n_samples <= MOST_DRAWN_SAMPLES else [])]
