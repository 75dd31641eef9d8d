"""Applying a model to new data: check the input, match its features, transform, report what was lost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.operators import mapping, matrix, measures, models

#: Checks and changes a matrix ``(feature, sample, value)``.
Validation = Callable[[DataFrame], DataFrame]
#: From weights and a matrix to ``(input_feature, model_feature, priority, rule)``.
Match = Callable[[DataFrame, DataFrame], DataFrame]


def unchanged(x: DataFrame) -> DataFrame:
    """The matrix as it is."""
    return x


@dataclass(frozen=True)
class Applied:
    """A model on new data: weights over the data's features, sample weights, the mapped matrix, the mapping, and a report row."""

    w: DataFrame
    h: DataFrame
    x: DataFrame
    feature_mapping: DataFrame
    report: DataFrame
    colors: list[str] | None = None

    def fitted(self) -> DataFrame:
        return matrix.product(self.w, self.h)

    def model_fit(self) -> DataFrame:
        """Cosine of each sample with its fit."""
        return measures.model_fit(measures.paired(self.x, self.fitted()))


def loss(x: DataFrame, w: DataFrame, new_w: DataFrame) -> DataFrame:
    """One row: features and mass of the mapped matrix that the model doesn't know, and the model's weight that the data doesn't use."""
    known = new_w.groupBy("feature").agg(F.sum("weight").alias("t")).select("feature", (F.col("t") != 0).alias("known"))
    sides = x.join(known, "feature").agg(
        F.count_distinct(F.when(~F.col("known"), F.col("feature"))).alias("unknown_features"),
        F.coalesce(F.sum(F.when(~F.col("known"), F.col("value"))), F.lit(0.0)).alias("unknown_mass"),
        F.sum("value").alias("mass"),
    )
    total = w.agg(F.sum("weight").alias("model_weight")).crossJoin(new_w.agg(F.sum("weight").alias("used_weight")))
    share = (F.col("unknown_mass") / F.col("mass")).alias("unknown_share")
    return sides.crossJoin(total).select("*", share, (1 - F.col("used_weight") / F.col("model_weight")).alias("lost_weight_share"))


def reapply(
    x: DataFrame,
    w: DataFrame,
    validate: Validation = unchanged,
    match: Match = mapping.match_identical,
    colors: list[str] | None = None,
    rounds: int = 2000,
    tol: float = 1e-4,
) -> Applied:
    """Fixed weights on new data.

    Input is validated, then its features are matched; mapped features are
    summed, so a validation that isn't linear (a logarithm, say) changes what the sums
    mean.  Features of the model that the data lacks are dropped, those that the
    model lacks have weight 0.
    """
    clean = validate(x)
    found = match(w, clean)
    mapped = mapping.map_abundance(clean, found)
    new_w = mapping.map_weights(w, mapped)
    return Applied(new_w, models.transform(mapped, new_w, rounds, tol), mapped, found, loss(mapped, w, new_w), colors)


@dataclass(frozen=True)
class Signatures:
    """A published model: weights, colours, and how its input is checked and matched."""

    w: DataFrame
    colors: list[str] = field(default_factory=list)
    validate: Validation = unchanged
    match: Match = mapping.match_identical
    citation: str = ""

    def reapply(self, x: DataFrame, **options) -> Applied:
        return reapply(x, self.w, self.validate, self.match, self.colors or None, **options)


def lineage_model(w: DataFrame, colors: list[str] | None = None, family_rollup: bool = True, hard: DataFrame | None = None, citation: str = "") -> Signatures:
    """A model over lineages: input is validated as a lineage table and matched by the rules for them."""
    return Signatures(w, colors or [], mapping.validate_lineages, lambda w, x: mapping.match_lineages(w, x, family_rollup, hard), citation)
