"""Long matrices ``(feature, sample, value)`` and weights ``(feature|sample, signature, sig_ord, weight)``: shape, scaling, validation, slicing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill(x: DataFrame, row: str = "feature", col: str = "sample", value: str = "value") -> DataFrame:
    """Every row and column pair, absent cells as 0."""
    every = x.select(row).distinct().crossJoin(x.select(col).distinct())
    return every.join(x, [row, col], "left").select(row, col, F.coalesce(value, F.lit(0.0)).alias(value))


def share(x: DataFrame, by: str | Sequence[str], value: str = "value") -> DataFrame:
    """``value`` over its total within ``by``; null where the total is 0."""
    keys = [by] if isinstance(by, str) else list(by)
    total = F.sum(value).over(Window.partitionBy(*keys))
    return x.withColumn(value, F.when(total != 0, F.col(value) / total))


def scaled(weights: DataFrame, matrix: str, by: str | None = None) -> DataFrame:
    """Scale W or H: H by sample (default) or signature, W by signature (default) or feature; an axis that a matrix lacks falls back to the default."""
    axes = {"h": ("sample", "signature"), "w": ("signature", "feature")}
    if matrix not in axes or by not in (None, "sample", "signature", "feature"):
        raise ValueError(f"cannot scale {matrix!r} by {by!r}")
    axis = by if by in axes[matrix] else axes[matrix][0]
    return share(weights, axis, "weight")


def wisconsin(x: DataFrame, row: str = "feature", col: str = "sample", value: str = "value") -> DataFrame:
    """Double standardisation: over the row's maximum, then over the column's total."""
    top = F.max(value).over(Window.partitionBy(row))
    return share(x.withColumn(value, F.when(top != 0, F.col(value) / top)), col, value)


def unit(weights: DataFrame, by: str = "signature") -> DataFrame:
    """Weights over the Euclidean length of their signature."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(by)))
    return weights.withColumn("weight", F.when(length != 0, F.col("weight") / length))


def product(w: DataFrame, h: DataFrame) -> DataFrame:
    """W times H as ``(feature, sample, fitted)``; the signature joins, so partial sums are combined before the shuffle."""
    pairs = w.select("feature", "signature", F.col("weight").alias("a")).join(h.select("sample", "signature", F.col("weight").alias("b")), "signature")
    return pairs.groupBy("feature", "sample").agg(F.sum(F.col("a") * F.col("b")).alias("fitted"))


def profile(x: DataFrame) -> DataFrame:
    """One row: features, samples, cells, least value, cells that are null or NaN, and whether the matrix is valid."""
    bad = F.count_if(F.col("value").isNull() | F.isnan("value"))
    one = x.agg(F.count_distinct("feature").alias("n_features"), F.count_distinct("sample").alias("n_samples"), F.count("*").alias("n_cells"), F.min("value").alias("min_value"), bad.alias("n_missing"))
    return one.withColumn("valid", (F.col("n_features") >= 2) & (F.col("n_samples") >= 2) & (F.col("min_value") >= 0) & (F.col("n_missing") == 0))


def validate(x: DataFrame) -> DataFrame:
    """``x`` itself; ``ValueError`` unless it is at least 2 by 2, non-negative and without gaps."""
    if not profile(x).first()["valid"]:
        raise ValueError("a matrix needs two features, two samples, and values that are present and not negative")
    return x


def wide(x: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One column a sample (named, so no job is needed to find them)."""
    return x.groupBy("feature").pivot("sample", list(samples)).agg(F.first("value"))


def long(x: DataFrame, key: str = "feature", name: str = "sample", value: str = "value") -> DataFrame:
    """A wide table as a long one."""
    rest = [c for c in x.columns if c != key]
    return x.select(quoted(key), *[quoted(c).cast("double").alias(c) for c in rest]).unpivot([quoted(key)], [quoted(c) for c in rest], name, value)


def quoted(name: str) -> Column:
    """A column by its whole name, dots, blanks and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def pivot_fields(stacked: DataFrame, key: str = "sample", field: str = "field", value: str = "value") -> DataFrame:
    """Stacked metadata as one column a field; of several values the least."""
    fields = [r[field] for r in stacked.select(field).distinct().orderBy(field).limit(10_001).collect()]
    if len(fields) > 10_000:
        raise ValueError("more than 10,000 fields")
    return stacked.groupBy(key).pivot(field, fields).agg(F.min(value))


def pick(weights: DataFrame, axis: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``axis`` is wanted; ``wanted`` is ``(axis, new_ord)``."""
    return weights.join(wanted, axis)


def chosen(labels: Sequence[str], wanted: slice | int | str | Sequence[int | str] | None) -> list[str]:
    """Names out of ordered ``labels`` by name, position, range of either, or a mixed list of these; ``IndexError`` for what isn't there.

    Ranges of positions end before their stop; ranges of names include it.
    """
    if wanted is None:
        return list(labels)
    if isinstance(wanted, slice):
        at = lambda x: place(x) if isinstance(x, str) else x

        def place(name: str) -> int:
            if name not in labels:
                raise IndexError(f"there is no {name!r}")
            return labels.index(name)

        stop = at(wanted.stop) + 1 if isinstance(wanted.stop, str) else wanted.stop
        return list(labels[slice(at(wanted.start), stop, wanted.step)])
    if isinstance(wanted, (int, str)):
        wanted = [wanted]
    out = []
    for x in wanted:
        if isinstance(x, str) and x not in labels:
            raise IndexError(f"there is no {x!r}")
        if not isinstance(x, str) and not -len(labels) <= x < len(labels):
            raise IndexError(f"there is no position {x} among {len(labels)}")
        out.append(x if isinstance(x, str) else labels[x])
    return out


def sliced(weights: DataFrame, axis: str, wanted, order: str | None = None) -> DataFrame:
    """Rows of the wanted labels of an axis, with ``new_ord``, their place in the order asked for, from 1.

    ``order`` names the column that orders the labels, else their names do.  Labels, not cells, come to the driver.
    """
    keys = weights.select(axis, *([order] if order else [])).distinct().orderBy(order or axis).limit(1_000_001).collect()
    if len(keys) > 1_000_000:
        raise ValueError(f"more than a million labels on {axis}; join with a table of the wanted ones")
    names = chosen([r[axis] for r in keys], wanted)
    table = weights.sparkSession.createDataFrame([(n, k + 1) for k, n in enumerate(names)], f"`{axis}` string, new_ord int")
    return pick(weights, axis, table)


def split_cohorts(x: DataFrame, labels: DataFrame, min_size: int = 0) -> DataFrame:
    """Cells with their sample's label; labels of fewer samples are dropped."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("label")
    return x.join(labels.join(sizes, "label"), "sample")


def first_of_samples(tables: DataFrame) -> DataFrame:
    """Of cohorts that share a sample the first by ``cohort_ord`` keeps it."""
    first = tables.groupBy("sample").agg(F.min("cohort_ord").alias("cohort_ord"))
    return tables.join(first, ["sample", "cohort_ord"])


def align(weights: DataFrame) -> DataFrame:
    """All signatures over the union of features, gaps as 0."""
    every = weights.select("feature").distinct().crossJoin(weights.select("signature").distinct())
    return every.join(weights, ["feature", "signature"], "left").select("feature", "signature", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def sparsity(value: Column, cells: Column) -> Column:
    """Share of cells that are 0, absent ones included."""
    return 1 - F.count_if(value != 0) / cells
