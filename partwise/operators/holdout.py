"""Block-holdout cross-validation: seeded permutations, blocks, folds, closed forms and grouped kernels."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.kernels import nmf, small
from partwise.session import cut


def positions(x: DataFrame, axis: str, shuffles: int, seed: int = 0) -> DataFrame:
    """``(shuffle, axis, pos)``: a permutation for each shuffle, by the digest of seed, shuffle and label."""
    labels = x.select(axis).distinct().crossJoin(x.sparkSession.range(shuffles).select(F.col("id").cast("int").alias("shuffle")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("shuffle").cast("string"), F.col(axis)))
    return labels.withColumn("pos", F.row_number().over(Window.partitionBy("shuffle").orderBy(key, axis)) - 1)


def blocked(placed: DataFrame, blocks: int, name: str) -> DataFrame:
    """Add the block of each position; what doesn't divide evenly goes to the last block."""
    n = F.count("*").over(Window.partitionBy("shuffle"))
    return placed.withColumn(name, F.least(F.floor(F.col("pos") / F.floor(n / blocks)), F.lit(blocks - 1)).cast("int"))


def split(x: DataFrame, shuffles: int, design: tuple[int, int] = (3, 3), seed: int = 0) -> DataFrame:
    """Cells with ``shuffle, row_block, col_block``; permutations are small tables beside the matrix, never copies of it.  ``ValueError`` if an axis has fewer labels than blocks."""
    size = x.agg(F.count_distinct("feature").alias("m"), F.count_distinct("sample").alias("n")).first()
    if size["m"] < design[0] or size["n"] < design[1]:
        raise ValueError(f"{size['m']} x {size['n']} labels can't be cut into {design[0]} x {design[1]} blocks")
    rows = blocked(positions(x, "feature", shuffles, seed), design[0], "row_block").select("shuffle", "feature", "row_block")
    cols = blocked(positions(x, "sample", shuffles, seed), design[1], "col_block").select("shuffle", "sample", "col_block")
    return x.join(rows, "feature").join(cols, ["shuffle", "sample"])


def validate_split(cells: DataFrame, design: tuple[int, int] = (3, 3)) -> DataFrame:
    """The cells; ``ValueError`` unless each shuffle has every block and its blocks' labels agree: one row block a feature, one column block a sample."""
    shape = cells.groupBy("shuffle").agg(F.count_distinct("row_block", "col_block").alias("blocks"))
    if (bad := shape.where(F.col("blocks") != design[0] * design[1]).first()) is not None:
        raise ValueError(f"shuffle {bad['shuffle']} has {bad['blocks']} blocks of {design[0] * design[1]}")
    for axis, block in (("feature", "row_block"), ("sample", "col_block")):
        of = cells.groupBy("shuffle", axis).agg(F.count_distinct(block).alias("n")).where("n > 1").first()
        if of is not None:
            raise ValueError(f"{axis} {of[axis]} is in {of['n']} blocks of shuffle {of['shuffle']}")
    return cells


def evenness(cells: DataFrame) -> DataFrame:
    """``(shuffle, row_block, col_block, features, samples)``: the sizes of blocks, the last ones larger where labels don't divide evenly."""
    return cells.groupBy("shuffle", "row_block", "col_block").agg(F.count_distinct("feature").alias("features"), F.count_distinct("sample").alias("samples"))


def part(row_fold: Column, col_fold: Column) -> Column:
    """A: held out in both; B: in rows; C: in columns; D: in neither."""
    r, c = F.col("row_block") == row_fold, F.col("col_block") == col_fold
    return F.when(r & c, "A").when(r, "B").when(c, "C").otherwise("D")


def folds(cells: DataFrame, design: tuple[int, int] = (3, 3)) -> DataFrame:
    """Every cell in every fold, with its ``part``; fold i is block (i div columns, i mod columns)."""
    every = cells.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(design[0] * design[1] - 1))))
    return every.withColumn("part", part(F.floor(F.col("fold") / design[1]), F.col("fold") % design[1]))


def rank_one(parts: DataFrame) -> DataFrame:
    """Closed form of the rank-1 Kullback-Leibler holdout: prediction = row total of B x column total of C / total of D."""
    rows = parts.where("part = 'B'").groupBy("shuffle", "fold", "feature").agg(F.sum("value").alias("b"))
    cols = parts.where("part = 'C'").groupBy("shuffle", "fold", "sample").agg(F.sum("value").alias("c"))
    rest = parts.where("part = 'D'").groupBy("shuffle", "fold").agg(F.sum("value").alias("d"))
    a = parts.where("part = 'A'").join(rows, ["shuffle", "fold", "feature"]).join(cols, ["shuffle", "fold", "sample"]).join(rest, ["shuffle", "fold"])
    return a.select("shuffle", "fold", "feature", "sample", "value", F.when(F.col("d") > 0, F.col("b") * F.col("c") / F.col("d")).alias("fitted"))


RESULT = "shuffle int, fold int, rank int, alpha double, r_squared double, rss double, cosine_similarity double, l2_norm double, reconstruction_error double, sparsity_w double, sparsity_h double"


#: Cells of a matrix that a task may hold.
MOST_CELLS = 50_000_000


def dense_matrix(x: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Features, samples and the dense matrix; ``ValueError`` beyond ``MOST_CELLS`` cells."""
    size = x.agg(F.count_distinct("feature").alias("m"), F.count_distinct("sample").alias("n")).first()
    if size["m"] * size["n"] > MOST_CELLS:
        raise ValueError(f"a matrix of {size['m']} x {size['n']} is too large for a task")
    m = x.select("feature", "sample", "value").toPandas().pivot(index="feature", columns="sample", values="value").fillna(0.0).sort_index().sort_index(axis=1)
    return m.index.tolist(), m.columns.tolist(), m.to_numpy(float)


def cross_validate(cells: DataFrame, ranks: list[int], alphas: list[float] = (0.0,), design: tuple[int, int] = (3, 3), seed: int = 0, **options) -> DataFrame:
    """Measures of every (shuffle, fold, rank, alpha).

    The matrix, of checked size, is broadcast once; what is dealt out is a list of tasks, largest ranks
    first: a (shuffle, fold, rank) with the blocks of the shuffle's labels, of which each runs its alphas.
    """
    spark = cells.sparkSession
    # Read several times from here on.
    cells = cut(cells)
    lowest = cells.agg(F.min("shuffle")).first()[0]
    features, samples, m = dense_matrix(cells.where(F.col("shuffle") == lowest))
    sent = spark.sparkContext.broadcast((pd.Series(range(len(features)), index=features), pd.Series(range(len(samples)), index=samples), m))
    rows = cells.select("shuffle", "feature", "row_block").distinct().groupBy("shuffle").agg(F.collect_list("feature").alias("f"), F.collect_list("row_block").alias("fb"))
    cols = cells.select("shuffle", "sample", "col_block").distinct().groupBy("shuffle").agg(F.collect_list("sample").alias("s"), F.collect_list("col_block").alias("sb"))
    n_cols = design[1]
    n_folds = design[0] * n_cols
    listed = [(int(r), fold) for r in sorted(ranks, reverse=True) for fold in range(n_folds)]
    tasks = rows.join(cols, "shuffle").crossJoin(F.broadcast(spark.createDataFrame(listed, "rank int, fold int")))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        at_f, at_s, m = sent.value
        for block in blocks:
            out = []
            for t in block.itertuples():
                r, c = np.zeros(len(at_f), bool), np.zeros(len(at_s), bool)
                r[at_f[list(t.f)].to_numpy()[np.asarray(t.fb) == t.fold // n_cols]] = True
                c[at_s[list(t.s)].to_numpy()[np.asarray(t.sb) == t.fold % n_cols]] = True
                for alpha in alphas:
                    a = m[np.ix_(r, c)]
                    own = hash((seed, int(t.shuffle), int(t.fold), int(t.rank))) % 2**32
                    y, w, h = nmf.holdout(a, m[np.ix_(r, ~c)], m[np.ix_(~r, c)], m[np.ix_(~r, ~c)], int(t.rank), seed=own, alpha_p=alpha, alpha_q=alpha, **options)
                    got = nmf.measures(a, y)
                    out.append({"shuffle": t.shuffle, "fold": t.fold, "rank": t.rank, "alpha": alpha, **got, "sparsity_w": float((w == 0).mean()), "sparsity_h": float((h == 0).mean())})
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    many = max(1, min(len(listed) * max(1, rows.count()), 10_000))
    return tasks.repartition(many, "shuffle", "rank", "fold").mapInPandas(run, RESULT)


MEASURES = ("r_squared", "rss", "cosine_similarity", "l2_norm", "reconstruction_error", "sparsity_w", "sparsity_h")


def summary(results: DataFrame, summarise: str | Callable[[np.ndarray], float] = "mean") -> DataFrame:
    """One row a (rank, alpha, shuffle): each measure over the folds, by ``mean``, ``median``, ``min``, ``max``, or a function of an array."""
    named = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    if callable(summarise):

        def each(values: pd.Series) -> float:
            return float(summarise(values.to_numpy()))

        each.__annotations__ = {"values": pd.Series, "return": float}
        made = F.pandas_udf(each, "double")
    else:
        made = named[summarise]
    return results.groupBy("rank", "alpha", "shuffle").agg(*[made(n).alias(n) for n in MEASURES])


def joined_folds(results: DataFrame) -> DataFrame:
    """One row a (rank, alpha, shuffle) with each measure's folds in order as an array; ``ValueError`` if a fold is there twice."""
    twice = results.groupBy("rank", "alpha", "shuffle", "fold").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"fold {twice['fold']} of shuffle {twice['shuffle']} comes {twice['count']} times: results of different parameters?")
    in_order = lambda n: F.transform(F.sort_array(F.collect_list(F.struct("fold", n))), lambda x: x[n]).alias(n)
    lists = [in_order(n) for n in MEASURES]
    return results.groupBy("rank", "alpha", "shuffle").agg(*lists, F.count("*").cast("int").alias("n_folds"))


def uneven(results: DataFrame, by: str = "rank") -> DataFrame:
    """``(rank, n)`` of ranks that have fewer results than the most that one has: lost tasks."""
    sizes = results.groupBy(by).agg(F.count("*").alias("n"))
    return sizes.crossJoin(sizes.agg(F.max("n").alias("most"))).where("n < most").drop("most")


def curves(table: DataFrame, measures: Sequence[str] = ("cosine_similarity", "r_squared"), by: str = "rank") -> DataFrame:
    """``(measure, rank, value)``: medians over shuffles, stacked."""
    medians = table.groupBy(by).agg(*[F.median(m).alias(m) for m in measures])
    return medians.unpivot([by], list(measures), "measure", "value")


def _on_curve(curve: DataFrame, find: Callable[[np.ndarray, np.ndarray], float | None]) -> DataFrame:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        at = find(block["rank"].to_numpy(), block["value"].to_numpy(float))
        return pd.DataFrame({"measure": [block["measure"].iloc[0]], "suggested": pd.array([None if at is None else int(at)], "Int64")})

    return curve.where("value is not null").groupBy("measure").applyInPandas(run, "measure string, suggested long")


def suggest_rank(table: DataFrame, measures: Sequence[str] = ("cosine_similarity", "r_squared"), sensitivity: float = 1.0) -> DataFrame:
    """``(measure, suggested)``: the knee of each measure's curve over ranks, null where it has none.  ``table`` has a row a (rank, shuffle)."""
    return _on_curve(curves(table, measures), lambda x, y: small.knee(x, y, sensitivity))


def without_rank_one(curve: DataFrame) -> DataFrame:
    """Stability at rank 1 is always perfect and says nothing."""
    return curve.where("rank <> 1")


def suggest_rank_stability(curve: DataFrame, near: float = 0.02) -> DataFrame:
    """``(measure, suggested)`` from ``(measure, rank, value)``: of the near-highest local maxima the one before the longest fall; rank 1 takes no part."""
    return _on_curve(without_rank_one(curve), lambda r, v: small.peak(r, v, near))


def rank_curve(table: DataFrame, measure: str = "cosine_similarity") -> DataFrame:
    """Median over shuffles for each rank."""
    return table.groupBy("rank").agg(F.median(measure).alias(measure))


def best_alpha(results: DataFrame) -> DataFrame:
    """Largest alpha such that it and all smaller ones keep mean R2 within one standard deviation of alpha 0.  A null mean passes."""
    means = results.groupBy("alpha").agg(F.avg("r_squared").alias("mean_r2"), F.stddev_pop("r_squared").alias("sd"))
    zero = means.where("alpha = 0").select((F.col("mean_r2") - F.col("sd")).alias("bar"))
    fine = means.crossJoin(zero).withColumn("ok", F.coalesce(F.col("mean_r2") >= F.col("bar"), F.lit(True)).cast("int"))
    run = F.min("ok").over(Window.orderBy("alpha").rowsBetween(Window.unboundedPreceding, 0))
    return fine.withColumn("run", run).where("run = 1").agg(F.max("alpha").alias("best_alpha"))
