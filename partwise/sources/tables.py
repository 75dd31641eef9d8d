"""Reading and writing matrices, folds and models; synthetic matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwise.operators.matrix import long, share, wide


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table, features in the first column and samples in the header, as a long matrix; gzip is read as it is."""
    table = spark.read.option("sep", sep).option("header", True).csv(path)
    key = table.columns[0]
    return long(table.withColumnRenamed(key, "feature"))


def write_delimited(x: DataFrame, path: str, sep: str = "\t") -> None:
    """A long matrix as a wide delimited table in a new folder."""
    samples = [r["sample"] for r in x.select("sample").distinct().orderBy("sample").limit(10_001).collect()]
    if len(samples) > 10_000:
        raise ValueError("a wide table of more than 10,000 samples isn't written; write the long one")
    wide(x, samples).write.option("sep", sep).option("header", True).csv(path)


def save_folds(cells: DataFrame, path: str, overwrite: bool = False) -> None:
    """Blocked cells by shuffle; an existing folder is an error unless it may be overwritten."""
    cells.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("shuffle").parquet(path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    """Blocked cells of all shuffles."""
    return spark.read.parquet(path)


def renumbered(cells: DataFrame) -> DataFrame:
    """Shuffles numbered from 0 without gaps, in their order."""
    order = cells.select("shuffle").distinct().withColumn("new", (F.row_number().over(Window.orderBy("shuffle")) - 1).cast("int"))
    return cells.join(F.broadcast(order), "shuffle").drop("shuffle").withColumnRenamed("new", "shuffle").select(*cells.columns)


def load_shuffle(spark: SparkSession, path: str, shuffle: int) -> DataFrame:
    """Blocked cells of one shuffle: a single folder is read."""
    return spark.read.parquet(path).where(F.col("shuffle") == shuffle)


def stability_union(spark: SparkSession, paths: list[str], sep: str = "\t") -> DataFrame:
    """Delimited tables of one model each, stacked; their first column is the rank, whatever its name."""
    out = None
    for path in paths:
        one = spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path)
        one = one.withColumnRenamed(one.columns[0], "rank")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def save_models(models: DataFrame, path: str) -> None:
    """Ranked fits, by rank and position."""
    models.write.partitionBy("rank", "position").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Fits that were saved."""
    return spark.read.parquet(path)


def blocks(spark: SparkSession, m: int = 100, n: int = 100, k: int = 3, overlap: float = 0.25, noise: float = 0.1, seed: int = 0, scale: tuple[float, float] | None = None) -> DataFrame:
    """Overlapping diagonal blocks of uniform values with half-normal noise, shares by sample.

    ``scale``, mean and deviation of a logarithm, multiplies each feature by a lognormal
    factor.  The same seed gives the same cells whatever the partitioning.
    """
    u = lambda salt: (F.pmod(F.xxhash64("i", "j", F.lit(seed), F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
    cells = spark.range(m).select(F.col("id").alias("i")).crossJoin(spark.range(n).select(F.col("id").alias("j")))
    height, breadth = m / k, n / k
    inside = F.lit(False)
    for b in range(k):
        row = (F.col("i") >= b * height - overlap * height / 2) & (F.col("i") < (b + 1) * height + overlap * height / 2)
        col = (F.col("j") >= b * breadth) & (F.col("j") < (b + 1) * breadth)
        inside = inside | (row & col)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    value = F.when(inside, u(0)).otherwise(0.0) + F.abs(normal) * noise
    if scale is not None:
        own = lambda salt: (F.pmod(F.xxhash64("i", F.lit(seed), F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
        value = value * F.exp(scale[0] + scale[1] * F.sqrt(-2 * F.log(own(3))) * F.cos(2 * 3.141592653589793 * own(4)))
    named = cells.select(F.format_string("feat_%03d", "i").alias("feature"), F.format_string("samp_%03d", "j").alias("sample"), value.alias("value"))
    return share(named, "sample")


def related_cohorts(w: DataFrame, samples: Sequence[int] = (100, 200, 150, 100, 200, 200), noise: float = 0.01, seed: int = 0) -> DataFrame:
    """``(cohort, feature, sample, value)``: six cohorts of a base model, as it is twice, without its last signature, with one that is new, with one whose features are dealt anew, and with its first two merged."""
    spark = w.sparkSession
    names = [r["signature"] for r in w.select("signature", "sig_ord").distinct().orderBy("sig_ord").collect()]
    u = lambda salt, *by: (F.pmod(F.xxhash64(*by, F.lit(seed), F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
    base = w.select("feature", "signature", "weight")
    new = share(w.select("feature").distinct().select("feature", F.lit("new").alias("signature"), F.pow(u(1, "feature"), 4).alias("weight")), "signature", "weight")
    one = base.where(F.col("signature") == names[0])
    old = one.select("weight", F.row_number().over(Window.orderBy("feature")).alias("r"))
    moved = one.select("feature", F.row_number().over(Window.orderBy(u(2, "feature"))).alias("r")).join(old, "r").select("feature", F.lit("moved").alias("signature"), "weight")
    pair = base.where(F.col("signature").isin(names[:2])).groupBy("feature").agg(F.avg("weight").alias("weight")).select("feature", F.lit("merged").alias("signature"), "weight")
    rest = lambda *gone: base.where(~F.col("signature").isin(*gone))
    models = [base, base, rest(names[-1]), base.unionByName(new), rest(names[0]).unionByName(moved), rest(*names[:2]).unionByName(pair)]
    out = None
    for c, (model, n) in enumerate(zip(models, samples, strict=True)):
        h = spark.range(n).select(F.col("id").alias("j")).crossJoin(model.select("signature").distinct()).withColumn("b", -F.log(u(3, "j", "signature", F.lit(c))))
        cells = model.join(h, "signature").groupBy("feature", "j").agg(F.sum(F.col("weight") * F.col("b")).alias("y"))
        value = F.greatest(F.col("y") + noise * (u(4, "feature", "j", F.lit(c)) - 0.5), F.lit(0.0))
        one = share(cells.select("feature", F.format_string(f"c{c}_%04d", "j").alias("sample"), value.alias("value")), "sample").withColumn("cohort", F.lit(f"cohort_{c}"))
        out = one if out is None else out.unionByName(one)
    return out


def dense(spark: SparkSession, m: int = 100, n: int = 100, k: int = 3, h_sparsity: float = 0.5, shared: float = 0.25, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """Masked random weights times sparse random sample weights, with noise, at least 0."""
    u = lambda a, b, salt: (F.pmod(F.xxhash64(a, b, F.lit(seed), F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)
    axis = lambda size, name: spark.range(size).select(F.col("id").alias(name))
    w = axis(m, "i").crossJoin(axis(k, "s")).withColumn("own", (F.col("i") * k / m).cast("int") == F.col("s"))
    w = w.select("i", "s", F.when(F.col("own") | (u("i", "s", 3) < shared), u("i", "s", 4)).otherwise(0.0).alias("a"))
    h = axis(n, "j").crossJoin(axis(k, "s")).select("j", "s", F.when(u("j", "s", 5) >= h_sparsity, u("j", "s", 6)).otherwise(0.0).alias("b"))
    cells = w.join(h, "s").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("y"))
    value = F.greatest(F.col("y") + noise * (2 * u("i", "j", 7) - 1), F.lit(0.0))
    return cells.select(F.format_string("feat_%03d", "i").alias("feature"), F.format_string("samp_%03d", "j").alias("sample"), value.alias("value"))
