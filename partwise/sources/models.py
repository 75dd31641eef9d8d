"""Whole models on disk: factors, the tables derived from them, the matrix, parameters and properties.

A model is a folder with a Parquet table under each name in ``TABLES`` and two
JSON documents, so it can live wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import tarfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators import analysis, matrix, measures

#: Tables that a model can't be without.
REQUIRED = ("w", "h")
TABLES = (*REQUIRED, "x", "feature_mapping", "w_scaled", "h_scaled", "model_fit", "quality_series", "primary_signature", "representative_signatures", "monodominant_samples")
#: Signatures' colours: the first eight, then twelve more, then again from the start.  Fixed values, from public colour-blind-safe palettes.
PALETTE = ("#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7", "#999999")
WIDE_PALETTE = (*PALETTE, "#332288", "#88CCEE", "#44AA99", "#117733", "#999933", "#DDCC77", "#CC6677", "#882255", "#AA4499", "#661100", "#6699CC", "#888888")


def default_colors(k: int) -> list[str]:
    """One colour a signature."""
    palette = PALETTE if k <= len(PALETTE) else WIDE_PALETTE
    return [palette[i % len(palette)] for i in range(k)]


@dataclass
class Model:
    """Factors ``w`` and ``h`` of a matrix ``x``, with parameters and the signatures' names and colours."""

    w: DataFrame
    h: DataFrame
    x: DataFrame | None = None
    parameters: dict = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    colors: list[str] = field(default_factory=list)
    feature_mapping: DataFrame | None = None

    def __post_init__(self) -> None:
        if not self.names:
            rows = self.w.select("sig_ord", "signature").distinct().orderBy("sig_ord").collect()
            self.names = [r["signature"] for r in rows]
        self.recolor(self.colors or default_colors(len(self.names)))

    def renamed(self, names: list[str]) -> Model:
        """The same model with other names, in order; as many as there are signatures, none twice."""
        if len(names) != len(self.names) or len(set(names)) != len(names):
            raise ValueError(f"{len(self.names)} different names are needed")
        to = F.create_map(*[F.lit(s) for pair in zip(self.names, names, strict=True) for s in pair])
        change = lambda t: t.withColumn("signature", to[F.col("signature")])
        return Model(change(self.w), change(self.h), self.x, dict(self.parameters), list(names), list(self.colors), self.feature_mapping)

    def recolor(self, colors: list[str] | dict[str, str]) -> None:
        """Set colours, in order or by name; a list that is too short and names that don't exist are errors."""
        if isinstance(colors, dict):
            if extra := set(colors) - set(self.names):
                raise ValueError(f"no signatures {sorted(extra)}")
            old = self.colors or default_colors(len(self.names))
            self.colors = [colors.get(n, c) for n, c in zip(self.names, old, strict=True)]
            return
        if len(colors) < len(self.names):
            raise ValueError(f"{len(self.names)} colours are needed")
        self.colors = list(colors[: len(self.names)])

    def color_scale(self) -> dict[str, str]:
        """Colours by name."""
        return dict(zip(self.names, self.colors, strict=True))

    def palette(self) -> DataFrame:
        """``(sig_ord, signature, color)``."""
        rows = [(i + 1, n, c) for i, (n, c) in enumerate(zip(self.names, self.colors, strict=True))]
        return self.w.sparkSession.createDataFrame(rows, "sig_ord int, signature string, color string")

    def derived(self) -> dict[str, DataFrame]:
        """Every table that follows from the factors, by name."""
        shares = matrix.scaled(self.h, "h")
        out = {"w": self.w, "h": self.h, "w_scaled": matrix.scaled(self.w, "w"), "h_scaled": shares}
        out |= {"primary_signature": analysis.primary(self.h), "representative_signatures": analysis.representative(shares), "monodominant_samples": analysis.monodominant(shares)}
        if self.x is not None:
            pairs = measures.paired(self.x, matrix.product(self.w, self.h))
            out |= {"x": self.x, "model_fit": measures.model_fit(pairs), "quality_series": measures.quality(pairs, self.w, self.h)}
        if self.feature_mapping is not None:
            out["feature_mapping"] = self.feature_mapping
        return out


def digest(x: DataFrame) -> DataFrame:
    """One row: a SHA-256 that depends on a matrix's cells and not on their order."""
    cell = F.sha2(F.concat_ws("\x1f", "feature", "sample", F.col("value").cast("string")), 256)
    # Four sums of parts of the cells' digests: no cell is gathered, and the order doesn't matter.
    word = lambda k: F.conv(F.substring(cell, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    sums = x.agg(*[F.sum(word(k)).alias(f"s{k}") for k in range(4)], F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws("|", "s0", "s1", "s2", "s3", "n"), 256).alias("input_hash"))


def write_json(spark: SparkSession, what: dict, folder: str) -> None:
    spark.createDataFrame([(json.dumps(what, sort_keys=True),)], "value string").coalesce(1).write.text(folder)


def read_json(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first()["value"])


def there(spark: SparkSession, folder: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def save(model: Model, folder: str, with_x: bool = True, archive: bool = False) -> str:
    """Write a model into a new folder; with ``archive`` also as ``folder.tar.gz``, for folders of this machine.  Gives the path."""
    spark = model.w.sparkSession
    for name, table in model.derived().items():
        if with_x or name != "x":
            table.write.parquet(f"{folder}/{name}")
    write_json(spark, model.parameters, f"{folder}/parameters")
    write_json(spark, {"names": model.names, "colors": model.colors}, f"{folder}/properties")
    if not archive:
        return folder
    with tarfile.open(f"{folder}.tar.gz", "w:gz") as out:
        out.add(folder, arcname=Path(folder).name)
    return f"{folder}.tar.gz"


def load(spark: SparkSession, folder: str, x: DataFrame | None = None) -> Model:
    """A saved model; ``x`` stands in for a matrix that wasn't saved.  ``FileNotFoundError`` names the tables that are lacking.

    An archive is unpacked beside itself.
    """
    if folder.endswith(".tar.gz"):
        with tarfile.open(folder) as packed:
            packed.extractall(Path(folder).parent, filter="data")
        folder = folder.removesuffix(".tar.gz")
    if lacking := [n for n in (*REQUIRED, "parameters", "properties") if not there(spark, f"{folder}/{n}")]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(lacking)}")
    table = lambda n: spark.read.parquet(f"{folder}/{n}") if there(spark, f"{folder}/{n}") else None
    known = read_json(spark, f"{folder}/properties")
    return Model(table("w"), table("h"), x if x is not None else table("x"), read_json(spark, f"{folder}/parameters"), known["names"], known["colors"], table("feature_mapping"))


def save_many(models: dict[int, list[Model]], folder: str) -> None:
    """Models by rank, best first, as ``folder/rank/position``, and their common matrix once; the folder must not exist."""
    first = next(m for own in models.values() for m in own)
    spark = first.w.sparkSession
    if there(spark, folder):
        raise FileExistsError(folder)
    if first.x is not None:
        first.x.write.parquet(f"{folder}/x")
    listed = {str(rank): len(own) for rank, own in models.items()}
    for rank, own in models.items():
        for place, model in enumerate(own):
            save(model, f"{folder}/{rank}/{place}", with_x=False)
    write_json(spark, listed, f"{folder}/ranks")


def load_many(spark: SparkSession, folder: str) -> dict[int, list[Model]]:
    """What ``save_many`` wrote, ranks ascending; all share one matrix."""
    x = spark.read.parquet(f"{folder}/x") if there(spark, f"{folder}/x") else None
    listed = read_json(spark, f"{folder}/ranks")
    return {rank: [load(spark, f"{folder}/{rank}/{k}", x) for k in range(listed[str(rank)])] for rank in sorted(map(int, listed))}


def of_fits(fits: DataFrame, x: DataFrame | None = None) -> dict[int, list[Model]]:
    """Ranked fits (``position`` 1 is the best) as models by rank; one row a fit is looked at."""
    from partwise.operators.models import sample_weights_of, weights_of

    out: dict[int, list[Model]] = {}
    for r in fits.select("rank", "position", "model_id", "seed").orderBy("rank", "position").collect():
        own = fits.where(F.col("model_id") == r["model_id"])
        out.setdefault(r["rank"], []).append(Model(weights_of(own).drop("model_id"), sample_weights_of(own).drop("model_id"), x, {"rank": r["rank"], "seed": r["seed"]}))
    return out


def load_example(spark: SparkSession, path: str, row_metadata: str | None = None, col_metadata: str | None = None, sep: str = "\t", **about) -> dict:
    """A packaged data set: its matrix, what is known of rows and columns, and a description."""
    from partwise.sources.tables import read_delimited

    read = lambda p: spark.read.option("sep", sep).option("header", True).csv(p) if p else None
    return {"data": read_delimited(spark, path, sep), "row_metadata": read(row_metadata), "col_metadata": read(col_metadata), **about}
