"""Commands end to end on a small table."""

from __future__ import annotations

import pytest

from partwise import cli
from partwise.sources import tables


def test_commands(spark, tmp_path):
    tables.write_delimited(tables.blocks(spark, 9, 9, 2), str(tmp_path / "x"))
    base = ["-i", str(tmp_path / "x"), "--max-iter", "50"]
    ranks = cli.run(spark, cli.parser().parse_args(["rank-select", *base, "-o", str(tmp_path / "r"), "-r", "1", "2", "-n", "2"]))
    assert ranks.count() == 4
    fits = cli.run(spark, cli.parser().parse_args(["decompose", *base, "-o", str(tmp_path / "d"), "-r", "2", "--starts", "3", "--top", "2"]))
    assert sorted(r["position"] for r in fits.collect()) == [1, 2]
    with pytest.raises(ValueError):
        cli.run(spark, cli.parser().parse_args(["rank-select", *base, "-o", str(tmp_path / "e"), "-r", "2"]))


def test_reapply_command(spark, tmp_path):
    from partwise.sources import models

    tables.write_delimited(tables.blocks(spark, 9, 9, 2), str(tmp_path / "x"))
    w = spark.createDataFrame([(f"feat_{i:03d}", f"sig{j}", float(1 + (i + j) % 3)) for i in range(8) for j in range(2)], "feature string, sample string, value double")
    tables.write_delimited(w, str(tmp_path / "w"))
    base = ["reapply", "-i", str(tmp_path / "x"), "-w", str(tmp_path / "w"), "--max-iter", "50", "-o", str(tmp_path / "h")]
    got = cli.run(spark, cli.parser().parse_args(base))
    assert got.count() == 18 and models.read_json(spark, str(tmp_path / "h-parameters"))["match"] == "identical"
    report = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "h-report")).first()
    assert report["unknown_features"] == "1"
    with pytest.raises(FileExistsError):
        cli.run(spark, cli.parser().parse_args(base))


def test_label_functions(spark):
    from pyspark.sql import functions as F

    from partwise.functions import labels

    row = spark.createDataFrame([("ALL_19769_B-cell", "out/fold_12.npz", 0.00123, -4.0)], "s string, f string, x double, y double")
    got = row.select(labels.leukaemia_class(F.col("s")), labels.numbered(F.col("f")), labels.scientific(F.col("x")), labels.signed_log(F.col("y"))).first()
    assert tuple(got) == ("ALL B", 12, "1.23e-03", 0.0)
    with pytest.raises(Exception, match="no class"):
        row.select(labels.leukaemia_class(F.lit("other"))).collect()
