"""Registered queries against their SQL, on the smallest data, and the reference cases of single operators."""

from __future__ import annotations

import math

import duckdb
import pytest

from partwise import registry
from partwise.operators import analysis, mapping, matrix, models, stats
from partwise.plans import inputs, queries
from partwise.sources import tables
from tests.conftest import SF

NAMES = "region nation customer supplier part orders lineitem events embeddings".split()
CHEAP = ["matrix_validate", "tss", "scale_h_sample", "quality_series", "representative", "monodominant", "map_w", "lineage_clean", "split_blocks", "bicv_rank1_table", "transform_fixed_w", "dispersion_ref", "dunn_z", "bh_adjust", "signif_format", "regu_alpha_scan", "bray_curtis"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    return sorted([tuple(tidy(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["matrix_pivot_whole", "matrix_unpivot_whole", "mann_whitney_parity"])
def test_whole_matrices_against_sql(spark, sf_dir, duck, name):
    test_against_sql(spark, sf_dir, duck, name)


def test_no_sample_is_left_out(spark, sf_dir):
    whole = registry.queries()["matrix_build_m1"](spark, sf_dir)
    samples = {r["sample"] for r in whole.select("sample").distinct().collect()}
    assert len(samples) == 25 and set(registry.queries()["matrix_pivot_whole"](spark, sf_dir).columns) == samples | {"feature"}
    assert registry.queries()["matrix_unpivot_whole"](spark, sf_dir).count() == whole.count()


def test_validate_rejects(spark):
    for rows in ([("a", "x", 1.0), ("b", "x", 1.0)], [("a", "x", 1.0), ("b", "y", -1.0)], [("a", "x", 1.0), ("b", "y", float("nan"))]):
        with pytest.raises(ValueError):
            matrix.validate(spark.createDataFrame(rows, "feature string, sample string, value double"))


def test_scaling_falls_back_and_rejects(spark):
    h = spark.createDataFrame([("s", "a", 1, 3.0), ("s", "b", 2, 1.0), ("t", "a", 1, 0.0), ("t", "b", 2, 0.0)], "sample string, signature string, sig_ord int, weight double")
    got = {(r["sample"], r["signature"]): r["weight"] for r in matrix.scaled(h, "h", "feature").collect()}
    assert got == {("s", "a"): 0.75, ("s", "b"): 0.25, ("t", "a"): None, ("t", "b"): None}
    with pytest.raises(ValueError):
        matrix.scaled(h, "x")


def test_primary_ties_and_zeros(spark):
    h = spark.createDataFrame([("s", "a", 1, 1.0), ("s", "b", 2, 1.0), ("t", "a", 1, 0.0)], "sample string, signature string, sig_ord int, weight double")
    assert {r["sample"]: r["primary_signature"] for r in analysis.primary(h).collect()} == {"s": "a", "t": None}


def test_mapping_toy(spark):
    x = spark.createDataFrame([("A", "1", 1.0), ("B", "1", 2.0), ("C", "1", 4.0), ("N", "1", 8.0)], "feature string, sample string, value double")
    m = spark.createDataFrame([("B", "B", 1), ("C", "B", 1)], "input_feature string, model_feature string, priority int")
    got = mapping.map_abundance(x, m)
    assert {r["feature"]: r["value"] for r in got.collect()} == {"A": 1.0, "B": 6.0, "N": 8.0}
    w = spark.createDataFrame([("A", "S1", 1, 0.5), ("D", "S1", 1, 0.5)], "feature string, signature string, sig_ord int, weight double")
    assert {r["feature"]: r["weight"] for r in mapping.map_weights(w, got).collect()} == {"A": 0.5, "B": 0.0, "N": 0.0}


def test_lineage_rules(spark):
    rows = registry.queries()["match_genera_rules"](spark, "").collect()
    got = {r["input_feature"]: (r["model_feature"], r["rule"]) for r in rows}
    assert got["B;X;Y;Z;F1;Gen"][1] == "identical"
    assert got["B;X;Y;Z;F1;Gen_A"] == ("B;X;Y;Z;F1;Gen", "split_genus")
    assert got["A;Q;;;;Other"] == ("C;Q;;;;Other", "final_rank")
    assert got["B;X;Y;Z;F2;New"] == ("B;X;Y;Z;F2;", "family")


def test_own_matrix_gives_back_its_weights(spark):
    fits = models.decompose(tables.blocks(spark, 30, 20, 3, noise=0.02), [3], 2, max_iter=500)
    best = analysis.top_models(fits, "rss", 1)
    w = models.weights_of(best).drop("model_id")
    h = {(r["sample"], r["signature"]): r["weight"] for r in models.sample_weights_of(best).collect()}
    got = models.transform(tables.blocks(spark, 30, 20, 3, noise=0.02), w, 500).collect()
    assert len(got) == len(h) == 60
    assert max(abs(r["weight"] - h[r["sample"], r["signature"]]) for r in got) < 0.025


def test_planted_groups_are_significant(spark):
    v = spark.createDataFrame([("t", "a" if i < 10 else "b", float(i)) for i in range(20)], "test string, grp string, value double")
    k = stats.kruskal(stats.average_ranks(v, ["test"]), ["test"]).select(stats.chi2_tail("h", "df").alias("p")).first()
    assert k["p"] < 0.001


def test_round_trips(spark, tmp_path):
    x = tables.blocks(spark, 6, 5, 2)
    tables.write_delimited(x, str(tmp_path / "x"))
    back = tables.read_delimited(spark, str(tmp_path / "x"))
    want = {(r["feature"], r["sample"]): r["value"] for r in x.collect()}
    got = {(r["feature"], r["sample"]): r["value"] for r in back.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_values_that_are_all_one(spark):
    v = spark.createDataFrame([("t", "a" if i < 3 else "b", 0.04) for i in range(7)], "test string, grp string, value double")
    ranked = stats.average_ranks(v, ["test"])
    got = stats.mann_whitney(ranked, ["test"]).first()
    assert (got["u"], got["z"]) == (6.0, -math.inf)
    assert math.isnan(stats.dunn(ranked, ["test"]).first()["z"])
    assert not math.isfinite(stats.kruskal(ranked, ["test"]).first()["h"])


def test_univariate_of_values_that_are_all_one(spark):
    values = spark.createDataFrame([(f"s{i}", "S", 0.04) for i in range(24)], "sample string, signature string, value double")
    md = spark.createDataFrame([(f"s{i}", "three", "a" if i < 9 else "b" if i < 16 else "c") for i in range(24)] + [(f"s{i}", "two", "a" if i < 13 else "b") for i in range(24)], "sample string, md string, grp string")
    got = {r["md"]: r for r in stats.univariate(values, md).collect()}
    assert math.isnan(got["three"]["p"]) and (got["three"]["max_mean"], got["three"]["posthoc_str"]) == ("c", "")
    assert got["two"]["p"] == 1.0 and (got["two"]["max_mean"], got["two"]["max_median"]) == ("b", "b")
    assert all(r["local_adj_p"] == r["global_adj_p"] == 1.0 and not r["global_reject"] for r in got.values())


def test_lines_are_joined_once_a_query(spark, sf_dir):
    inputs.forget()
    one = queries.signatures(spark, sf_dir).unionByName(queries.signatures(spark, sf_dir))
    assert not [f for f in one.inputFiles() if "lineitem" in f or "orders" in f]
    assert one.count() == 2 * 25 * 10
    inputs.forget()


def test_lineages_are_summed_once(spark, sf_dir):
    got = registry.queries()["lineage_stripped"](spark, sf_dir)
    assert got.count() > 0 and not [f for f in got.inputFiles() if "lineitem" in f]
