"""Saving, renaming, reapplying, slicing, tests between groups, combining: what SQL can't hold."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partwise.kernels import nmf, small
from partwise.operators import combining, holdout, mapping, matrix, models, ordination, plots, reapply, stats
from partwise.plans import inputs
from partwise.sources import models as store
from partwise.sources import tables
from partwise.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def x(spark):
    from partwise.session import cut

    return cut(tables.blocks(spark, 30, 24, 3, noise=0.02))


@pytest.fixture(scope="module")
def fits(spark, x):
    from partwise.operators import analysis
    from partwise.session import cut

    return cut(analysis.top_models(models.decompose(x, [2, 3], 3, max_iter=300), "beta_divergence", 2))


def rows(df, *order):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*(order or df.columns)).collect())


def test_models_come_back_as_they_were(spark, x, fits, tmp_path):
    made = store.of_fits(fits, x)
    folder = str(tmp_path / "many")
    store.save_many(made, folder)
    with pytest.raises(FileExistsError):
        store.save_many(made, folder)
    back = store.load_many(spark, folder)
    assert {k: len(v) for k, v in back.items()} == {2: 2, 3: 2}
    one, other = made[3][0], back[3][0]
    assert other.parameters == one.parameters and other.names == one.names and other.colors == one.colors
    mine, theirs = one.derived(), other.derived()
    assert mine.keys() == theirs.keys() and all(rows(mine[k], *mine[k].columns) == rows(theirs[k], *mine[k].columns) for k in mine)


def test_one_model_archive_and_lacking_tables(spark, x, fits, tmp_path):
    model = store.of_fits(fits, x)[2][0]
    path = store.save(model, str(tmp_path / "m"), with_x=False, archive=True)
    back = store.load(spark, path, x)
    assert rows(back.w, "feature", "signature", "weight") == rows(model.w, "feature", "signature", "weight") and back.x is x
    (tmp_path / "bad").mkdir()
    with pytest.raises(FileNotFoundError, match="w, h"):
        store.load(spark, str(tmp_path / "bad"))


def test_names_and_colours(fits, x):
    model = store.of_fits(fits, x)[3][0]
    assert model.renamed(["a", "b", "c"]).h.select("signature").distinct().count() == 3
    for names in (["a", "b"], ["a", "a", "b"]):
        with pytest.raises(ValueError):
            model.renamed(names)
    model.recolor({"S2": "#000000"})
    assert model.colors[1] == "#000000" and model.color_scale()["S2"] == "#000000" and model.palette().count() == 3
    with pytest.raises(ValueError):
        model.recolor(["#fff"])
    with pytest.raises(ValueError):
        model.recolor({"S9": "#fff"})
    assert len(set(store.default_colors(20))) == 20 and len(store.default_colors(45)) == 45


def test_digest_depends_on_cells_alone(x):
    hashed = lambda t: store.digest(t).first()["input_hash"]
    assert hashed(x) == hashed(x.orderBy(F.desc("value")).repartition(3)) != hashed(x.withColumn("value", F.col("value") * 2))


def test_own_data_reapplied_gives_back_the_weights(x, fits):
    model = store.of_fits(fits, x)[3][0]
    signatures = reapply.Signatures(model.w, ["#000000"] * 3)
    got = signatures.reapply(x)
    known = {(r["sample"], r["signature"]): r["weight"] for r in model.h.collect()}
    assert max(abs(r["weight"] - known[r["sample"], r["signature"]]) for r in got.h.collect()) < 0.1
    assert got.report.first()["unknown_features"] == 0 and got.colors == ["#000000"] * 3
    assert got.model_fit().where("model_fit is null").count() == 0


def test_tolerance_stops_samples_one_by_one():
    rng = np.random.default_rng(0)
    dense, h = rng.random((20, 3)), rng.random((3, 7))
    v = dense @ h
    v[:, 6] = 0
    got = nmf.apply_fixed(v, dense, 0.5, 2000, 1e-6)
    assert np.allclose(got[:, :6], h[:, :6], atol=0.05) and np.allclose(got[:, 6], 0, atol=1e-6)
    alone = np.concatenate([nmf.apply_fixed(v[:, [j]], dense, 0.5, 2000, 1e-6) for j in range(7)], axis=1)
    assert np.allclose(alone, got)


def test_lineage_model(spark):
    w = spark.createDataFrame([("B;X;Y;Z;F1;Gen", "S1", 1, 0.6), ("B;X;Y;Z;F2;", "S1", 1, 0.4), ("B;X;Y;Z;F1;Gen", "S2", 2, 0.2), ("B;X;Y;Z;F2;", "S2", 2, 0.8)], "feature string, signature string, sig_ord int, weight double")
    cells = [("k__B;p__X;c__Y;o__Z;f__F1;g__Gen", 6.0), ("k__B;p__X;c__Y;o__Z;f__F2;g__New", 4.0)]
    t = spark.createDataFrame([(f, s, v) for f, v in cells for s in ("a", "b")], "feature string, sample string, value double")
    got = reapply.lineage_model(w).reapply(t)
    assert {(r["input_feature"], r["rule"]) for r in got.feature_mapping.collect()} == {("B;X;Y;Z;F1;Gen", "identical"), ("B;X;Y;Z;F2;New", "family")}
    weights = {(r["sample"], r["signature"]): r["weight"] for r in got.h.collect()}
    assert weights["a", "S1"] == pytest.approx(1, abs=0.05) and weights["b", "S2"] == pytest.approx(0, abs=0.05)
    assert mapping.missing(w, got.feature_mapping).count() == 0


@pytest.mark.parametrize(
    "cells, words",
    [
        ([("a", "x"), ("b", "x")], "two"),
        ([("a", "1"), ("b", "2")], "numbers"),
        ([("A;B;C;D;E;F;x", "s"), ("A;B;C;D;E;F;y", "t")], "one at genus depth"),
    ],
)
def test_bad_lineage_tables(spark, cells, words):
    with pytest.raises(ValueError, match=words):
        mapping.validate_lineages(spark.createDataFrame([(f, s, 1.0) for f, s in cells], "feature string, sample string, value double"))


def test_lineages_on_columns_are_swapped(spark):
    t = spark.createDataFrame([(s, f, 1.0) for s in ("s1", "s2") for f in ("Bacteria;A;;;;", "Bacteria;B;;;;", "-1")], "feature string, sample string, value double")
    got = mapping.validate_lineages(t).collect()
    assert {(r["feature"], r["sample"], r["value"]) for r in got} == {(f, s, 0.5) for f in ("Bacteria;A;;;;", "Bacteria;B;;;;") for s in ("s1", "s2")}


def test_short_genera_conflicts_and_sides(spark):
    names = spark.createDataFrame([("A;B;Gen",), ("A;C;Gen",), ("A;C;Other",), ("A;D;?",), ("X;Y;Alone",)], "feature string")
    got = {r["feature"]: r["short"] for r in mapping.short_genus(names).collect()}
    assert got["X;Y;Alone"] == "Alone" and got["A;B;Gen"] == "A;B;Gen" and got["A;D;?"] == "D;?"
    found = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1)], "input_feature string, model_feature string, priority int")
    assert [tuple(r) for r in mapping.conflicts(found).collect()] == [("a", ["x", "y"])]


def test_slices():
    labels = ["a", "b", "c", "d"]
    assert matrix.chosen(labels, None) == labels and matrix.chosen(labels, "c") == ["c"] and matrix.chosen(labels, [3, "a"]) == ["d", "a"]
    assert matrix.chosen(labels, slice("b", "c")) == ["b", "c"] and matrix.chosen(labels, slice(1, 3)) == ["b", "c"] and matrix.chosen(labels, slice("b", None)) == ["b", "c", "d"]
    for wrong in ("z", 4, -5, ["a", "z"], slice("z", None)):
        with pytest.raises(IndexError):
            matrix.chosen(labels, wrong)


def test_odd_sample_names_come_through(spark, tmp_path):
    odd = ["s.1", "two words", "back`tick", "a.b.c"]
    t = spark.createDataFrame([(f, s, float(i + j)) for i, f in enumerate("xyz") for j, s in enumerate(odd)], "feature string, sample string, value double")
    tables.write_delimited(t, str(tmp_path / "t"))
    back = tables.read_delimited(spark, str(tmp_path / "t"))
    assert rows(back, "feature", "sample", "value") == rows(t, "feature", "sample", "value")


def test_exact_mann_whitney():
    rng = np.random.default_rng(1)
    for n, m in ((3, 4), (5, 5), (2, 6)):
        values = rng.permutation(n + m).astype(float)
        u = lambda own, other: sum(x > y for x in own for y in other)
        every = [u(c, [v for v in values if v not in c]) for c in itertools.combinations(values, n)]
        here = u(values[:n], values[n:])
        far = max(here, n * m - here)
        want = min(1.0, 2 * np.mean([k >= far for k in every]))
        assert small.mann_whitney_tail(here, n, m) == pytest.approx(want)


def test_univariate_guards_and_kinds(spark):
    md = spark.createDataFrame([(f"s{i}", "abc"[i % 3], float(i), f"only{i}", i % 2 == 0, "one") for i in range(12)], "sample string, cat string, num double, `id.x` string, flag boolean, same string")
    assert stats.kinds(md) == {"cat": "discrete", "num": "continuous", "id.x": "other", "flag": "discrete", "same": "discrete"}
    values = spark.createDataFrame([(f"s{i}", "S1", float(i)) for i in range(12)], "sample string, signature string, value double")
    with pytest.raises(ValueError, match="single group"):
        stats.univariate(values, stats.stacked(md, ["same"]))
    got = {r["md"]: r for r in stats.univariate(values, stats.stacked(md, ["cat", "flag"])).collect()}
    assert got["cat"]["test"] == "kruskal" and got["flag"]["test"] == "mannwhitneyu" and got["cat"]["max_mean"] == "c"


@pytest.mark.parametrize("method", stats.METHODS)
def test_adjustments(spark, method):
    p = np.array([0.001, 0.008, 0.039, 0.041, 0.2, 0.9])
    n = len(p)
    harmonic = sum(1 / k for k in range(1, n + 1))
    step = np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1]
    want = {"fdr_bh": step, "fdr_by": step * harmonic, "bonferroni": p * n, "holm": np.maximum.accumulate(p * (n - np.arange(n)))}[method]
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "test_id int, p double")
    got = [r["adj_p"] for r in stats.adjusted(t, [], method=method).orderBy("test_id").collect()]
    assert np.allclose(got, np.minimum(1, want))


def test_results_are_summed_up_and_guarded(spark):
    cells = holdout.split(tables.blocks(spark, 12, 12, 2), 2)
    results = holdout.cross_validate(cells, [2, 3], max_iter=30).cache()
    assert results.count() == 2 * 9 * 2 and holdout.uneven(results).count() == 0
    joined = holdout.joined_folds(results).first()
    assert joined["n_folds"] == 9 and len(joined["r_squared"]) == 9
    mean = {(r["rank"], r["shuffle"]): r["rss"] for r in holdout.summary(results).collect()}
    own = {(r["rank"], r["shuffle"]): r["rss"] for r in holdout.summary(results, lambda a: a.mean()).collect()}
    assert all(own[k] == pytest.approx(v) for k, v in mean.items())
    with pytest.raises(ValueError, match="comes"):
        holdout.joined_folds(results.unionByName(results))
    with pytest.raises(ValueError, match="blocks"):
        holdout.split(tables.blocks(spark, 12, 2, 2), 1)
    with pytest.raises(ValueError):
        holdout.validate_split(cells.where("row_block < 2"))
    assert sorted(r["shuffle"] for r in tables.renumbered(cells.where("shuffle = 1")).select("shuffle").distinct().collect()) == [0]
    results.unpersist()


def test_knees_and_peaks_of_tables(spark):
    ranks = list(range(1, 13))
    knee = spark.createDataFrame([(r, s, 1 - 2.0 ** -min(r, 5) + 0.002 * r, 0.5) for r in ranks for s in range(3)], "rank int, shuffle int, cosine_similarity double, r_squared double")
    found = {r["measure"]: r["suggested"] for r in holdout.suggest_rank(knee).collect()}
    assert 3 <= found["cosine_similarity"] <= 5 and found["r_squared"] is None
    level = {1: 1.0, 2: 0.8, 3: 0.7, 4: 0.75, 5: 0.85, 6: 0.95, 7: 0.6, 8: 0.5, 9: 0.55}
    curve = spark.createDataFrame([("m", r, v) for r, v in level.items()], "measure string, rank int, value double")
    assert holdout.suggest_rank_stability(curve).first()["suggested"] == 6


def signatures_of(spark, columns):
    cells = [("c", name.split("@")[1], 2, name, f"f{i:02d}", float(v)) for name, col in columns.items() for i, v in enumerate(col)]
    return spark.createDataFrame(cells, "cohort string, model_id string, rank int, signature_id string, feature string, weight double")


def test_combining(spark):
    rng = np.random.default_rng(3)
    a, b, c = (rng.gamma(0.3, size=40) for _ in range(3))
    sig = signatures_of(spark, {"a@1": a, "a@2": a * 1.01, "b@1": b, "b@2": b, "mix@3": (a + b) / 2, "c@4": c})
    members = combining.merge_similar(combining.alone(sig), sig, 0.95)
    sizes = {r["cluster_id"]: r["n"] for r in members.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert sorted(sizes.values()) == [1, 1, 2, 2]
    mixed = {r["cluster_id"]: set(r["components"]) for r in combining.linear_combinations(members, sig, 0.97).collect()}
    assert mixed == {"mix@3": {"a@1", "b@1"}}
    gone = {r["cluster_id"]: r["of"] for r in combining.reduced_combinations(members, sig, 0.97).collect()}
    assert gone == {"mix@3": "mix@3"}
    # Of clusters with little support one that no sample needs goes, and one that samples need stays.
    h = rng.random((3, 60))
    x = np.stack([a, b, c], axis=1) @ h
    frame = lambda m: spark.createDataFrame(pd.DataFrame([(f"f{i:02d}", f"s{j}", float(m[i, j])) for i in range(40) for j in range(m.shape[1])], columns=["feature", "sample", "value"]))
    reasons = {r["cluster_id"]: r["reason"] for r in combining.unsupported(members, sig, frame(x), required=2, floor=1).collect()}
    assert reasons.get("mix@3") == "support"
    assert {r["cluster_id"] for r in combining.unsupported(members, sig, frame(x), required=2, floor=2).where("reason = 'floor'").collect()} == {"mix@3", "c@4"}
    assert combining.unsupported(members, sig, frame(x), required=2, floor=1, exempt=("mix@3", "c@4")).count() == 0
    assert combining.scaled_plane(sig).count() == 6
    whole = combining.combine(sig, frame(x), 0.95, 0.97, required=1)
    assert {r["cluster_id"] for r in whole.select("cluster_id").distinct().collect()} == {"a@1", "b@1", "c@4"}


def test_support_is_counted_and_weighed(spark):
    sig = signatures_of(spark, {"a@1": [1, 2], "b@1": [2, 1], "c@2": [1, 1]})
    members = spark.createDataFrame([("x", "a@1"), ("x", "c@2"), ("y", "b@1")], "cluster_id string, signature_id string")
    got = lambda **k: {r["cluster_id"]: r["support"] for r in combining.weighed_support(members, sig, **k).collect()}
    sizes = spark.createDataFrame([("c", 10)], "cohort string, n_samples long")
    assert got() == {"x": 2, "y": 1} and got(by="cohort") == {"x": 1, "y": 1} and got(sizes=sizes) == {"x": 20, "y": 10}
    assert combining.needed_support(members, sig, 0.6) == 2 and combining.needed_support(members, sig, 9) == 2 and combining.needed_support(members, sig, 0) == 1
    with pytest.raises(ValueError):
        got(by="moon")


def test_ordination_choices(spark, x, fits):
    model = store.of_fits(fits, x)[3][0]
    for on in ("h", "wh", "x", "signatures"):
        points, arrows = ordination.pcoa(model.w, model.h, x, on)
        assert points.where("axis = 1").count() == (3 if on == "signatures" else 24) and arrows.count() > 0
        assert 0 < points.agg(F.max("share")).first()[0] <= 1
    assert ordination.pcoa(model.w, model.h, x, "h", "cosine", False, False)[0].count() == 48
    with pytest.raises(ValueError):
        ordination.pcoa(model.w, model.h, None, "x")


def test_plot_choices(spark):
    assert plots.selected(holdout.MEASURES, exclude=["rss"])[0] == "r_squared" and plots.selected(holdout.MEASURES, ["rss"]) == ["rss"]
    with pytest.raises(ValueError):
        plots.selected(holdout.MEASURES, ["nothing"])
    assert "pcoa" in plots.to_draw(250) and "pcoa" not in plots.to_draw(251)


def test_synthetic_tables(spark, sf_dir):
    plain, scaled = tables.blocks(spark, 20, 10, 2), tables.blocks(spark, 20, 10, 2, scale=(0.0, 1.0))
    for t in (plain, scaled):
        assert all(r["s"] == pytest.approx(1) for r in t.groupBy("sample").agg(F.sum("value").alias("s")).collect())
    assert rows(plain) != rows(scaled)
    cohorts = tables.related_cohorts(inputs.region_weights(spark, sf_dir), (5, 6, 7, 8, 9, 10))
    assert {r["cohort"]: r["n"] for r in cohorts.groupBy("cohort").agg(F.count_distinct("sample").alias("n")).collect()} == {f"cohort_{k}": 5 + k for k in range(6)}


def test_streamed_samples_score_as_a_table_does(spark, x, fits):
    model = store.of_fits(fits, x)[2][0]
    whole = {(r["sample"], r["signature"]): r["weight"] for r in models.transform(x, model.w, 20).collect()}
    mean = x.agg(F.sum("value")).first()[0] / (30 * 24)
    arrays = x.groupBy("sample").agg(F.collect_list("feature").alias("features"), F.collect_list("value").alias("values"))
    odd = arrays.withColumn("features", F.concat("features", F.array(F.lit("unheard of")))).withColumn("values", F.concat("values", F.array(F.lit(3.0))))
    got = score_stream(odd, model.w, (mean / 2) ** 0.5, 20).collect()
    assert all(r["weight"] == pytest.approx(whole[r["sample"], r["signature"]]) for r in got) and len(got) == 48
