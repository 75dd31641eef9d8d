"""More queries: reapplying, whole tests between groups, suggestions, lineages, combining, ordination, plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwise.operators import analysis, combining, holdout, mapping, matrix, models, ordination, plots, reapply, stats
from partwise.plans import inputs
from partwise.plans.queries import COS, LABELS, LINEAGES, MAP, REP, ROUNDS, SIGS, h0, hs, labels, m1, m2, members, pairs, query, rounded, signatures, small_map, w0, w1, x1

# Reapplying.

AS = (
    MAP.replace("SUM", "sum").replace(" FROM m1 LEFT JOIN mp", " FROM x1 LEFT JOIN mp")
    + ", wz AS (SELECT feature, signature, sig_ord, weight FROM w0 WHERE feature IN (SELECT feature FROM ma)), ez AS (SELECT DISTINCT feature FROM ma WHERE feature NOT IN (SELECT feature FROM w0))"
)
_STEP = """, y{t} AS (SELECT wz.feature, g{p}.sample, sum(wz.weight * g{p}.weight) AS y FROM wz JOIN g{p} USING (signature) GROUP BY 1, 2), t{t} AS (SELECT ma.sample, wz.signature, sum(wz.weight * ma.value / y{t}.y) AS top FROM ma JOIN y{t} USING (feature, sample) JOIN wz ON wz.feature = ma.feature GROUP BY 1, 2),
g{t} AS (SELECT g{p}.sample, g{p}.signature, g{p}.sig_ord, g{p}.weight * t{t}.top / ms.mass AS weight FROM g{p} JOIN t{t} USING (sample, signature) JOIN ms USING (signature))"""
APPLIED = (
    AS
    + ", ms AS (SELECT signature, sig_ord, sum(weight) AS mass FROM wz GROUP BY 1, 2), st AS (SELECT sqrt(sum(value) / ((SELECT count(DISTINCT feature) FROM ma) * count(DISTINCT sample)) / (SELECT count(*) FROM ms)) AS s FROM ma), g0 AS (SELECT s.sample, ms.signature, ms.sig_ord, st.s AS weight FROM (SELECT DISTINCT sample FROM ma) s CROSS JOIN ms CROSS JOIN st)"
    + "".join(_STEP.format(t=t, p=t - 1) for t in range(1, ROUNDS + 1))
)


def hard_match(w, x):
    """Equal names, but for three that a table renames."""
    hard = small_map(x.sparkSession)
    return mapping.match_identical(w, x).join(hard.select("input_feature"), "input_feature", "left_anti").unionByName(hard)


def applied(spark, d):
    return reapply.reapply(x1(spark, d), w0(spark, d), match=hard_match, rounds=ROUNDS, tol=0.0)


@query(APPLIED + f" SELECT sample, signature, sig_ord, round(weight, 6) AS weight FROM g{ROUNDS}")
def reapply_weights(spark, d):
    return rounded(applied(spark, d).h, "weight")


@query(AS + """ SELECT (SELECT count(*) FROM ez) AS unknown_features, round((SELECT sum(value) FROM ma JOIN ez USING (feature)), 6) AS unknown_mass, round((SELECT sum(value) FROM ma), 6) AS mass, round((SELECT sum(weight) FROM w0), 6) AS model_weight, round((SELECT sum(weight) FROM wz), 6) AS used_weight,
 round((SELECT sum(value) FROM ma JOIN ez USING (feature)) / (SELECT sum(value) FROM ma), 6) AS unknown_share, round(1 - (SELECT sum(weight) FROM wz) / (SELECT sum(weight) FROM w0), 6) AS lost_weight_share""")
def reapply_report(spark, d):
    r = applied(spark, d).report
    return rounded(r, "unknown_mass", "mass", "model_weight", "used_weight", "unknown_share", "lost_weight_share")


@query(APPLIED + f", wf AS (SELECT feature, sample, sum(wz.weight * g{ROUNDS}.weight) AS fitted FROM wz JOIN g{ROUNDS} USING (signature) GROUP BY 1, 2) SELECT ma.sample, round(sum(value * coalesce(fitted, 0)) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) AS model_fit FROM ma LEFT JOIN wf USING (feature, sample) GROUP BY 1")
def reapply_model_fit(spark, d):
    return rounded(applied(spark, d).model_fit(), "model_fit")


@query(None)
def reapply_converged(spark, d):
    return rounded(reapply.reapply(x1(spark, d), w0(spark, d), match=hard_match).h, "weight")


# Lineages.

LIN = """, lx AS (SELECT 'k__Bacteria;p__' || p_type || ';c__' || substr(p_brand, 7, 1) || ';o__' || (p_size % 3) || ';f__F' || (p_size % 2) || ';g__' || CASE WHEN p_size % 10 = 0 THEN '?' ELSE 'Gen' || substr(p_brand, 8, 1) END AS feature, 's' || l_suppkey AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
 UNION ALL SELECT '-1', 's1', 5 UNION ALL SELECT '?;?;?;?;?;?', 's1', 7 UNION ALL SELECT 'k__Bacteria;p__none;;;;', 's1', 0)"""


def lineage_table(spark, d):
    t = lambda n: inputs.table(spark, d, n)
    genus = F.when(F.col("p_size") % 10 == 0, F.lit("?")).otherwise(F.concat(F.lit("Gen"), F.substring("p_brand", 8, 1)))
    label = F.concat(F.lit("k__Bacteria;p__"), "p_type", F.lit(";c__"), F.substring("p_brand", 7, 1), F.lit(";o__"), (F.col("p_size") % 3).cast("string"), F.lit(";f__F"), (F.col("p_size") % 2).cast("string"), F.lit(";g__"), genus)
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    # One shuffle serves the sum and keeps a sample's rows together for what follows.
    cells = lines.select(label.alias("feature"), "l_suppkey", "l_quantity").repartition("l_suppkey").groupBy("feature", "l_suppkey").agg(F.sum("l_quantity").cast("double").alias("value"))
    x = cells.select("feature", F.concat(F.lit("s"), "l_suppkey").alias("sample"), "value")
    odd = spark.createDataFrame([("-1", "s1", 5.0), ("?;?;?;?;?;?", "s1", 7.0), ("k__Bacteria;p__none;;;;", "s1", 0.0)], "feature string, sample string, value double")
    return x.unionByName(odd)


# The table has a label without marks among the first by name, so marks stay.
@query(LIN + ", a AS (SELECT * FROM lx WHERE feature NOT IN ('-1', '?;?;?;?;?;?') AND feature IN (SELECT feature FROM lx GROUP BY 1 HAVING sum(value) <> 0)) SELECT feature, sample, round(value / sum(value) OVER (PARTITION BY sample), 6) AS value FROM a")
def lineage_validated(spark, d):
    return rounded(mapping.validate_lineages(lineage_table(spark, d)), "value")


@query(LIN + ", a AS (SELECT regexp_replace(feature, '[a-zA-Z]__', '', 'g') AS feature, sample, value FROM lx WHERE feature LIKE 'k%' AND value > 0) SELECT feature, sample, round(value / sum(value) OVER (PARTITION BY sample), 6) AS value FROM a")
def lineage_stripped(spark, d):
    return rounded(mapping.validate_lineages(lineage_table(spark, d).where("feature like 'k%' and value > 0")), "value")


GENERA = "WITH x AS (SELECT DISTINCT regexp_replace(l, '[a-zA-Z]__', '', 'g') AS s FROM (VALUES " + ", ".join(f"('{s}')" for s in LINEAGES) + """) v(l)), w AS (SELECT * FROM (VALUES ('B;X;Y;Z;F1;Gen'), ('B;X;Y;Z;F2;'), ('C;Q;;;;Other')) t(g)),
f AS (SELECT s, g, list_filter(string_split(replace(s, '?', ''), ';'), lambda z: trim(z) <> '')[-1] AS fs, list_filter(string_split(replace(g, '?', ''), ';'), lambda z: trim(z) <> '')[-1] AS fg,
 CASE WHEN contains(string_split(s, ';')[-1], '_') THEN regexp_replace(s, '(\\w+)_\\w$', '\\1') ELSE s END AS root, array_to_string(string_split(s, ';')[:-2], ';') || ';' AS fam FROM x CROSS JOIN w),
r AS (SELECT s, g, CASE WHEN s = g THEN 1 WHEN root = g THEN 2 WHEN fs = fg THEN 3 WHEN fam = g THEN 4 END AS o FROM f), b AS (SELECT *, min(o) OVER (PARTITION BY s) AS first FROM r WHERE o IS NOT NULL)"""


@query(GENERA + " SELECT s AS input_feature, g AS model_feature, CAST(row_number() OVER (PARTITION BY s ORDER BY g) AS INTEGER) AS priority, ['identical', 'split_genus', 'final_rank', 'family'][first] AS rule FROM b WHERE o = first", base=False)
def match_genera_rules(spark, d):
    x = spark.createDataFrame([(s,) for s in LINEAGES], "feature string").withColumn("feature", mapping.strip_ranks(F.col("feature")))
    w = spark.createDataFrame([("B;X;Y;Z;F1;Gen",), ("B;X;Y;Z;F2;",), ("C;Q;;;;Other",)], "feature string")
    return mapping.match_lineages(w, x)


@query(MAP + " SELECT feature, CASE WHEN max(k) = 2 THEN 'both' WHEN any_value(side) = 'l' THEN 'left' ELSE 'right' END AS side FROM (SELECT feature, count(*) OVER (PARTITION BY feature) AS k, side FROM (SELECT DISTINCT feature, 'l' AS side FROM w0 UNION ALL SELECT DISTINCT feature, 'r' FROM ma)) GROUP BY feature")
def label_sides(spark, d):
    return mapping.parted(w0(spark, d), mapping.map_abundance(m1(spark, d), small_map(spark)))


# Slices.


@query(" SELECT feature, signature, round(weight, 6) AS weight, o.new_ord FROM w0 JOIN (SELECT signature, CAST(list_position([3, 2, 5], sig_ord) AS INTEGER) AS new_ord FROM (SELECT DISTINCT signature, sig_ord FROM w0) WHERE sig_ord IN (2, 3, 5)) o USING (signature)")
def slice_mixed(spark, d):
    w = w0(spark, d)
    third = [r["signature"] for r in w.where("sig_ord = 3").select("signature").distinct().collect()]
    return rounded(matrix.sliced(w, "signature", [*third, 1, -1], "sig_ord").select("feature", "signature", "weight", "new_ord"), "weight")


@query(" SELECT feature, signature, round(weight, 6) AS weight, CAST(sig_ord - 1 AS INTEGER) AS new_ord FROM w0 WHERE sig_ord BETWEEN 2 AND 4")
def slice_range(spark, d):
    return rounded(matrix.sliced(w0(spark, d), "signature", slice(1, 4), "sig_ord").select("feature", "signature", "weight", "new_ord"), "weight")


@query(" SELECT feature, sample, value, CAST(dense_rank() OVER (ORDER BY sample) AS INTEGER) AS new_ord FROM m1 WHERE sample BETWEEN 'NATION_11' AND 'NATION_4'")
def slice_names(spark, d):
    return matrix.sliced(m1(spark, d), "sample", slice("NATION_11", "NATION_4"))


# Tests between groups, in full.

MD = """, l AS (SELECT n_name AS sample, r_name AS label, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey), md AS (SELECT sample, 'region' AS md, label AS grp FROM l UNION ALL SELECT sample, 'third', 't' || (k % 3) FROM l WHERE k <> 7 UNION ALL SELECT sample, 'parity', CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END FROM l)"""
TESTS = MD + """, v AS (SELECT md, signature, sample, grp, round(weight, 6) AS value FROM h0 JOIN md USING (sample)), rk AS (SELECT *, count(*) OVER (PARTITION BY md, signature, value) AS ties, rank() OVER (PARTITION BY md, signature ORDER BY value) + (count(*) OVER (PARTITION BY md, signature, value) - 1) / 2.0 AS rank FROM v),
rs AS (SELECT md, signature, grp, count(*) AS n, sum(rank) AS r, avg(value) AS mean, median(value) AS median FROM rk GROUP BY ALL), wt AS (SELECT md, signature, CAST(count(*) AS DOUBLE) AS t, sum(ties * ties - 1) AS tie FROM rk GROUP BY ALL),
tp AS (SELECT md, signature, arg_max(grp, (mean, grp)) AS max_mean, arg_max(grp, (median, grp)) AS max_median FROM rs GROUP BY ALL),
dz AS (SELECT a.md, a.signature, a.grp AS a, b.grp AS b, abs(a.r / a.n - b.r / b.n) / sqrt((t * (t + 1) / 12 - tie / (12 * (t - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z FROM rs a JOIN rs b ON a.md = b.md AND a.signature = b.signature AND a.grp < b.grp JOIN wt ON wt.md = a.md AND wt.signature = a.signature),
dp AS (SELECT *, 1 - sqrt(2 / pi()) * list_sum(list_transform(range(0, 90), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(greatest(z, 1e-12)) - n * ln(2) - lgamma(n + 1.0)) / (2 * n + 1))) AS p FROM dz),
dr AS (SELECT *, p * count(*) OVER (PARTITION BY md, signature) / row_number() OVER (PARTITION BY md, signature ORDER BY p, a || '|' || b) AS raw FROM dp), da AS (SELECT *, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY md, signature ORDER BY p DESC, a || '|' || b DESC)) AS pair_p FROM dr),
ph AS (SELECT md, signature, coalesce(string_agg(a || '|' || b || '(' || format('{:.6f}', pair_p) || ')', ';' ORDER BY a, b) FILTER (pair_p <= 0.05), '') AS posthoc_str FROM da GROUP BY ALL),
kw AS (SELECT rs.md, rs.signature, (12 / (any_value(t) * (any_value(t) + 1)) * sum(r * r / n) - 3 * (any_value(t) + 1)) / (1 - any_value(tie) / (any_value(t) * any_value(t) * any_value(t) - any_value(t))) AS h, count(*) AS k FROM rs JOIN wt USING (md, signature) GROUP BY ALL),
mw AS (SELECT a.md, a.signature, a.r - a.n * (a.n + 1) / 2.0 AS u, greatest(0, (greatest(a.r - a.n * (a.n + 1) / 2.0, a.n * b.n - (a.r - a.n * (a.n + 1) / 2.0)) - a.n * b.n / 2.0 - 0.5) / sqrt(a.n * b.n / 12.0 * (t + 1 - tie / (t * (t - 1))))) AS z FROM rs a JOIN rs b ON a.md = b.md AND a.signature = b.signature AND a.grp < b.grp JOIN wt ON wt.md = a.md AND wt.signature = a.signature WHERE a.md = 'parity'),
ut AS (SELECT md, signature, h AS statistic, CASE k WHEN 5 THEN exp(-h / 2) * (1 + h / 2) ELSE exp(-h / 2) END AS p, 'kruskal' AS test, posthoc_str FROM kw JOIN ph USING (md, signature) WHERE k > 2
 UNION ALL SELECT md, signature, u, 1 - sqrt(2 / pi()) * list_sum(list_transform(range(0, 90), lambda n: CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(greatest(z, 1e-12)) - n * ln(2) - lgamma(n + 1.0)) / (2 * n + 1))), 'mannwhitneyu', NULL FROM mw),
ur AS (SELECT *, p * count(*) OVER (PARTITION BY md) / row_number() OVER (PARTITION BY md ORDER BY p, signature) AS lr, p * count(*) OVER () / row_number() OVER (ORDER BY p, md || '|' || signature) AS gr FROM ut),
ua AS (SELECT *, least(1.0::DOUBLE, min(lr) OVER (PARTITION BY md ORDER BY p DESC, signature DESC)) AS local_adj_p, least(1.0::DOUBLE, min(gr) OVER (ORDER BY p DESC, md || '|' || signature DESC)) AS global_adj_p FROM ur)"""


def metadata_of(spark, d):
    t = labels(spark, d).join(inputs.table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.col("n_nationkey").alias("k")), "sample")
    third = F.when(F.col("k") != 7, F.concat(F.lit("t"), (F.col("k") % 3).cast("string")))
    wide = t.select("sample", F.col("label").alias("region"), third.alias("third"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("parity"))
    return stats.stacked(wide, ["region", "third", "parity"])


def measured(spark, d):
    return h0(spark, d).select("sample", "signature", "sig_ord", F.round("weight", 6).alias("value"))


@query(TESTS + " SELECT md, signature, round(statistic, 5) AS statistic, round(p, 6) AS p, test, posthoc_str, max_median, max_mean, round(local_adj_p, 6) AS local_adj_p, round(global_adj_p, 6) AS global_adj_p, local_adj_p <= 0.05 AS local_reject, global_adj_p <= 0.05 AS global_reject, 0.05::DOUBLE AS alpha, 'fdr_bh' AS adj_method FROM ua JOIN tp USING (md, signature)")
def univariate_full(spark, d):
    out = stats.univariate(measured(spark, d).drop("sig_ord"), metadata_of(spark, d))
    return rounded(rounded(out, "p", "local_adj_p", "global_adj_p"), "statistic", digits=5)


@query(TESTS + " SELECT md, signature, a, b, round(z, 6) AS z, round(p, 6) AS p, round(pair_p, 6) AS adj_p FROM da")
def posthoc_pairs(spark, d):
    return rounded(stats.posthoc_table(measured(spark, d).drop("sig_ord"), metadata_of(spark, d)), "z", "p", "adj_p")


@query(TESTS + ", pn AS (SELECT md, signature, max(value) + 0.1 * (max(value) - min(value)) AS y, (count(DISTINCT grp) + 1) / 2.0 AS x FROM v GROUP BY ALL) SELECT md, signature, sample, grp, round(value, 6) AS value, CASE WHEN global_adj_p <= 0.01 THEN '***' WHEN global_adj_p <= 0.05 THEN '**' WHEN global_adj_p <= 0.1 THEN '*' WHEN p <= 0.01 THEN '..' WHEN p <= 0.05 THEN '.' ELSE '' END AS significance, x, round(y, 6) AS y FROM v JOIN ua USING (md, signature) JOIN pn USING (md, signature)")
def plotdata_metadata(spark, d):
    return rounded(plots.discrete_metadata(measured(spark, d), metadata_of(spark, d)).drop("sig_ord"), "value", "y")


@query(MD.replace(", l AS", ", l AS", 1) + ", n AS (SELECT n_name AS sample, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT sample, 'customers' AS md, CAST(c AS DOUBLE) AS md_value, signature, sig_ord, round(weight, 6) AS value FROM n JOIN h0 USING (sample)")
def plotdata_metadata_continuous(spark, d):
    c = inputs.table(spark, d, "customer").join(inputs.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("sample")).agg(F.count("*").alias("customers"))
    assert stats.kinds(c) == {"customers": "continuous"}
    return plots.continuous_metadata(measured(spark, d), stats.stacked(c, ["customers"]))


# Suggestions.

SERIES = "WITH s AS (SELECT c_mktsegment AS measure, c_custkey % 10 + 2 AS rank, round(sum(c_acctbal) / 100000, 6) AS value FROM customer GROUP BY ALL)"


def series(spark, d):
    return inputs.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("measure"), (F.col("c_custkey") % 10 + 2).cast("int").alias("rank")).agg(F.round(F.sum("c_acctbal") / 100000, 6).alias("value"))


PEAK = SERIES + """, o AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY rank DESC) AS i, count(*) OVER (PARTITION BY measure) AS n FROM s),
w AS (SELECT a.*, b.value AS before, c.value AS after FROM o a JOIN o b ON a.measure = b.measure AND b.i = CASE WHEN a.i = 1 THEN a.n ELSE a.i - 1 END JOIN o c ON a.measure = c.measure AND c.i = CASE WHEN a.i = a.n THEN 1 ELSE a.i + 1 END),
t AS (SELECT *, max(value) OVER (PARTITION BY measure) AS high FROM w WHERE value > before AND value > after),
f AS (SELECT t.measure, t.rank, t.i, coalesce((SELECT min(w.i) FROM w WHERE w.measure = t.measure AND w.i > t.i AND NOT w.value < w.before), t.n + 1) - 1 - t.i AS run FROM t WHERE value >= 0.98 * high),
p AS (SELECT measure, arg_max(rank, (run, -i)) AS best_at FROM f GROUP BY 1)"""


@query(PEAK + " SELECT measure, best_at AS suggested FROM p", base=False)
def suggest_rank_stability(spark, d):
    return holdout.suggest_rank_stability(series(spark, d))


@query(PEAK + " SELECT s.measure, CAST(rank AS INTEGER) AS rank, value, coalesce(rank = best_at, false) AS suggested FROM s LEFT JOIN p USING (measure)", base=False)
def plotdata_stability(spark, d):
    return plots.stability(series(spark, d))


@query(None)
def suggest_rank_knee(spark, d):
    results = holdout.cross_validate(holdout.split(x1(spark, d), 2), [2, 3, 4, 5], max_iter=100)
    return holdout.suggest_rank(holdout.summary(results))


GRID = "WITH g AS (SELECT n_regionkey + 2 AS rank, c_custkey % 5 AS shuffle, avg(c_acctbal) / 10000 AS cosine_similarity, stddev_pop(c_acctbal) / 10000 AS r_squared FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def grid(spark, d):
    """A table of results' shape from the customers."""
    t = inputs.table(spark, d, "customer").join(inputs.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.groupBy((F.col("n_regionkey") + 2).alias("rank"), (F.col("c_custkey") % 5).cast("int").alias("shuffle")).agg((F.avg("c_acctbal") / 10000).alias("cosine_similarity"), (F.stddev_pop("c_acctbal") / 10000).alias("r_squared"))
    return t.withColumns({m: F.lit(None).cast("double") for m in holdout.MEASURES if m not in ("cosine_similarity", "r_squared")})


@query(GRID + ", u AS (UNPIVOT g ON cosine_similarity, r_squared INTO NAME measure VALUE value) SELECT rank, CAST(shuffle AS INTEGER) AS shuffle, measure, round(value, 6) AS value, CASE measure WHEN 'r_squared' THEN 1 ELSE 2 END AS facet_ord, CAST(rank AS VARCHAR) AS label FROM u", base=False)
def plotdata_rank_selection(spark, d):
    return rounded(plots.selection(grid(spark, d), include=["cosine_similarity", "r_squared"]), "value")


@query(GRID + ", u AS (UNPIVOT g ON cosine_similarity, r_squared INTO NAME measure VALUE value) SELECT measure, 3 AS rank, round(max(value) + 0.1 * (max(value) - min(value)), 6) AS y FROM u GROUP BY measure", base=False)
def plotdata_rank_stars(spark, d):
    found = spark.createDataFrame([("cosine_similarity", 3), ("r_squared", 3)], "measure string, suggested int")
    return rounded(plots.stars(plots.selection(grid(spark, d), include=["cosine_similarity", "r_squared"]), found), "y")


@query(GRID + " SELECT measure, rank, round(median(value), 6) AS value FROM (UNPIVOT g ON cosine_similarity, r_squared INTO NAME measure VALUE value) GROUP BY ALL", base=False)
def rank_curves(spark, d):
    return rounded(holdout.curves(grid(spark, d)), "value")


ALPHAS = "WITH t AS (SELECT n_regionkey / 4.0::DOUBLE AS alpha, c_custkey % 5 AS shuffle, avg(c_acctbal) / 10000 - n_regionkey * 0.02 AS r_squared FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, 1, 2), m AS (SELECT alpha, avg(r_squared) AS mean, stddev_pop(r_squared) AS sd FROM t GROUP BY alpha), b AS (SELECT mean - sd AS bar FROM m WHERE alpha = 0), o AS (SELECT alpha, min(CASE WHEN mean >= bar THEN 1 ELSE 0 END) OVER (ORDER BY alpha) AS ok FROM m CROSS JOIN b)"


@query(ALPHAS + " SELECT max(alpha) AS best_alpha FROM o WHERE ok = 1", base=False)
def suggest_alpha(spark, d):
    t = inputs.table(spark, d, "customer").join(inputs.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = t.groupBy("n_regionkey", (F.col("c_custkey") % 5).alias("shuffle")).agg((F.avg("c_acctbal") / 10000).alias("a"))
    return holdout.best_alpha(t.select((F.col("n_regionkey") / F.lit(4.0)).alias("alpha"), "shuffle", (F.col("a") - F.col("n_regionkey") * 0.02).alias("r_squared")))


# Combining.


@query(SIGS + ", n AS (SELECT * FROM (VALUES ('region', 25), ('segment', 40)) t(cohort, n_samples)), d AS (SELECT DISTINCT cluster_id, cohort, model_id FROM mb JOIN sg USING (signature_id)) SELECT cluster_id, sum(n_samples) AS support FROM d JOIN n USING (cohort) GROUP BY 1")
def support_by_samples(spark, d):
    sizes = spark.createDataFrame([("region", 25), ("segment", 40)], "cohort string, n_samples long")
    return combining.weighed_support(members(spark, d), signatures(spark, d), "model", sizes)


@query(SIGS + ", p AS (SELECT x.cluster_id, x.signature_id AS a, y.signature_id AS b FROM mb x JOIN mb y ON x.cluster_id = y.cluster_id AND x.signature_id < y.signature_id) SELECT cluster_id, a, b, round(sum(s.weight * t.weight) / sqrt(sum(s.weight * s.weight) * sum(t.weight * t.weight)), 6) AS cosine FROM p JOIN sg s ON s.signature_id = a JOIN sg t ON t.signature_id = b AND s.feature = t.feature GROUP BY ALL")
def plotdata_member_similarity(spark, d):
    return rounded(combining.member_similarity(members(spark, d), signatures(spark, d)), "cosine")


@query(SIGS + ", ce AS (SELECT cluster_id, feature, avg(weight) AS w FROM mb JOIN sg USING (signature_id) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, feature) AS place FROM ce) SELECT o.cluster_id, o.feature, CAST(place AS INTEGER) AS place, signature_id, round(weight, 6) AS weight FROM o JOIN mb USING (cluster_id) JOIN sg USING (signature_id, feature) WHERE place <= 5")
def plotdata_feature_variance(spark, d):
    return rounded(combining.feature_variance(members(spark, d), signatures(spark, d)), "weight")


PERM = COS + """, i AS (SELECT DISTINCT a, dense_rank() OVER (ORDER BY a) AS r FROM cp), q AS (SELECT p1.b AS b1, p2.b AS b2, p3.b AS b3, p4.b AS b4, p5.b AS b5, p1.cosine + p2.cosine + p3.cosine + p4.cosine + p5.cosine AS total FROM cp p1, cp p2, cp p3, cp p4, cp p5
 WHERE p1.a = (SELECT a FROM i WHERE r = 1) AND p2.a = (SELECT a FROM i WHERE r = 2) AND p3.a = (SELECT a FROM i WHERE r = 3) AND p4.a = (SELECT a FROM i WHERE r = 4) AND p5.a = (SELECT a FROM i WHERE r = 5)
 AND p1.b NOT IN (p2.b, p3.b, p4.b, p5.b) AND p2.b NOT IN (p3.b, p4.b, p5.b) AND p3.b NOT IN (p4.b, p5.b) AND p4.b <> p5.b),
best AS (SELECT [b1, b2, b3, b4, b5] AS l FROM q ORDER BY total DESC, b1, b2, b3, b4 LIMIT 1), hung AS (SELECT i.a, l[i.r] AS b FROM i CROSS JOIN best)"""


@query(PERM + " SELECT a, b, round(cosine, 6) AS pair_cosine FROM hung JOIN cp USING (a, b)")
def match_signatures(spark, d):
    return rounded(models.match(analysis.cosines(w0(spark, d), w1(spark, d))), "pair_cosine")


@query(PERM + " SELECT 'x_' || a AS cluster_id, b || ' (' || format('{:.2f}', cosine) || ')' AS label, round(cosine, 6) AS pair_cosine FROM hung JOIN cp USING (a, b)")
def label_by_match(spark, d):
    w = w0(spark, d)
    sig = combining.as_signatures(w, "c", "m", 5)
    named = sig.select("signature_id").distinct().select(F.concat(F.lit("x_"), F.substring_index("signature_id", ":", -1)).alias("cluster_id"), "signature_id")
    return rounded(combining.label_by_match(named, sig, w1(spark, d)), "pair_cosine")


def mixture(spark, d):
    """The regions' signatures and one that is a mixture of two of them, of one model each."""
    w = w0(spark, d)
    mixed = w.where("signature in ('ASIA', 'EUROPE')").groupBy("feature").agg(F.avg("weight").alias("weight")).select("feature", F.lit("MIXED").alias("signature"), "weight")
    return combining.as_signatures(w.select("feature", "signature", "weight").unionByName(mixed), "c", "m", 5)


@query(None)
def linear_combinations(spark, d):
    sig = mixture(spark, d)
    return rounded(combining.linear_combinations(combining.alone(sig), sig, 0.99).select("cluster_id", "fit"), "fit", digits=3)


@query(None)
def unsupported_clusters(spark, d):
    return rounded(combining.unsupported(members(spark, d), signatures(spark, d), x1(spark, d), required=2, floor=1), "fit_without", "fit_others", "p", digits=4)


@query(None)
def signature_plane(spark, d):
    return rounded(combining.scaled_plane(signatures(spark, d)), "mds1", "mds2", digits=4)


# Ordination.


@query(", hw AS (SELECT sample, signature, weight / max(weight) OVER (PARTITION BY signature) AS v FROM h0), hd AS (SELECT sample, signature, v / sum(v) OVER (PARTITION BY sample) AS v FROM hw) SELECT a.sample AS i, b.sample AS j, round(sqrt(sum(abs(a.v - b.v)) / sum(a.v + b.v)), 5) AS distance FROM hd a JOIN hd b USING (signature) WHERE a.sample < b.sample GROUP BY 1, 2")
def pcoa_distances(spark, d):
    """Distances between the samples' points on all axes: those that the points were made of."""
    from partwise.session import cut

    points = cut(ordination.coordinates(ordination.distances(ordination.table_of("h", w0(spark, d), h0(spark, d), None)), axes=25).select("item", "axis", "value"))
    a, b = points.withColumnsRenamed({"item": "i", "value": "p"}), points.withColumnsRenamed({"item": "j", "value": "q"})
    sums = a.join(b, "axis").where("i < j").groupBy("i", "j").agg(F.sum((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("s"))
    return sums.select("i", "j", F.round(F.sqrt("s"), 5).alias("distance"))


@query(None)
def pcoa_arrows(spark, d):
    return rounded(ordination.pcoa(w0(spark, d), h0(spark, d))[1], "value", digits=4)


# Plot tables and the rest.


@query(LABELS + ", g AS (SELECT * FROM l WHERE label <> 'ASIA'), r AS (SELECT s.sample, coalesce(g.label, 'NA') AS grp FROM (SELECT DISTINCT sample FROM m1) s LEFT JOIN g USING (sample)) SELECT sample, grp, CAST(dense_rank() OVER (ORDER BY grp = 'NA', grp) AS INTEGER) AS grp_ord FROM r")
def ribbon_ordered(spark, d):
    return plots.ribbon(m1(spark, d), labels(spark, d).where("label <> 'ASIA'").withColumnRenamed("label", "grp"))


@query(LABELS + " SELECT 'missing' AS problem, (SELECT count(*) FROM l WHERE label = 'ASIA') AS n UNION ALL SELECT 'extra', 1")
def ribbon_problems(spark, d):
    known = labels(spark, d).where("label <> 'ASIA'").withColumnRenamed("label", "grp")
    return plots.ribbon_report(m1(spark, d), known.unionByName(spark.createDataFrame([("ATLANTIS", "SEA")], known.schema)))


@query(LABELS + ", g AS (SELECT sample, label AS grp FROM l WHERE label <> 'ASIA' UNION ALL SELECT 'ATLANTIS', 'SEA'), f AS (SELECT sample, sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)) AS x FROM pr GROUP BY sample) SELECT sample, round(x, 6) AS model_fit, grp, round(avg(x) OVER (PARTITION BY grp), 6) AS mean_fit FROM f FULL JOIN g USING (sample)")
def plotdata_modelfit_full(spark, d):
    known = labels(spark, d).where("label <> 'ASIA'").withColumnRenamed("label", "grp")
    out = plots.model_fit(pairs(spark, d), known.unionByName(spark.createDataFrame([("ATLANTIS", "SEA")], known.schema)))
    return rounded(out, "model_fit", "mean_fit")


@query(' SELECT signature, CAST(row_number() OVER (PARTITION BY signature ORDER BY weight DESC, feature) AS INTEGER) AS "order", round(log10(1 + weight), 6) AS weight FROM w0 WHERE weight > 0.01')
def plotdata_weight_distribution(spark, d):
    return rounded(plots.weight_distribution(w0(spark, d), 0.01), "weight")


@query(" SELECT p_type AS sample, min(p_brand) FILTER (p_size % 2 = 0) AS brand_even, min(p_brand) FILTER (p_size % 2 = 1) AS brand_odd FROM part GROUP BY 1")
def metadata_pivot(spark, d):
    t = inputs.table(spark, d, "part").select(F.col("p_type").alias("sample"), F.when(F.col("p_size") % 2 == 0, "brand_even").otherwise("brand_odd").alias("field"), F.col("p_brand").alias("value"))
    return matrix.pivot_fields(t)


@query(" SELECT feature, 'Z' || sig_ord AS signature, sig_ord, round(weight, 6) AS weight FROM w0")
def renamed_signatures(spark, d):
    from partwise.sources.models import Model

    return rounded(Model(w0(spark, d), h0(spark, d)).renamed([f"Z{k}" for k in range(1, 6)]).w, "weight")


@query(REP + " SELECT sample, count(*) FILTER (before < 0.9) AS n FROM a GROUP BY sample")
def representative_counts(spark, d):
    return analysis.representative(hs(spark, d)).groupBy("sample").agg(F.count_if("representative").alias("n"))


@query(None)
def related_cohorts(spark, d):
    from partwise.sources.tables import related_cohorts as made

    return made(w0(spark, d)).groupBy("cohort").agg(F.count_distinct("sample").alias("samples"), F.count_distinct("feature").alias("features"))


@query(" SELECT shuffle, CAST(row_block AS INTEGER) AS row_block, CAST(col_block AS INTEGER) AS col_block, CASE WHEN row_block = 2 THEN 3 ELSE 1 END + 1 - CASE WHEN row_block = 2 THEN 0 ELSE 0 END AS features, CASE WHEN col_block = 2 THEN 34 ELSE 33 END AS samples FROM (SELECT unnest([0, 1]) AS shuffle) CROSS JOIN (SELECT unnest([0, 1, 2]) AS row_block) CROSS JOIN (SELECT unnest([0, 1, 2]) AS col_block)".replace("CASE WHEN row_block = 2 THEN 3 ELSE 1 END + 1 - CASE WHEN row_block = 2 THEN 0 ELSE 0 END", "2"))
def block_sizes(spark, d):
    return holdout.evenness(holdout.validate_split(holdout.split(m2(spark, d), 2)))
