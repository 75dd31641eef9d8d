"""Every query of the matrix engine: what runs, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators import analysis, combining, holdout, mapping, matrix, measures, models, stats
from partwise.plans import inputs
from partwise.plans.inputs import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a function as a query under its own name, with SQL over the common tables if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            inputs.forget()
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = f"WITH {BASE}{sql}" if base else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


m1, m2, m3 = inputs.brand_by_nation, inputs.type_by_supplier, inputs.event_by_user
w0, w1, h0, hs = inputs.region_weights, inputs.segment_weights, inputs.fixed_h, inputs.sharp_h


def x1(spark: SparkSession, d: str) -> DataFrame:
    return matrix.share(inputs.held_brands(spark, d), "sample")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return measures.paired(x1(spark, d), matrix.product(w0(spark, d), h0(spark, d)))


# Building, validating, reshaping.


@query(" SELECT * FROM m1")
def matrix_build_m1(spark, d):
    return m1(spark, d)


@query(" SELECT * FROM m2")
def matrix_build_m2(spark, d):
    return m2(spark, d)


@query(" SELECT feature, sample, round(value, 4) AS value FROM m3")
def matrix_build_m3(spark, d):
    return rounded(m3(spark, d), "value", digits=4)


@query(" SELECT count(DISTINCT feature) AS n_features, count(DISTINCT sample) AS n_samples, count(*) AS n_cells, min(value) AS min_value, count(*) FILTER (value IS NULL) AS n_missing, true AS valid FROM m1")
def matrix_validate(spark, d):
    return matrix.profile(m1(spark, d))


@query(" SELECT feature, max(value) FILTER (sample = '1') AS \"1\", max(value) FILTER (sample = '2') AS \"2\", max(value) FILTER (sample = '3') AS \"3\" FROM m2 GROUP BY feature")
def matrix_pivot_wide(spark, d):
    return matrix.wide(m2(spark, d).where(F.col("sample").isin("1", "2", "3")), ["1", "2", "3"])


@query(" SELECT feature, sample, value FROM m2 WHERE sample IN ('1', '2', '3')")
def matrix_unpivot_long(spark, d):
    return matrix.long(matrix_pivot_wide(spark, d))


@query(" SELECT * FROM (PIVOT m1 ON sample USING max(value) GROUP BY feature)")
def matrix_pivot_whole(spark, d):
    x = m1(spark, d)
    return matrix.wide(x, sorted(r["sample"] for r in x.select("sample").distinct().collect()))


@query(" SELECT feature, sample, value FROM m1")
def matrix_unpivot_whole(spark, d):
    return matrix.long(matrix_pivot_whole(spark, d))


# Scaling.


@query(" SELECT sample, signature, sig_ord, round(weight / sum(weight) OVER (PARTITION BY sample), 6) AS weight FROM h0")
def scale_h_sample(spark, d):
    return rounded(matrix.scaled(h0(spark, d), "h"), "weight")


@query(" SELECT sample, signature, sig_ord, round(weight / sum(weight) OVER (PARTITION BY signature), 6) AS weight FROM h0")
def scale_h_signature(spark, d):
    return rounded(matrix.scaled(h0(spark, d), "h", "signature"), "weight")


@query(" SELECT feature, signature, sig_ord, round(weight / sum(weight) OVER (PARTITION BY signature), 6) AS weight FROM w0s")
def scale_w_signature(spark, d):
    return rounded(matrix.scaled(w0(spark, d), "w"), "weight")


@query(" SELECT feature, signature, sig_ord, round(weight / sum(weight) OVER (PARTITION BY feature), 6) AS weight FROM w0")
def scale_w_feature(spark, d):
    return rounded(matrix.scaled(w0(spark, d), "w", "feature"), "weight")


@query(" SELECT feature, sample, round(value / sum(value) OVER (PARTITION BY sample), 6) AS value FROM m3")
def tss(spark, d):
    return rounded(matrix.share(m3(spark, d), "sample"), "value")


@query(", a AS (SELECT feature, sample, value / max(value) OVER (PARTITION BY feature) AS value FROM m1) SELECT feature, sample, round(value / sum(value) OVER (PARTITION BY sample), 6) AS value FROM a")
def wisconsin(spark, d):
    return rounded(matrix.wisconsin(m1(spark, d)), "value")


@query(" SELECT feature, signature, sig_ord, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY signature)), 6) AS weight FROM w0")
def unit_scale(spark, d):
    return rounded(matrix.unit(w0(spark, d)), "weight")


@query(" SELECT feature, sample, round(fitted, 8) AS fitted FROM wh")
def reconstruct_wh(spark, d):
    return rounded(matrix.product(w0(spark, d), h0(spark, d)), "fitted", digits=8)


# Measures.


def one(spark, d, column, name):
    return pairs(spark, d).agg(F.round(column, 6).alias(name))


@query(" SELECT round(sum((value - fitted) * (value - fitted)), 6) AS rss FROM pr")
def rss(spark, d):
    return one(spark, d, measures.rss(), "rss")


@query(" SELECT round(1 - sum((value - fitted) * (value - fitted)) / (var_pop(value) * count(value)), 6) AS r_squared FROM pr")
def r_squared(spark, d):
    return one(spark, d, measures.r_squared(), "r_squared")


@query(" SELECT round(sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) AS cosine FROM pr")
def cosine_flat(spark, d):
    return one(spark, d, measures.cosine(), "cosine")


@query(" SELECT round(sqrt(sum((value - fitted) * (value - fitted))), 6) AS l2_norm FROM pr")
def l2_norm(spark, d):
    return one(spark, d, measures.l2_norm(), "l2_norm")


@query(" SELECT round(1 - count(*) FILTER (weight > 0.05) / CAST(count(*) AS DOUBLE), 6) AS sparsity FROM w0")
def sparsity(spark, d):
    return w0(spark, d).agg(F.round(matrix.sparsity(F.when(F.col("weight") > 0.05, F.col("weight")).otherwise(0.0), F.count("*")), 6).alias("sparsity"))


@query(" SELECT round(sum(CASE WHEN value > 0 THEN value * ln(value / fitted) ELSE 0 END - value + fitted), 6) AS divergence FROM pr")
def beta_div_kl(spark, d):
    return one(spark, d, measures.kullback_leibler(), "divergence")


@query(" SELECT round(sum((value - fitted) * (value - fitted)) / 2, 6) AS divergence FROM pr")
def beta_div_fro(spark, d):
    return one(spark, d, measures.frobenius(), "divergence")


@query(" SELECT round(sum(value / fitted - ln(value / fitted) - 1), 6) AS divergence FROM pr WHERE value > 0")
def beta_div_is(spark, d):
    return pairs(spark, d).where("value > 0").agg(F.round(measures.itakura_saito(), 6).alias("divergence"))


@query(""" SELECT round(sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) AS cosine_similarity,
  round(1 - sum((value - fitted) * (value - fitted)) / (var_pop(value) * count(value)), 6) AS r_squared, round(sum((value - fitted) * (value - fitted)), 6) AS rss,
  round(sqrt(sum((value - fitted) * (value - fitted))), 6) AS l2_norm, round(sum(CASE WHEN value > 0 THEN value * ln(value / fitted) ELSE 0 END - value + fitted), 6) AS beta_divergence,
  (SELECT round(1 - count(*) FILTER (weight <> 0) / CAST(count(*) AS DOUBLE), 6) FROM w0) AS sparsity_w, (SELECT round(1 - count(*) FILTER (weight <> 0) / CAST(count(*) AS DOUBLE), 6) FROM h0) AS sparsity_h FROM pr""")
def quality_series(spark, d):
    q = measures.quality(pairs(spark, d), w0(spark, d), h0(spark, d))
    return rounded(q, *q.columns)


@query(" SELECT sample, round(sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) AS model_fit, round(sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) < 0.4 AS low_fit FROM pr GROUP BY sample")
def model_fit(spark, d):
    return rounded(measures.model_fit(pairs(spark, d)), "model_fit").withColumn("low_fit", F.col("model_fit") < 0.4)


# Reading a model.

REP = """, a AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY sample ORDER BY weight DESC, sig_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs)"""


@query(REP + " SELECT sample, signature, sig_ord, round(weight, 6) AS weight, before < 0.9 AS representative FROM a")
def representative(spark, d):
    return rounded(analysis.representative(hs(spark, d)), "weight")


@query(" SELECT sample, arg_min(signature, sig_ord) AS primary_signature FROM (SELECT *, max(weight) OVER (PARTITION BY sample) AS top FROM hs) WHERE weight = top GROUP BY sample")
def primary(spark, d):
    return analysis.primary(hs(spark, d))


@query(" SELECT sample, max(weight) >= 0.3 AS is_monodominant, CASE WHEN max(weight) >= 0.3 THEN arg_min(signature, sig_ord) FILTER (weight = top) END AS signature_name FROM (SELECT *, max(weight) OVER (PARTITION BY sample) AS top FROM hs) GROUP BY sample")
def monodominant(spark, d):
    return analysis.monodominant(hs(spark, d), 0.3)


@query(' SELECT feature, signature, sig_ord, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY signature ORDER BY weight DESC, feature) AS INTEGER) AS "order" FROM w0 WHERE weight > 0.04')
def weight_order(spark, d):
    return rounded(analysis.weight_order(w0(spark, d), 0.04), "weight")


@query(""", a AS (SELECT *, row_number() OVER b AS r, coalesce(sum(weight) OVER (PARTITION BY signature ORDER BY weight DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w0 WINDOW b AS (PARTITION BY signature ORDER BY weight DESC, feature)),
b AS (SELECT *, sum(length(feature)) OVER (PARTITION BY signature ORDER BY r ROWS UNBOUNDED PRECEDING) AS letters FROM a WHERE before < 0.4 AND r <= 5)
SELECT signature, 'S' || sig_ord || '_' || substr(replace(string_agg(feature, '+' ORDER BY r), ' ', '_'), 1, 10) AS label FROM b WHERE r = 1 OR letters <= 10 GROUP BY signature, sig_ord""")
def signature_names(spark, d):
    return analysis.names_by_weight(w0(spark, d))


@query(", k AS (SELECT * FROM (VALUES ('ASIA', 1), ('EUROPE', 2)) t(signature, new_ord)) SELECT signature, feature, round(weight, 6) AS weight, new_ord FROM w0 JOIN k USING (signature)")
def slice_model(spark, d):
    wanted = spark.createDataFrame([("ASIA", 1), ("EUROPE", 2)], "signature string, new_ord int")
    return rounded(matrix.pick(w0(spark, d), "signature", wanted).select("signature", "feature", "weight", "new_ord"), "weight")


# Cohorts, alignment, joins.

LABELS = ", l AS (SELECT n_name AS sample, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey)"


def labels(spark, d):
    t = lambda n: inputs.table(spark, d, n)
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sample"), F.col("r_name").alias("label"))


@query(LABELS + " SELECT sample, feature, value, label FROM m1 JOIN l USING (sample) WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 5)")
def cohort_split(spark, d):
    return matrix.split_cohorts(m1(spark, d), labels(spark, d), 5)


@query(LABELS + ", u AS (SELECT feature, sample, value, 1 AS cohort_ord FROM m1 JOIN l USING (sample) WHERE label IN ('ASIA', 'EUROPE') UNION ALL SELECT feature, sample, 2 * value, 2 FROM m1 JOIN l USING (sample) WHERE label IN ('EUROPE', 'AFRICA')) SELECT u.* FROM u WHERE cohort_ord = (SELECT min(cohort_ord) FROM u v WHERE v.sample = u.sample)")
def cohort_union_dedupe(spark, d):
    cells = m1(spark, d).join(labels(spark, d), "sample")
    a = cells.where(F.col("label").isin("ASIA", "EUROPE")).select("feature", "sample", "value", F.lit(1).alias("cohort_ord"))
    b = cells.where(F.col("label").isin("EUROPE", "AFRICA")).select("feature", "sample", (F.col("value") * 2).alias("value"), F.lit(2).alias("cohort_ord"))
    return matrix.first_of_samples(a.unionByName(b))


@query(", u AS (SELECT feature, 'a_' || signature AS signature, weight FROM w0 WHERE feature NOT LIKE '%1' UNION ALL SELECT feature, 'b_' || signature, weight FROM w1 WHERE feature NOT LIKE '%2') SELECT f.feature, s.signature, round(coalesce(u.weight, 0), 6) AS weight FROM (SELECT DISTINCT feature FROM u) f CROSS JOIN (SELECT DISTINCT signature FROM u) s LEFT JOIN u USING (feature, signature)")
def align_signatures(spark, d):
    a = w0(spark, d).where("feature not like '%1'").select("feature", F.concat(F.lit("a_"), "signature").alias("signature"), "weight")
    b = w1(spark, d).where("feature not like '%2'").select("feature", F.concat(F.lit("b_"), "signature").alias("signature"), "weight")
    return rounded(matrix.align(a.unionByName(b)), "weight")


@query(LABELS + " SELECT sample, signature, round(weight, 6) AS weight, label FROM hs JOIN l USING (sample)")
def metadata_join(spark, d):
    return rounded(hs(spark, d).join(labels(spark, d), "sample").select("sample", "signature", "weight", "label"), "weight")


@query(LABELS + ", g AS (SELECT * FROM l WHERE label <> 'ASIA') SELECT s.sample, coalesce(g.label, 'NA') AS grp FROM (SELECT DISTINCT sample FROM m1) s LEFT JOIN g USING (sample)")
def group_ribbon(spark, d):
    known = labels(spark, d).where("label <> 'ASIA'")
    return m1(spark, d).select("sample").distinct().join(known, "sample", "left").select("sample", F.coalesce("label", F.lit("NA")).alias("grp"))


@query(" SELECT coalesce(a.rank, b.rank) AS rank, a.x, b.y FROM (VALUES (2, 0.5::DOUBLE), (3, 0.7::DOUBLE), (4, 0.6::DOUBLE)) a(rank, x) FULL JOIN (VALUES (3, 0.9::DOUBLE), (4, 0.8::DOUBLE), (5, 0.1::DOUBLE)) b(rank, y) ON a.rank = b.rank")
def stability_full_outer(spark, d):
    a = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.6)], "rank int, x double")
    return a.join(spark.createDataFrame([(3, 0.9), (4, 0.8), (5, 0.1)], "rank int, y double"), "rank", "full")


# Mapping.

MAP = ", mp AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#12'), ('Brand#13', 'Brand#12'), ('Brand#21', 'Other')) t(input_feature, model_feature)), ma AS (SELECT coalesce(model_feature, feature) AS feature, sample, sum(value) AS value FROM m1 LEFT JOIN mp ON feature = input_feature GROUP BY 1, 2)"


def small_map(spark):
    rows = [("Brand#11", "Brand#12", 1, "hard"), ("Brand#13", "Brand#12", 1, "hard"), ("Brand#21", "Other", 1, "hard")]
    return spark.createDataFrame(rows, "input_feature string, model_feature string, priority int, rule string")


@query(MAP + " SELECT feature, sample, value FROM ma")
def map_abundance(spark, d):
    return mapping.map_abundance(m1(spark, d), small_map(spark))


@query(MAP + ", e AS (SELECT DISTINCT feature FROM ma WHERE feature NOT IN (SELECT feature FROM w0)) SELECT feature, signature, round(weight, 6) AS weight FROM w0 WHERE feature IN (SELECT feature FROM ma) UNION ALL SELECT e.feature, s.signature, 0.0 FROM e CROSS JOIN (SELECT DISTINCT signature FROM w0) s")
def map_w(spark, d):
    return rounded(mapping.map_weights(w0(spark, d), map_abundance(spark, d)).select("feature", "signature", "weight"), "weight")


@query(MAP + """ SELECT (SELECT count(DISTINCT feature) FROM m1) AS before_features, (SELECT sum(CASE WHEN feature IN (SELECT feature FROM w0) THEN value ELSE 0 END) FROM m1) AS before_known_mass, (SELECT sum(value) FROM m1) AS before_mass,
 (SELECT count(DISTINCT feature) FROM ma) AS after_features, (SELECT sum(CASE WHEN feature IN (SELECT feature FROM w0) THEN value ELSE 0 END) FROM ma) AS after_known_mass, (SELECT sum(value) FROM ma) AS after_mass""")
def mapping_report(spark, d):
    return mapping.report(m1(spark, d), map_abundance(spark, d), w0(spark, d))


@query(" SELECT DISTINCT feature AS input_feature, feature AS model_feature, 1 AS priority, 'identical' AS rule FROM m1 WHERE feature IN (SELECT feature FROM w0)")
def match_identical(spark, d):
    return mapping.match_identical(w0(spark, d), m1(spark, d))


LINEAGES = ("k__B;p__X;c__Y;o__Z;f__F1;g__Gen_A", "B;X;Y;Z;F1;Gen", "B;X;Y;Z;F1;?", "B;X;;;;Other", "A;Q;;;;Other", "B;X;Y;Z;F2;New", "?;?;?", "B;X;Y;Z;F2;")


@query("""WITH t AS (SELECT regexp_replace(l, '[a-zA-Z]__', '', 'g') AS l FROM (VALUES """ + ", ".join(f"('{s}')" for s in LINEAGES) + """) v(l)), p AS (SELECT l, list_filter(string_split(replace(l, '?', ''), ';'), lambda z: trim(z) <> '') AS q FROM t)
SELECT l AS lineage, CASE WHEN contains(string_split(l, ';')[-1], '_') THEN regexp_replace(l, '(\\w+)_\\w$', '\\1') ELSE l END AS root, q[-1] AS final_rank, len(q) = 0 AS unknown, array_to_string(list_resize(string_split(l, ';'), 6, ''), ';') AS padded FROM p""", base=False)
def lineage_clean(spark, d):
    t = spark.createDataFrame([(s,) for s in LINEAGES], "lineage string").withColumn("lineage", mapping.strip_ranks(F.col("lineage")))
    c = F.col("lineage")
    return t.select("lineage", mapping.split_root(c).alias("root"), mapping.final_rank(c).alias("final_rank"), mapping.unknown(c).alias("unknown"), mapping.padded(c).alias("padded"))


# Comparing signatures.

COS = ", cp AS (SELECT a.signature AS a, b.signature AS b, sum(a.weight * b.weight) / (sqrt(sum(a.weight * a.weight)) * sqrt(sum(b.weight * b.weight))) AS cosine FROM w0 a JOIN w1 b USING (feature) GROUP BY 1, 2)"


@query(COS + " SELECT a, b, round(cosine, 6) AS cosine FROM cp")
def cosine_pairs(spark, d):
    return rounded(analysis.cosines(w0(spark, d), w1(spark, d)), "cosine")


@query("""WITH e AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 6) AS cosine FROM c a JOIN c b USING (i) GROUP BY 1, 2""", base=False)
def cosine_embeddings(spark, d):
    e = inputs.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy(F.col("label").alias("signature"), F.col("i").alias("feature")).agg(F.avg(F.col("x").cast("double")).alias("weight"))
    return rounded(analysis.cosines(c, c), "cosine")


@query(COS + ", s AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS n FROM cp), z AS (SELECT a, b, cosine FROM s WHERE n = 1) SELECT z.a, z.b, round(z.cosine, 6) AS pair_cosine, round(max(cp.cosine), 6) AS max_off_cosine FROM z JOIN cp ON z.a = cp.a AND cp.b <> z.b GROUP BY 1, 2, 3")
def max_off_cosine(spark, d):
    cos = analysis.cosines(w0(spark, d), w1(spark, d))
    given = cos.groupBy("a").agg(F.min("b").alias("b"))
    return rounded(analysis.best_off(cos, given), "pair_cosine", "max_off_cosine")


@query(None)
def signature_stability(spark, d):
    fits = analysis.top_models(models.decompose(matrix.share(m2(spark, d), "sample"), [2, 3], 3, max_iter=200), "beta_divergence", 3)
    w = models.weights_of(fits).join(fits.select("model_id", "rank", "position"), "model_id")
    best = w.where("position = 1").select("rank", "feature", F.col("signature").alias("a"), F.col("weight").alias("x"))
    other = w.where("position > 1").select("rank", "model_id", "feature", F.col("signature").alias("b"), F.col("weight").alias("y"))
    cos = best.join(other, ["rank", "feature"]).groupBy("rank", "model_id", "a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))
    matched = models.match(cos, "model_id").join(fits.select("model_id", F.col("rank").alias("k")), "model_id")
    return matched.groupBy("k").agg(F.avg("pair_cosine").alias("signature_similarity"))


# Holdout.

SHUFFLE = """, sh AS (SELECT unnest([0, 1]) AS shuffle),
fp AS (SELECT shuffle, feature, row_number() OVER (PARTITION BY shuffle ORDER BY md5('0|' || shuffle || '|' || feature), feature) - 1 AS pos, count(*) OVER (PARTITION BY shuffle) AS n FROM (SELECT DISTINCT feature FROM m1) CROSS JOIN sh),
sp AS (SELECT shuffle, sample, row_number() OVER (PARTITION BY shuffle ORDER BY md5('0|' || shuffle || '|' || sample), sample) - 1 AS pos, count(*) OVER (PARTITION BY shuffle) AS n FROM (SELECT DISTINCT sample FROM m1) CROSS JOIN sh),
fb AS (SELECT shuffle, feature, least(pos // (n // 3), 2) AS row_block FROM fp), sb AS (SELECT shuffle, sample, least(pos // (n // 3), 2) AS col_block FROM sp),
cells AS (SELECT shuffle, feature, sample, value, CAST(row_block AS INTEGER) AS row_block, CAST(col_block AS INTEGER) AS col_block FROM m1 JOIN fb USING (feature) JOIN sb USING (shuffle, sample)),
fo AS (SELECT *, CASE WHEN row_block = fold // 3 AND col_block = fold % 3 THEN 'A' WHEN row_block = fold // 3 THEN 'B' WHEN col_block = fold % 3 THEN 'C' ELSE 'D' END AS part FROM cells CROSS JOIN (SELECT unnest(range(9)) AS fold)),
ro AS (SELECT a.shuffle, a.fold, a.feature, a.sample, a.value, b.b * c.c / d.d AS fitted FROM fo a JOIN (SELECT shuffle, fold, feature, sum(value) AS b FROM fo WHERE part = 'B' GROUP BY ALL) b USING (shuffle, fold, feature)
  JOIN (SELECT shuffle, fold, sample, sum(value) AS c FROM fo WHERE part = 'C' GROUP BY ALL) c USING (shuffle, fold, sample) JOIN (SELECT shuffle, fold, sum(value) AS d FROM fo WHERE part = 'D' GROUP BY ALL) d USING (shuffle, fold) WHERE a.part = 'A'),
rm AS (SELECT shuffle, fold, 1 - sum((value - fitted) * (value - fitted)) / (var_pop(value) * count(value)) AS r_squared, sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)) AS cosine_similarity FROM ro GROUP BY ALL)"""


def cells(spark, d):
    return holdout.split(inputs.held_brands(spark, d), 2)


@query(SHUFFLE + " SELECT shuffle, feature, CAST(pos AS INTEGER) AS pos FROM fp")
def shuffle_positions(spark, d):
    return holdout.positions(m1(spark, d), "feature", 2).select("shuffle", "feature", F.col("pos").cast("int").alias("pos"))


@query(SHUFFLE + " SELECT * FROM cells")
def split_blocks(spark, d):
    return cells(spark, d)


@query(SHUFFLE + " SELECT shuffle, CAST(fold AS INTEGER) AS fold, part, count(*) AS n FROM fo GROUP BY ALL")
def fold_parts(spark, d):
    return holdout.folds(cells(spark, d)).groupBy("shuffle", "fold", "part").agg(F.count("*").alias("n"))


@query(SHUFFLE + " SELECT shuffle, CAST(fold AS INTEGER) AS fold, part, sum(value) AS total FROM fo GROUP BY ALL")
def fold_sums(spark, d):
    return holdout.folds(cells(spark, d)).groupBy("shuffle", "fold", "part").agg(F.sum("value").alias("total"))


@query(SHUFFLE + " SELECT shuffle, CAST(fold AS INTEGER) AS fold, feature, sample, value, round(fitted, 4) AS fitted FROM ro")
def bicv_rank1(spark, d):
    return rounded(holdout.rank_one(holdout.folds(cells(spark, d))), "fitted", digits=4)


def rank1_results(spark, d):
    y = holdout.rank_one(holdout.folds(cells(spark, d)))
    return y.groupBy("shuffle", "fold").agg(measures.r_squared().alias("r_squared"), measures.cosine().alias("cosine_similarity"))


@query(SHUFFLE + " SELECT shuffle, round(avg(r_squared), 6) AS r_squared, round(avg(cosine_similarity), 6) AS cosine_similarity FROM rm GROUP BY shuffle")
def bicv_rank1_table(spark, d):
    return rounded(rank1_results(spark, d).groupBy("shuffle").agg(F.avg("r_squared").alias("r_squared"), F.avg("cosine_similarity").alias("cosine_similarity")), "r_squared", "cosine_similarity")




@query("WITH t AS (SELECT r.rank, s.shuffle, f.fold, (rank * 10 + (shuffle * 3) % 7 + fold % 4) / 100.0::DOUBLE AS v FROM (SELECT unnest(range(2, 7)) AS rank) r CROSS JOIN (SELECT unnest(range(5)) AS shuffle) s CROSS JOIN (SELECT unnest(range(9)) AS fold) f), m AS (SELECT rank, shuffle, avg(v) AS v FROM t GROUP BY ALL) SELECT rank, round(median(v), 6) AS cosine_similarity FROM m GROUP BY rank", base=False)
def rank_median_curve(spark, d):
    axis = lambda a, b, n: spark.range(a, b).select(F.col("id").alias(n))
    t = axis(2, 7, "rank").crossJoin(axis(0, 5, "shuffle")).crossJoin(axis(0, 9, "fold"))
    t = t.withColumn("cosine_similarity", (F.col("rank") * 10 + (F.col("shuffle") * 3) % 7 + F.col("fold") % 4) / 100.0)
    table = t.groupBy("rank", "shuffle").agg(F.avg("cosine_similarity").alias("cosine_similarity"))
    return rounded(holdout.rank_curve(table), "cosine_similarity")


@query("WITH t AS (SELECT a.alpha, s.s, 0.9 - a.alpha * 0.05 + (s.s % 5) * 0.02 AS r FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) a(alpha) CROSS JOIN (SELECT unnest(range(10)) AS s) s), m AS (SELECT alpha, avg(r) AS mean, stddev_pop(r) AS sd FROM t GROUP BY alpha), b AS (SELECT mean - sd AS bar FROM m WHERE alpha = 0), o AS (SELECT alpha, min(CASE WHEN mean >= bar THEN 1 ELSE 0 END) OVER (ORDER BY alpha) AS ok FROM m CROSS JOIN b) SELECT max(alpha) AS best_alpha FROM o WHERE ok = 1", base=False)
def regu_alpha_scan(spark, d):
    a = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (1.0,), (2.0,)], "alpha double")
    t = a.crossJoin(spark.range(10)).withColumn("r_squared", F.lit(0.9) - F.col("alpha") * 0.05 + (F.col("id") % 5) * 0.02)
    return holdout.best_alpha(t)


@query(None)
def bicv_multi_rank(spark, d):
    return holdout.cross_validate(cells(spark, d), [2, 3], max_iter=100)


@query(None)
def rank_selection(spark, d):
    return holdout.rank_curve(holdout.summary(holdout.cross_validate(holdout.split(x1(spark, d), 2), [2, 3, 4], max_iter=100)))


@query(None)
def regu_selection(spark, d):
    alphas = [0.0, *[2.0**e / 25 for e in range(-5, 2)]]
    return holdout.best_alpha(holdout.cross_validate(holdout.split(x1(spark, d), 2), [2], alphas, max_iter=100, l1_ratio=1.0))


# Fitting and applying.

ROUNDS = 4
_TURN = """, y{t} AS (SELECT w0.feature, g{p}.sample, sum(w0.weight * g{p}.weight) AS y FROM w0 JOIN g{p} USING (signature) GROUP BY 1, 2), t{t} AS (SELECT x1.sample, w0.signature, sum(w0.weight * x1.value / y{t}.y) AS top FROM x1 JOIN y{t} USING (feature, sample) JOIN w0 ON w0.feature = x1.feature GROUP BY 1, 2),
g{t} AS (SELECT g{p}.sample, g{p}.signature, g{p}.sig_ord, g{p}.weight * t{t}.top / ms.mass AS weight FROM g{p} JOIN t{t} USING (sample, signature) JOIN ms USING (signature))"""
TRANSFORM = (
    ", ms AS (SELECT signature, sig_ord, sum(weight) AS mass FROM w0 GROUP BY 1, 2), st AS (SELECT sqrt(sum(value) / ((SELECT count(DISTINCT feature) FROM w0) * count(DISTINCT sample)) / (SELECT count(*) FROM ms)) AS s FROM x1), g0 AS (SELECT s.sample, ms.signature, ms.sig_ord, st.s AS weight FROM (SELECT DISTINCT sample FROM x1) s CROSS JOIN ms CROSS JOIN st)"
    + "".join(_TURN.format(t=t, p=t - 1) for t in range(1, ROUNDS + 1))
)


@query(TRANSFORM + f" SELECT sample, signature, sig_ord, round(weight, 6) AS weight FROM g{ROUNDS}")
def transform_fixed_w(spark, d):
    return rounded(models.transform(x1(spark, d), w0(spark, d), ROUNDS), "weight")


@query(TRANSFORM + f" SELECT sample, signature, sig_ord, round(weight, 6) AS weight FROM g{ROUNDS}")
def transform_joined(spark, d):
    x, w = x1(spark, d), w0(spark, d)
    size = x.agg(F.sum("value").alias("s"), F.count_distinct("sample").alias("n")).first()
    shape = w.agg(F.count_distinct("feature").alias("m"), F.count_distinct("signature").alias("k")).first()
    begin = (size["s"] / (shape["m"] * size["n"]) / shape["k"]) ** 0.5
    return rounded(models.transform_joined(x, w, begin, ROUNDS), "weight")


@query(TRANSFORM + f", b AS (SELECT *, max(weight) OVER (PARTITION BY sample) AS top FROM g{ROUNDS}) SELECT sample, arg_min(signature, sig_ord) AS primary_signature FROM b WHERE weight = top GROUP BY sample")
def transform_primary(spark, d):
    return analysis.primary(models.transform(x1(spark, d), w0(spark, d), ROUNDS))


@query(None)
def decompositions_topn(spark, d):
    fits = models.decompose(x1(spark, d), [2, 3], 4, max_iter=200)
    return analysis.top_models(fits, "beta_divergence", 2).select("rank", "position", "model_id", "n_iter", "beta_divergence", "cosine_similarity")


# Agreement of models.

CONS = ", mm AS (SELECT 'r' AS model_id, sample, signature, weight FROM h0 UNION ALL SELECT 's', sample, signature, weight FROM hs), tp AS (SELECT *, max(weight) OVER (PARTITION BY model_id, sample) AS top FROM mm), hd AS (SELECT model_id, sample, signature FROM tp WHERE weight = top), cs AS (SELECT DISTINCT a.model_id, a.sample AS i, b.sample AS j, 1.0::DOUBLE AS c FROM hd a JOIN hd b USING (model_id, signature) WHERE a.sample >= b.sample), cb AS (SELECT 5 AS rank, i, j, sum(c) / 2 AS c FROM cs GROUP BY i, j)"


def two_models(spark, d):
    a = h0(spark, d).select(F.lit("r").alias("model_id"), "sample", "signature", "weight")
    return a.unionByName(hs(spark, d).select(F.lit("s").alias("model_id"), "sample", "signature", "weight"))


def mean_of_two(spark, d):
    runs = spark.createDataFrame([("r", 5), ("s", 5)], "model_id string, rank int")
    return analysis.mean_consensus(analysis.consensus(two_models(spark, d)), runs)


@query(CONS + " SELECT * FROM cs")
def consensus_pairs(spark, d):
    return analysis.consensus(two_models(spark, d))


@query(CONS + " SELECT * FROM cb")
def cbar(spark, d):
    return mean_of_two(spark, d)


@query(CONS + " SELECT rank, round((sum(4 * (c - 0.5) * (c - 0.5)) + (25 * 24 / 2.0 - count(*) FILTER (i <> j)) + 25 * 24 / 2.0) / 625.0, 6) AS dispersion FROM cb GROUP BY rank")
def dispersion_ref(spark, d):
    return rounded(analysis.dispersion(mean_of_two(spark, d), 25, symmetric=False), "dispersion")


@query(CONS + " SELECT rank, round((sum(4 * (c - 0.5) * (c - 0.5) * CASE WHEN i <> j THEN 2 ELSE 1 END) + 2 * (25 * 24 / 2.0 - count(*) FILTER (i <> j))) / 625.0, 6) AS dispersion FROM cb GROUP BY rank")
def dispersion_sym(spark, d):
    return rounded(analysis.dispersion(mean_of_two(spark, d), 25), "dispersion")


@query(None)
def cophenetic(spark, d):
    import numpy as np
    import pandas as pd

    from partwise.kernels import small

    def run(b: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(b["i"]) | set(b["j"]))
        at = {n: k for k, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for i, j, c in zip(b["i"], b["j"], b["c"], strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = c
        return pd.DataFrame({"rank": [int(b["rank"].iloc[0])], "cophenetic_correlation": [small.cophenetic(1 - m)]})

    return mean_of_two(spark, d).groupBy("rank").applyInPandas(run, "rank int, cophenetic_correlation double")


# Tests between groups.

RANKS = LABELS + """, v AS (SELECT 'S_' || signature AS test, label AS grp, sample, round(weight, 6) AS value FROM h0 JOIN l USING (sample)), rk AS (SELECT *, count(*) OVER (PARTITION BY test, value) AS ties, rank() OVER (PARTITION BY test ORDER BY value) + (count(*) OVER (PARTITION BY test, value) - 1) / 2.0 AS rank FROM v),
rs AS (SELECT test, grp, count(*) AS n, sum(rank) AS r FROM rk GROUP BY ALL), wt AS (SELECT test, CAST(count(*) AS DOUBLE) AS t, sum(ties * ties - 1) AS tie FROM rk GROUP BY ALL)"""


def ranked(spark, d, two=False):
    v = h0(spark, d).join(labels(spark, d), "sample").select(F.concat(F.lit("S_"), "signature").alias("test"), F.col("label").alias("grp"), "sample", F.round("weight", 6).alias("value"))
    return stats.average_ranks(v.where("grp in ('ASIA', 'EUROPE')") if two else v, ["test"])


@query(RANKS + " SELECT test, sample, grp, value, ties, CAST(rank AS DOUBLE) AS rank FROM rk")
def rank_average_ties(spark, d):
    return ranked(spark, d).select("test", "sample", "grp", "value", "ties", "rank")


@query(RANKS.replace("JOIN l USING (sample)), rk", "JOIN l USING (sample) WHERE label IN ('ASIA', 'EUROPE')), rk") + " SELECT a.test, CAST(a.r - a.n * (a.n + 1) / 2.0 AS DOUBLE) AS u, round((greatest(a.r - a.n * (a.n + 1) / 2.0, a.n * b.n - (a.r - a.n * (a.n + 1) / 2.0)) - a.n * b.n / 2.0 - 0.5) / sqrt(a.n * b.n / 12.0 * (t + 1 - tie / (t * (t - 1)))), 6) AS z FROM rs a JOIN rs b ON a.test = b.test AND a.grp < b.grp JOIN wt ON wt.test = a.test")
def mann_whitney_u(spark, d):
    return rounded(stats.mann_whitney(ranked(spark, d, True), ["test"]), "z")


HALVES = RANKS.replace(LABELS, ", l AS (SELECT n_name AS sample, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM nation)")


@query(HALVES + " SELECT a.test, CAST(a.r - a.n * (a.n + 1) / 2.0 AS DOUBLE) AS u, round((greatest(a.r - a.n * (a.n + 1) / 2.0, a.n * b.n - (a.r - a.n * (a.n + 1) / 2.0)) - a.n * b.n / 2.0 - 0.5) / sqrt(a.n * b.n / 12.0 * (t + 1 - tie / (t * (t - 1)))), 6) AS z FROM rs a JOIN rs b ON a.test = b.test AND a.grp < b.grp JOIN wt ON wt.test = a.test")
def mann_whitney_parity(spark, d):
    halves = inputs.table(spark, d, "nation").select(F.col("n_name").alias("sample"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("grp"))
    v = h0(spark, d).join(halves, "sample").select(F.concat(F.lit("S_"), "signature").alias("test"), "grp", "sample", F.round("weight", 6).alias("value"))
    return rounded(stats.mann_whitney(stats.average_ranks(v, ["test"]), ["test"]), "z")


KW = " SELECT rs.test, round((12 / (any_value(t) * (any_value(t) + 1)) * sum(r * r / n) - 3 * (any_value(t) + 1)) / (1 - any_value(tie) / (any_value(t) * any_value(t) * any_value(t) - any_value(t))), 6) AS h, count(*) - 1 AS df FROM rs JOIN wt USING (test) GROUP BY rs.test"


@query(RANKS + KW)
def kruskal_h(spark, d):
    return rounded(stats.kruskal(ranked(spark, d), ["test"]), "h")


@query(RANKS + " SELECT a.test, a.grp AS a, b.grp AS b, round(abs(a.r / a.n - b.r / b.n) / sqrt((t * (t + 1) / 12 - tie / (12 * (t - 1))) * (1.0 / a.n + 1.0 / b.n)), 6) AS z FROM rs a JOIN rs b ON a.test = b.test AND a.grp < b.grp JOIN wt ON wt.test = a.test")
def dunn_z(spark, d):
    return rounded(stats.dunn(ranked(spark, d), ["test"]), "z")


@query(None)
def univariate_tests(spark, d):
    k = stats.kruskal(ranked(spark, d), ["test"]).withColumn("p", stats.chi2_tail("h", "df")).withColumn("test_id", F.col("test"))
    k = stats.adjusted(k, [], out="global_adj_p")
    return k.select("test", "h", "df", "p", "global_adj_p", stats.written(F.col("p"), F.col("global_adj_p")).alias("significance"))


PS = "(SELECT c_nationkey AS test_id, ((sum(c_custkey) % 997) + 1) * ((sum(c_custkey) % 997) + 1) / 1000000.0::DOUBLE AS p FROM customer GROUP BY 1)"
BH = f"WITH a AS (SELECT test_id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, test_id) AS raw FROM {PS}), b AS (SELECT test_id, p, least(1.0::DOUBLE, min(raw) OVER (ORDER BY p DESC, test_id DESC)) AS adj_p FROM a)"


def p_values(spark, d):
    """A number between 0 and 1 for each nation, many of them small."""
    n = F.sum("c_custkey") % 997 + 1
    return inputs.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("test_id")).agg((n * n / 1000000.0).alias("p"))


@query(BH + " SELECT test_id, round(p, 6) AS p, round(adj_p, 6) AS adj_p FROM b", base=False)
def bh_adjust(spark, d):
    return rounded(stats.adjusted(p_values(spark, d), []), "p", "adj_p")


@query(BH + " SELECT test_id, CASE WHEN adj_p <= 0.01 THEN '***' WHEN adj_p <= 0.05 THEN '**' WHEN adj_p <= 0.1 THEN '*' WHEN p <= 0.01 THEN '..' WHEN p <= 0.05 THEN '.' ELSE '' END AS significance FROM b", base=False)
def signif_format(spark, d):
    t = stats.adjusted(p_values(spark, d), [])
    return t.select("test_id", stats.written(F.col("p"), F.col("adj_p")).alias("significance"))


# Combining.

SIGS = ", sg AS (SELECT 'region' AS cohort, 'r' AS model_id, 5 AS rank, 'r_' || signature AS signature_id, feature, weight FROM w0 UNION ALL SELECT 'segment', 's', 5, 's_' || signature, feature, weight FROM w1), mb AS (SELECT DISTINCT CASE WHEN signature_id IN ('r_ASIA', 's_BUILDING', 's_MACHINERY') THEN 'c1' ELSE signature_id END AS cluster_id, signature_id FROM sg)"


def signatures(spark, d):
    a = w0(spark, d).select(F.lit("region").alias("cohort"), F.lit("r").alias("model_id"), F.lit(5).alias("rank"), F.concat(F.lit("r_"), "signature").alias("signature_id"), "feature", "weight")
    b = w1(spark, d).select(F.lit("segment").alias("cohort"), F.lit("s").alias("model_id"), F.lit(5).alias("rank"), F.concat(F.lit("s_"), "signature").alias("signature_id"), "feature", "weight")
    return a.unionByName(b)


def members(spark, d):
    ids = signatures(spark, d).select("signature_id").distinct()
    return ids.select(F.when(F.col("signature_id").isin("r_ASIA", "s_BUILDING", "s_MACHINERY"), "c1").otherwise(F.col("signature_id")).alias("cluster_id"), "signature_id")


@query(SIGS + ", d AS (SELECT DISTINCT signature_id, model_id, cohort FROM sg) SELECT cluster_id, count(DISTINCT signature_id) AS n_signatures, count(DISTINCT model_id) AS n_models, count(DISTINCT cohort) AS n_cohorts FROM mb JOIN d USING (signature_id) GROUP BY cluster_id")
def support_counts(spark, d):
    return combining.support(members(spark, d), signatures(spark, d))


@query(SIGS + ", d AS (SELECT DISTINCT signature_id, model_id, cohort, rank FROM sg) SELECT cluster_id, cohort, rank, count(DISTINCT model_id) / 1.0::DOUBLE AS share, true AS specific FROM mb JOIN d USING (signature_id) GROUP BY ALL")
def cohort_specific(spark, d):
    return combining.cohort_specific(members(spark, d), signatures(spark, d))


MEANS = ", ce AS (SELECT cluster_id, feature, sum(weight) / any_value(n) AS weight FROM mb JOIN sg USING (signature_id) JOIN (SELECT cluster_id, count(*) AS n FROM mb GROUP BY 1) USING (cluster_id) GROUP BY 1, 2)"


@query(SIGS + MEANS + " SELECT cluster_id, feature, round(weight, 6) AS weight FROM ce")
def cluster_mean(spark, d):
    return rounded(combining.means(members(spark, d), signatures(spark, d)), "weight")


@query(SIGS + MEANS + ", o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, feature) AS place FROM ce) SELECT cluster_id, feature, round(weight, 6) AS weight, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5")
def member_weights(spark, d):
    return rounded(combining.top_features(members(spark, d), signatures(spark, d)), "weight")


@query(None)
def merge_similar(spark, d):
    alone = members(spark, d).withColumn("cluster_id", F.col("signature_id"))
    return combining.merge_similar(alone, signatures(spark, d), 0.995)


@query(SIGS + ", d AS (SELECT DISTINCT signature_id, model_id, cohort FROM sg) SELECT cluster_id, count(DISTINCT signature_id) AS n_signatures, count(DISTINCT model_id) AS n_models, count(DISTINCT cohort) AS n_cohorts, 2 AS total, 1 AS needed, count(DISTINCT signature_id) < 2 AS low FROM mb JOIN d USING (signature_id) GROUP BY cluster_id")
def remove_low_support(spark, d):
    return combining.low_support(members(spark, d), signatures(spark, d))


# Ordination and plot data.


@query(", hw AS (SELECT sample, signature, weight / max(weight) OVER (PARTITION BY signature) AS v FROM h0), hd AS (SELECT sample, signature, v / sum(v) OVER (PARTITION BY sample) AS v FROM hw) SELECT a.sample AS i, b.sample AS j, round(sum(abs(a.v - b.v)) / sum(a.v + b.v), 6) AS distance FROM hd a JOIN hd b USING (signature) WHERE a.sample < b.sample GROUP BY 1, 2")
def bray_curtis(spark, d):
    h = matrix.wisconsin(h0(spark, d), "signature", "sample", "weight")
    return rounded(analysis.bray_curtis(h, "sample", "signature", "weight"), "distance")


@query(None)
def pcoa(spark, d):
    import numpy as np
    import pandas as pd

    from partwise.kernels import small

    def run(b: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(b["i"]) | set(b["j"]))
        at = {n: k for k, n in enumerate(names)}
        m = np.zeros((len(names), len(names)))
        for i, j, x in zip(b["i"], b["j"], b["distance"], strict=True):
            m[at[i], at[j]] = m[at[j], at[i]] = np.sqrt(x)
        points, _ = small.principal_coordinates(m)
        return pd.DataFrame({"sample": names, "pc1": points[:, 0], "pc2": points[:, 1]})

    return bray_curtis(spark, d).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "sample string, pc1 double, pc2 double")


@query(LABELS + ", hp AS (SELECT sample, signature, weight / sum(weight) OVER (PARTITION BY sample) AS rel FROM h0), mf AS (SELECT sample, sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)) AS f FROM pr GROUP BY sample) SELECT sample, signature, round(rel, 6) AS rel_weight, label AS grp, round(f, 6) AS model_fit FROM hp JOIN l USING (sample) JOIN mf USING (sample)")
def plotdata_relative_weight(spark, d):
    h = matrix.scaled(h0(spark, d), "h").select("sample", "signature", F.round("weight", 6).alias("rel_weight"))
    return h.join(labels(spark, d).withColumnRenamed("label", "grp"), "sample").join(rounded(measures.model_fit(pairs(spark, d)), "model_fit"), "sample")


@query(" SELECT feature, signature, round(weight, 6) AS rel_weight FROM w0 WHERE weight >= 0.04")
def plotdata_feature_weight(spark, d):
    return matrix.scaled(w0(spark, d), "w").where("weight >= 0.04").select("feature", "signature", F.round("weight", 6).alias("rel_weight"))


@query(LABELS + " SELECT sample, round(sum(value * fitted) / sqrt(sum(value * value) * sum(fitted * fitted)), 6) AS model_fit, any_value(label) AS grp FROM pr JOIN l USING (sample) GROUP BY sample")
def plotdata_modelfit(spark, d):
    return rounded(measures.model_fit(pairs(spark, d)), "model_fit").join(labels(spark, d).withColumnRenamed("label", "grp"), "sample")


# Synthetic sources.


@query(None)
def synth_blocks(spark, d):
    from partwise.sources.tables import blocks

    return blocks(spark)


@query(None)
def synth_dense(spark, d):
    from partwise.sources.tables import dense

    return dense(spark)
