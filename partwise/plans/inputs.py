"""Matrices and models from the test tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators.matrix import fill, share
from partwise.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What was written once for the query that is being built, by name.
_HELD: dict[tuple[str, int, str], DataFrame] = {}


def forget() -> None:
    """Begin another query."""
    _HELD.clear()


def held_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part brand, customer nation and market segment, built and written once a query, whatever number of tables is derived from it.

    Lines are shuffled for their part and their order only: orders find their customer first, by keys, and nations
    are named after the sum.
    """
    key = ("cells", id(spark), sf_dir)
    if key not in _HELD:
        t = lambda n: table(spark, sf_dir, n)
        goods = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand", "l_quantity")
        buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", "c_mktsegment")
        lines = goods.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        cells = lines.groupBy("p_brand", "c_nationkey", "c_mktsegment").agg(F.sum("l_quantity").alias("quantity"))
        nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
        cells = cells.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        _HELD[key] = cut(cells.select("p_brand", "n_name", "c_mktsegment", "quantity"))
    return _HELD[key]


def brand_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part brand and customer nation; every cell."""
    cells = held_cells(spark, sf_dir)
    return fill(cells.groupBy(F.col("p_brand").alias("feature"), F.col("n_name").alias("sample")).agg(F.sum("quantity").alias("value")))


def held_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand matrix, written once a query."""
    key = ("brands", id(spark), sf_dir)
    if key not in _HELD:
        _HELD[key] = cut(brand_by_nation(spark, sf_dir))
    return _HELD[key]


def type_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by part type and supplier; every cell."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cells = lines.groupBy(F.col("p_type").alias("feature"), F.col("l_suppkey").cast("string").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    return fill(cells)


def event_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event value by type and user; cells that occur."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("feature"), F.col("user_id").cast("string").alias("sample")).agg(F.sum("value").alias("value"))


def region_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed model: brand weights by region of the customer, each signature adding up to 1."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = held_brands(spark, sf_dir).join(nations, F.col("sample") == F.col("n_name"))
    sums = cells.groupBy("feature", F.col("r_name").alias("signature"), (F.col("r_regionkey") + 1).alias("sig_ord")).agg(F.sum("value").alias("weight"))
    return share(sums, "signature", "weight")


def segment_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another model: brand weights by market segment, each signature adding up to 1."""
    cells = held_cells(spark, sf_dir).groupBy(F.col("p_brand").alias("feature"), F.col("c_mktsegment").alias("signature")).agg(F.sum("quantity").alias("weight"))
    return share(cells, "signature", "weight")


def fixed_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample weights: inner products of the scaled matrix's samples with the fixed model's signatures."""
    x = share(held_brands(spark, sf_dir), "sample")
    pairs = x.join(region_weights(spark, sf_dir), "feature")
    return pairs.groupBy("sample", "signature", "sig_ord").agg(F.sum(F.col("value") * F.col("weight")).alias("weight"))


def sharp_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample weights with a clear leader: the customers' quantity by segment, cubed, scaled by sample."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = F.array(*[F.lit(s) for s in SEGMENTS])
    cells = rows.groupBy(F.col("n_name").alias("sample"), F.col("c_mktsegment").alias("signature")).agg(F.count("*").alias("n"))
    cells = cells.select("sample", "signature", F.array_position(segments, F.col("signature")).cast("int").alias("sig_ord"), F.pow(F.col("n").cast("double"), 3).alias("weight"))
    return share(cells, "sample", "weight")


#: The market segments in order.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

BASE = """
lines AS (SELECT p_brand, p_type, n_name, r_name, r_regionkey, c_mktsegment, l_suppkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m1s AS (SELECT p_brand AS feature, n_name AS sample, sum(l_quantity) AS value FROM lines GROUP BY 1, 2),
m1 AS (SELECT f.feature, s.sample, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT feature FROM m1s) f CROSS JOIN (SELECT DISTINCT sample FROM m1s) s LEFT JOIN m1s m USING (feature, sample)),
m2s AS (SELECT p_type AS feature, CAST(l_suppkey AS VARCHAR) AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m2 AS (SELECT f.feature, s.sample, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT feature FROM m2s) f CROSS JOIN (SELECT DISTINCT sample FROM m2s) s LEFT JOIN m2s m USING (feature, sample)),
m3 AS (SELECT event_type AS feature, CAST(user_id AS VARCHAR) AS sample, sum(value) AS value FROM events GROUP BY 1, 2),
x1 AS (SELECT feature, sample, CASE WHEN sum(value) OVER (PARTITION BY sample) <> 0 THEN value / sum(value) OVER (PARTITION BY sample) END AS value FROM m1),
w0s AS (SELECT feature, r_name AS signature, r_regionkey + 1 AS sig_ord, sum(value) AS weight FROM m1 JOIN nation ON sample = n_name JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
w0 AS (SELECT feature, signature, sig_ord, weight / sum(weight) OVER (PARTITION BY signature) AS weight FROM w0s),
w1s AS (SELECT p_brand AS feature, c_mktsegment AS signature, sum(l_quantity) AS weight FROM lines GROUP BY 1, 2),
w1 AS (SELECT feature, signature, weight / sum(weight) OVER (PARTITION BY signature) AS weight FROM w1s),
h0 AS (SELECT sample, signature, sig_ord, sum(value * weight) AS weight FROM x1 JOIN w0 USING (feature) GROUP BY 1, 2, 3),
hss AS (SELECT n_name AS sample, c_mktsegment AS signature, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
hs AS (SELECT sample, signature, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], signature) AS INTEGER) AS sig_ord, pow(CAST(n AS DOUBLE), 3) / sum(pow(CAST(n AS DOUBLE), 3)) OVER (PARTITION BY sample) AS weight FROM hss),
wh AS (SELECT w0.feature, h0.sample, sum(w0.weight * h0.weight) AS fitted FROM w0 JOIN h0 USING (signature) GROUP BY 1, 2),
pr AS (SELECT feature, sample, value, fitted FROM x1 JOIN wh USING (feature, sample))
"""
