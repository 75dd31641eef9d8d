"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of all words, but at
most ``cap`` times its own words, the excess reshared by weight.  Within a
source a document is due ``e = min(cap, c * k)`` copies, where ``k`` is the
length in binary of its word count (longer documents are somewhat likelier) and
``c`` makes the words due add up to the target.  ``floor(e)`` copies are
certain.  The fraction ``f`` left over is the inclusion probability of one more
copy: documents are ranked by their random odds over their inclusion odds,
``u/(1-u) / (f/(1-f))`` (Rosen's Pareto order sampling), and the sample is the
head of that order whose words come nearest to what is missing; its size is
fixed in words.

Plan: one scan counts words; a histogram (source, k), at most 64 rows a source,
yields all rates; a histogram (source, rank bucket) yields the bucket that holds
the cut; only that bucket's rows, about one in ``BUCKETS``, are ordered.  So a
source with most of the rows is never gathered in one task.  The decision is
then a row-wise expression on a few numbers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import once, small, word_count
from partwise.session import cut

#: Rank buckets a source.  A source of 10**10 documents has about 150,000 in one.
BUCKETS = 65_536
WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point, null last, take the weights in turn.  The level of
    the filling is the largest of the levels that result when the first i
    sources, by cap over weight, stop at their caps.  No words: targets of 0.
    The one window without a key runs over a row a source.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.withColumn("place", F.row_number().over(turn))
    pick = F.array(*map(F.lit, weights))
    listed = listed.withColumn("weight", F.element_at(pick, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    listed = listed.withColumn("most", F.col("source_size") * cap)
    up = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = listed.withColumn("level", (F.sum("source_size").over(every) - before).cast("double") / rest)
    level = F.max("level").over(every)
    return listed.select("source", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"))


def due(rate: Column, size: Column, cap: int) -> Column:
    """Copies due, a fraction."""
    return F.least(F.lit(float(cap)), rate * length_class(size))


def length_class(size: Column) -> Column:
    """Binary digits of the word count: 1 for 0 and 1, 2 for 2 and 3, and so on."""
    return F.length(F.bin(size))


def draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def rank(key: Column, due_: Column, seed: str) -> Column:
    """Pareto rank q as q / (1 + q), which orders alike and lies in (0, 1); null if nothing is left to draw."""
    f, u = due_ - F.floor(due_), draw(key, seed)
    return F.when(f > 0, u * (1 - f) / (u * (1 - f) + (1 - u) * f))


def rates(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``(key, source, size)`` to a row a source: ``source, source_size, target, rate, cut_bucket, cut_rank, cut_key``.

    Rows of one key and size share their decision.
    """
    steps = rows.groupBy("source", length_class(F.col("size")).alias("k")).agg(F.sum("size").alias("words"))
    steps = cut(steps)
    targets = source_targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    down = Window.partitionBy("source").orderBy(F.desc("k"))
    joined = steps.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("k")).over(down.rowsBetween(0, Window.unboundedFollowing))
    joined = joined.withColumn("level", F.when(rest > 0, (F.col("target") - before * cap) / rest).otherwise(0.0))
    joined = joined.withColumn("rate", F.max("level").over(Window.partitionBy("source")))
    certain = F.floor(F.least(F.lit(float(cap)), F.col("rate") * F.col("k")))
    params = cut(
        joined.groupBy("source").agg(
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("rate").alias("rate"),
            (F.first("target") - F.sum(certain * F.col("words"))).alias("missing"),
        )
    )
    known = params.select(F.col("source").alias("s"), "rate", "missing")
    ranked = rows.join(small(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranked = ranked.withColumn("rank", rank(F.col("key"), due(F.col("rate"), F.col("size"), cap), seed)).where("rank is not null and size > 0")
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * BUCKETS))
    counted = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    edge = counted.where("before < missing and missing <= before + words").select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "before"
    )
    near = ranked.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    near = near.groupBy("source", "bucket", "rank", "key", "size").agg(F.sum("size").alias("words"), F.first("before").alias("start"), F.first("missing").alias("missing"))
    order = Window.partitionBy("source", "bucket").orderBy("rank", F.asc_nulls_first("key"), "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    last = near.groupBy("source", "bucket").agg(F.max(F.when(F.col("start") * 2 + F.col("words") <= F.col("missing") * 2, F.struct("rank", low_key(F.col("key")).alias("key"), "size"))).alias("last"))
    last = last.select(F.col("source").alias("s"), F.col("bucket").alias("cut_bucket"), "last")
    whole = F.when(F.col("missing") > 0, F.lit(BUCKETS + 1)).otherwise(F.lit(-1))
    return params.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "rate", F.coalesce("cut_bucket", whole).alias("cut_bucket"), "last"
    )


def low_key(key: Column) -> Column:
    """The key with null before all others."""
    return F.coalesce(key, F.lit(-(2**63)))


def copies(key: Column, size: Column, cap: int, seed: str, prefix: str = "") -> Column:
    """How often the mix takes a row that is joined with its source's rates (in columns with the prefix)."""
    e = due(F.col(f"{prefix}rate"), size, cap)
    r = rank(key, e, seed)
    bucket, edge = F.floor(r * BUCKETS), F.col(f"{prefix}cut_bucket")
    at = F.struct(r.alias("rank"), low_key(key).alias("key"), size.alias("size"))
    drawn = (bucket < edge) | ((bucket == edge) & (at <= F.col(f"{prefix}last")))
    return (F.floor(e) + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)).cast("long")


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document.

    A null text has size 0 and takes 0 words.  Null sources are one source.  An
    empty table gives an empty result.  Rows that repeat an id and size share
    their decision.  Other columns are ignored.
    """
    rows = cut(docs.select(F.col("doc_id").alias("key"), "source", word_count("text").alias("size")))
    found = small(cut(rates(rows, weights, cap, seed).withColumnRenamed("source", "s")))
    out = rows.join(found, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (copies(F.col("key"), F.col("size"), cap, seed) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The rows of the mix: each input row as often as the mix takes it, 0 to ``cap`` times, with the input's columns."""
    rows = cut(docs.select(F.col("doc_id").alias("key"), "source", word_count("text").alias("size")))
    found = rates(rows, weights, cap, seed)
    found = found.select(*[F.col(c).alias(f"_mix_{c}") for c in found.columns])
    joined = docs.join(small(cut(found)), F.col("source").eqNullSafe(F.col("_mix_source")))
    counted = joined.withColumn("_mix_size", word_count("text"))
    counted = once(counted, "_mix_row").withColumn("_mix_n", copies(F.col("doc_id"), F.col("_mix_size"), cap, seed, "_mix_").cast("int"))
    return once(counted, "_mix_rank").where("_mix_n > 0 and _mix_rank >= 0 and _mix_row >= 0").withColumn("_mix_i", F.explode(F.sequence(F.lit(1), "_mix_n"))).select(*docs.columns)


#: The whole query in DuckDB, with plain windows over all rows of a source.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT max(lev) FROM l) * weight) AS target FROM l
), h AS (
  SELECT source, length(bin(size)) AS k, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY ALL
), c AS (
  SELECT h.*, t.target, t.source_size, CASE WHEN sum(words * k) OVER r > 0 THEN (t.target - 3 * coalesce(sum(words) OVER b, 0)) / sum(words * k) OVER r ELSE 0 END AS lev
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
  WINDOW r AS (PARTITION BY h.source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), b AS (PARTITION BY h.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), p0 AS (SELECT source, max(lev) AS rate FROM c GROUP BY source
), p AS (
  SELECT c.source, any_value(c.source_size) AS source_size, any_value(c.target) AS target, any_value(p0.rate) AS rate,
    any_value(c.target) - sum(floor(least(3.0::DOUBLE, p0.rate * c.k)) * c.words) AS missing
  FROM c JOIN p0 ON c.source IS NOT DISTINCT FROM p0.source GROUP BY c.source
), e AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.missing, least(3.0::DOUBLE, p.rate * length(bin(d.size))) AS e,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), f AS (SELECT *, e - floor(e) AS f FROM e
), q AS (
  SELECT *, CASE WHEN f > 0 AND size > 0 THEN u * (1 - f) / (u * (1 - f) + (1 - u) * f) END AS rk FROM f
), g AS (
  SELECT *, coalesce(sum(CASE WHEN rk IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rk NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM q
)
SELECT doc_id, size, source_size, target, CAST((floor(e) + CASE WHEN rk IS NOT NULL AND 2 * start + size <= 2 * missing THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM g
"""
