"""Exact top-k inner products over norm-sorted vectors.

Vectors become integers floor(scale * x).  An orthogonal rotation, the right
singular vectors of all vectors (from the sum of their outer products), moves
most of the length into the first dimensions.  Vectors are sorted by descending
length, ties by id, and cut into bands of about equal size, bands into pieces of
about ``BLOCK`` vectors.

The first band, the longest vectors, gives every query a k-th best score to
start from.  A query then needs only vectors of at least that score over its own
length (Cauchy-Schwarz).  Queries are sorted by that need and cut in the same
way, so what a band of queries needs is a prefix of the bands of vectors; pairs
beyond it are never made, and only what is needed travels.  Within a pair of
pieces, strips by descending length end the search for a query in the same way,
and the first dimensions' partial product plus the product of the residual
lengths bounds each score; only candidates whose bound reaches the k-th best are
multiplied out, in integers.  So results are exact whatever the pruning does.

The driver holds the bounds of at most ``BANDS`` bands of either kind.  A task
holds one piece of candidates and one of queries at a time.  Vectors of much the
same length can't be told apart by length: then every pair of pieces meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.session import cut

SCALE = 256
K = 5
#: Vectors in a piece of candidates, and queries in a piece of queries, about.
BLOCK = 2_048
QUERY_BLOCK = 2_048
#: Bands of either at most.
BANDS = 1_024
#: Dimensions of the first partial product.
HEAD = 16
LEAST_LONG = -(2**63)
#: Slack for rounding in the bounds, relative to the product of lengths.
SLACK = 1e-9


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v, norm)`` with integer vectors and their lengths; rows whose vector is null or holds null or non-finite components are left out.  Components beyond a long count as the nearest long."""
    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = embeddings.where(F.coalesce(fine, F.lit(False))).select(F.col(key).alias("id"), whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows: eigenvectors of the sum of outer products, a width x width matrix a task."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            block = stacked(batch.column(0).to_pylist(), width).astype(np.float64)
            total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "x"])

    sums = rows.select("v").mapInArrow(gram, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    matrix = np.array([r["x"] for r in sums]).reshape(width, width) if sums else np.eye(width)
    _, vectors = np.linalg.eigh(matrix)
    return vectors[:, ::-1].copy()


def stacked(vectors, width: int) -> np.ndarray:
    """Rows as a matrix of integers; shorter vectors are filled up with zeros."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, np.int64) for v in vectors]).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def search_block(cand_ids: np.ndarray, cand: np.ndarray, query_ids: np.ndarray, query: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Best k of one block for each query, at or over its floor: (query, id, score).

    Candidates must come by descending length.  They are taken in strips; after
    each, a query's floor is its k-th best so far.
    """
    c, q = cand.astype(np.float64) @ turn, query.astype(np.float64) @ turn
    c_norm, q_norm = np.linalg.norm(c, axis=1), np.linalg.norm(q, axis=1)
    head = min(HEAD, c.shape[1])
    c_rest, q_rest = np.linalg.norm(c[:, head:], axis=1), np.linalg.norm(q[:, head:], axis=1)
    best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
    floor = floor.astype(np.float64).copy()
    strip = 1_024
    # Products that may leave a long are taken in whole numbers of any size.
    wide = len(cand_ids) and len(query_ids) and float(c_norm.max() * q_norm.max()) >= 2.0**62
    exact = object if wide else np.int64
    for lo in range(0, len(cand_ids), strip):
        hi = min(lo + strip, len(cand_ids))
        live = np.flatnonzero(q_norm * c_norm[lo] * (1 + SLACK) >= floor)
        if not len(live):
            break
        bound = q[live, :head] @ c[lo:hi, :head].T + np.outer(q_rest[live], c_rest[lo:hi])
        bound += SLACK * np.outer(q_norm[live], c_norm[lo:hi])
        rows, cols = np.nonzero(bound >= floor[live][:, None])
        if not len(rows):
            continue
        own = cand_ids[lo + cols] != query_ids[live[rows]]
        rows, cols = rows[own], cols[own]
        scores = np.empty(len(rows), exact)
        for at in range(0, len(rows), 65_536):
            part = slice(at, at + 65_536)
            one, other = query[live[rows[part]]], cand[lo + cols[part]]
            scores[part] = np.clip((one.astype(object) * other.astype(object)).sum(axis=1), LEAST_LONG, -LEAST_LONG - 1) if wide else np.einsum("ij,ij->i", one, other)
        order = np.array(sorted(range(len(rows)), key=lambda n: (rows[n], -scores[n], cand_ids[lo + cols[n]])), np.int64) if wide else np.lexsort((cand_ids[lo + cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(live)))
        place = np.arange(len(rows)) - first[rows]
        for r, col, s in zip(rows[place < k].tolist(), cols[place < k].tolist(), scores[place < k].tolist(), strict=True):
            best[live[r]].append((-s, int(cand_ids[lo + col])))
        for r in np.unique(rows):
            mine = best[live[r]]
            mine.sort()
            del mine[k:]
            if len(mine) == k:
                floor[live[r]] = max(floor[live[r]], -mine[-1][0])
    return [(int(query_ids[i]), vec, -s) for i, mine in enumerate(best) for s, vec in mine]


def banded(rows: DataFrame, by: list[Column], bound: Column, size: int) -> tuple[DataFrame, list[tuple[float, int]]]:
    """Rows sorted into bands by ``by`` and pieces of about ``size``: rows with ``band`` and ``piece`` (numbered on through the bands), and each band's ``bound`` and its number of pieces.

    Ranges of the sort key are Spark's; rows of equal keys alone stay together.
    """
    total = rows.count()
    parts = max(1, min(BANDS, -(-total // size)))
    dealt = cut(rows.repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(F.count("*").alias("n"), bound.alias("bound")).orderBy("range").collect()
    bands: list[list] = []
    for r in ranges:
        # There may be more ranges than were asked for; small ones are joined.
        if bands and bands[-1][1] + r["n"] <= max(size, total // BANDS):
            bands[-1][0].append(r["range"])
            bands[-1][1] += r["n"]
        else:
            bands.append([[r["range"]], r["n"], r["bound"]])
    named, out, piece = [], [], 0
    for k, (own, n, edge) in enumerate(bands):
        count = -(-n // size)
        named += [(x, k, piece, count) for x in own]
        out.append((float(edge), count))
        piece += count
    table = rows.sparkSession.createDataFrame(named, "range int, band int, first int, count int")
    placed = dealt.join(F.broadcast(table), "range")
    piece = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("count"))).cast("int")
    return placed.withColumn("piece", piece).drop("range", "first", "count"), out


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.  All rows but the query's own are candidates; rows that share the query's id
    count as its own, and a repeated id among the candidates counts each time.
    Vectors of unequal lengths are compared as if filled up with zeros.  Rows
    with a null id or an unusable vector take no part.  Scores are exact; one beyond a long counts as the nearest long.  Of rows that share a query's
    id the one with the least vector asks; fewer than k candidates
    give all of them; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = cut(usable(embeddings.select(key, vector), key, vector).where("id is not null"))
    width = int(rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1)
    turn = rotation(rows, width)
    vectors, bands = banded(rows, [F.desc("norm"), F.asc("id")], F.max("norm"), BLOCK)
    asked = cut(rows.where(is_query).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("q")).select("id", "q.*"))
    pieces = max(1, -(-asked.count() // QUERY_BLOCK))

    def search(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        cands = cands.sort_values(["norm", "id"], ascending=[False, True])
        matrix = stacked(cands["v"].to_list(), width)
        ids = cands["id"].to_numpy(np.int64)
        floor = queries["floor"].astype("float64").fillna(-np.inf).to_numpy(np.float64)
        out = search_block(ids, matrix, queries["id"].to_numpy(np.int64), stacked(queries["v"].to_list(), width), floor, turn, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def meet(cands: DataFrame, queries: DataFrame) -> DataFrame:
        names = ["piece", "other", "id", "v"]
        one = cands.select(*names, "norm").groupBy("piece", "other")
        return one.cogroup(queries.select(*names, "floor").groupBy("piece", "other")).applyInPandas(search, "query_id long, vec_id long, score long")

    def upto(n: int | Column, start: int = 0) -> Column:
        """The numbers from ``start`` to below n, a row each; no row if there are none."""
        end = F.lit(n) if isinstance(n, int) else n
        return F.explode(F.when(end > start, F.sequence(F.lit(start), end - 1)).otherwise(F.array().cast("array<int>")))

    first = bands[0][1] if bands else 0
    longest = vectors.where("band = 0").withColumn("other", upto(pieces))
    every = asked.withColumn("floor", F.lit(None).cast("long")).withColumn("other", F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int")).withColumn("piece", upto(first))
    head = cut(meet(longest, every))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = head
    if len(bands) > 1:
        kth = head.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        again = asked.join(kth, "id", "left")
        # The length from which a vector can reach the floor; without a floor, or where it isn't positive, any.
        need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm") * (1 - SLACK)).otherwise(0.0)
        queries, wants = banded(again.withColumn("need", need), [F.asc("need"), F.asc("id")], F.min("need"), QUERY_BLOCK)
        ends = np.cumsum([0, *[n for _, n in bands]])
        others = np.cumsum([0, *[n for _, n in wants]])
        # Bands of vectors descend and needs ascend, so what is needed is a prefix on either side.
        reach = [(q, int(ends[sum(top >= least for top, _ in bands)])) for q, (least, _) in enumerate(wants)]
        sent = [(b, int(others[sum(top >= least for least, _ in wants)])) for b, (top, _) in enumerate(bands)]
        to = F.broadcast(spark.createDataFrame(sent, "band int, sent int"))
        of = F.broadcast(spark.createDataFrame(reach, "band int, reach int"))
        rest = vectors.where("band > 0").join(to, "band").withColumn("other", upto(F.col("sent")))
        again = queries.withColumnRenamed("piece", "other").join(of, "band").withColumn("piece", upto(F.col("reach"), first))
        found = head.unionByName(meet(rest, again))
    best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
