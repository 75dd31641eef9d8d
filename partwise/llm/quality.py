"""Quality rules: plain limits, then robust multivariate outliers per language and source.

The base counts are column expressions over the whole text.  The verdict comes
from minimum-covariance-determinant (MCD) estimates: documents that pass the
limits are described by five logarithmic statistics in fixed point; for each
(language, source) the subset of about ``HALF`` of the documents with the
smallest covariance determinant is sought as FAST-MCD does (Rousseeuw and Van
Driessen 1999): from ``STARTS`` deterministic starts, medians and MADs first and
the others subsets drawn by a hash, two concentration steps each; the start of least
determinant goes on until a step lowers the determinant no more.  Then the usual
reweighting: mean and covariance of all documents within the 0.975 quantile.  A
document goes if its Mahalanobis distance from them exceeds ``CUTOFF``.

Every step is one aggregation to (group, start, distance bin) with sums of integers,
so results don't depend on the order of rows, no group is gathered, and only
sums over at most ``BINS`` bins a group meet in a task.  The subset of a step
is all rows up to the bin that holds the wanted share.  Groups of fewer than
``LEAST`` rows are judged by their language's estimates, or else by those of
all documents.  No Python runs on rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import GAP, SPACES, once, small, text_or_empty
from partwise.session import cut

SYMBOLS = r"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20

#: Statistics are whole multiples of 1/UNIT.
UNIT = 1024
DIMS = 5
HALF = 0.75
#: Starts, steps that each takes, and steps that the best one takes at most.
STARTS = 10
FIRST_STEPS = 2
MOST_STEPS = 30
#: A start but the first is the rows of one of so many hash classes.
CLASSES = 9
#: Rows that an estimate of its own needs: twelve a dimension, so that the subset has nine.  Smaller groups are judged by their language's.
LEAST = 12 * DIMS
BINS = 4096
#: Consistency at the normal for five dimensions and a share of 0.75: 0.75 / P(chi2_7 <= 6.6257).
CONSISTENT = 1.41
#: Added to each variance, in squared units of the logarithms: what documents differ by anyway.
FLOORS = (0.25, 0.01, 0.25, 1.0, 1.0)
#: Squared distance beyond which a document goes: the 0.999 quantile of chi-square with five degrees.
CUTOFF = 20.515
#: Squared distance within which rows count at last, the 0.975 quantile, and consistency for that: 0.975 / P(chi2_7 <= 12.833).
INNER = 12.833
INNER_CONSISTENT = 1.0556


def base_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``, each after ``prefix``.

    A null or blank text has no words and fails.  Whole texts of any length: the
    eight-word windows of a text are hashed to 64 bits and counted within the
    row; only rows that hold a window twice sort them.
    """
    p = prefix
    tight = F.trim(text_or_empty(text), F.lit(SPACES))
    one = docs.withColumn(f"{p}w", F.when(tight == "", F.array().cast("array<string>")).otherwise(F.split(tight, GAP)))
    hashes = F.transform(f"{p}w", lambda w: F.xxhash64(w))
    one = one.withColumn(f"{p}h", hashes)
    starts = F.sequence(F.lit(0), F.size(f"{p}h") - WINDOW)
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(f"{p}h"), i + k) for k in range(WINDOW)]))
    one = one.withColumn(f"{p}v", F.when(F.size(f"{p}h") >= WINDOW, window))
    repeats = F.size(F.array_distinct(f"{p}v")) < F.size(f"{p}v")
    one = one.withColumn(f"{p}s", F.when(repeats, F.array_sort(F.transform(f"{p}v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(f"{p}s")
    twin = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    one = one.withColumn(f"{p}t", F.sort_array(F.transform(twin, lambda x: x["i"])))
    t = F.col(f"{p}t")
    covered = F.aggregate(
        F.transform(t, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(t, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    lines = F.filter(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    one = one.withColumn(f"{p}l", lines)
    counts = {
        "n_words": F.size(f"{p}w"),
        "word_chars": F.length(F.array_join(f"{p}w", "")),
        "n_symbols": F.length(F.regexp_replace(text_or_empty(text), f"[^{SYMBOLS}]+", "")),
        "n_dup_lines": F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    one = one.withColumns({f"{p}{k}": v.cast("long") for k, v in counts.items()})
    n = F.col(f"{p}n_words")
    one = one.withColumn(f"{p}base_failed", (n < LEAST_WORDS) | (F.col(f"{p}n_repeat_words") * 100 > n * 30))
    return one.drop(*[f"{p}{c}" for c in "whvstl"])


def described(prefix: str = "") -> list[Column]:
    """The statistics ``x0 .. x4``, from the base counts, in fixed point."""
    col = lambda c: F.col(f"{prefix}{c}")
    n, c = col("n_words"), F.greatest(col("word_chars"), F.lit(1))
    parts = [
        F.log(n + F.lit(1.0)),
        F.log(c / F.greatest(n, F.lit(1))),
        F.log(F.lit(1.0) + col("n_symbols") * 100 / c),
        F.log(F.lit(1.0) + col("n_dup_lines") * 100 / (n + F.lit(1.0))),
        F.log(F.lit(1.0) + col("n_repeat_words") * 100 / (n + F.lit(1.0))),
    ]
    return [F.round(x * UNIT).cast("long").alias(f"{prefix}x{k}") for k, x in enumerate(parts)]


def pool_names(lang: str = "lang", source: str = "source") -> tuple[Column, Column]:
    """Names of a row's language and of its language and source; null is a value of its own."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat(F.lit("1"), name(lang)), F.concat(F.lit("2"), name(lang), F.lit("\x01"), name(source))


def pooled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows once for each pool they count in, in ``pool``; and for each ``fine_pool`` the pool that judges it."""
    lang_pool, fine_pool = pool_names()
    rows = rows.withColumn("lang_pool", lang_pool).withColumn("fine_pool", fine_pool)
    fine = rows.groupBy("lang_pool", "fine_pool").agg(F.count("*").alias("n"))
    fine = fine.withColumn("m", F.sum("n").over(Window.partitionBy("lang_pool")))
    choice = F.when(F.col("n") >= LEAST, F.col("fine_pool")).when(F.col("m") >= LEAST, F.col("lang_pool")).otherwise("0")
    fine = cut(fine.select("fine_pool", choice.alias("pool")))
    rows = rows.withColumn("pool", F.explode(F.array(F.lit("0"), "lang_pool", "fine_pool"))).drop("lang_pool", "fine_pool", "lang", "source")
    return rows.join(small(fine.select("pool").distinct()), "pool", "left_semi"), fine


def squared_distance(prefix: str = "") -> Column:
    """Mahalanobis distance, squared, by forward substitution in the group's Cholesky factor ``l_ij`` with means ``m_i``."""
    col = lambda c: F.col(f"{prefix}{c}")
    solved: list[Column] = []
    for i in range(DIMS):
        value = (col(f"x{i}") - col(f"m{i}")) / UNIT
        for j in range(i):
            value = value - col(f"l{i}{j}") * solved[j]
        solved.append(value / col(f"l{i}{i}"))
    return sum((z * z for z in solved[1:]), solved[0] * solved[0])


PARAMS = [f"m{i}" for i in range(DIMS)] + [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def factored(groups: DataFrame, consistent: float = CONSISTENT) -> DataFrame:
    """Means, Cholesky factor and logarithm of the determinant of each (pool, start)'s covariance from ``n, s_i, s_ij``; the floors keep it definite."""
    n = F.col("n")
    out = groups.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(DIMS)})
    out = out.withColumns(
        {
            f"c{i}{j}": (F.col(f"s{i}{j}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * (consistent / UNIT**2) + F.lit(FLOORS[i] if i == j else 0.0)
            for i in range(DIMS)
            for j in range(i + 1)
        }
    )
    for j in range(DIMS):
        inner = F.lit(0.0)
        for k in range(j):
            inner = inner + F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(1e-9))))
        below = {}
        for i in range(j + 1, DIMS):
            inner = F.lit(0.0)
            for k in range(j):
                inner = inner + F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            below[f"l{i}{j}"] = (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}")
        out = out.withColumns(below) if below else out
    return out.select("pool", "start", *PARAMS, determinant().alias("det"))


def determinant() -> Column:
    """The logarithm of the determinant of the covariance that a factor stands for."""
    return sum((2 * F.log(f"l{i}{i}") for i in range(1, DIMS)), 2 * F.log("l00"))


SUMS = {f"s{i}": f"x{i}" for i in range(DIMS)} | {f"s{i}{j}": f"x{i} * x{j}" for i in range(DIMS) for j in range(i + 1)}


def summed() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(F.expr(v)).alias(k) for k, v in SUMS.items()]]


def starts(rows: DataFrame) -> DataFrame:
    """Factors to start from: medians and floored MADs of each pool, and the rows of one hash class, by their values, for each other start.

    Fixed-point values have a bounded number of distinct values, so the exact
    percentile's buffer of value counts is bounded too.
    """
    middle = cut(rows.groupBy("pool").agg(*[F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(DIMS)]))
    off = rows.join(small(middle), "pool").groupBy("pool").agg(*[F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))), 0.5).alias(f"d{i}") for i in range(DIMS)])
    scale = [F.sqrt(F.pow(F.col(f"d{i}") * (1.4826 / UNIT), 2) + FLOORS[i]).alias(f"l{i}{i}") for i in range(DIMS)]
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i in range(DIMS) for j in range(i)]
    first = middle.join(off, "pool").select("pool", F.lit(0).alias("start"), *[f"m{i}" for i in range(DIMS)], *scale, *zero)
    drawn = rows.withColumn("start", F.pmod(F.xxhash64(*[f"x{i}" for i in range(DIMS)]), F.lit(CLASSES)).cast("int") + 1).where(F.col("start") < STARTS)
    return first.select("pool", "start", *PARAMS, determinant().alias("det")).unionByName(factored(drawn.groupBy("pool", "start").agg(*summed())))


def concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step: from each (pool, start)'s factor to that of its closest rows."""
    d2 = rows.join(small(params.drop("det")), "pool").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.log2(squared_distance() + 1) * 128)).cast("int"))
    binned = d2.groupBy("pool", "start", "bin").agg(*summed())
    every = Window.partitionBy("pool", "start")
    up = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("all", F.sum("n").over(every))
    close = binned.where(F.col("before") < F.ceil(F.col("all") * HALF))
    return factored(close.groupBy("pool", "start").agg(*[F.sum(k).alias(k) for k in ("n", *SUMS)]))


def least(params: DataFrame) -> DataFrame:
    """Of each pool's factors the one of least determinant."""
    columns = ["start", *PARAMS, "det"]
    best = params.groupBy("pool").agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("best"))
    return best.select("pool", *[F.col(f"best.{c}").alias(c) for c in columns])


def least_determinants(rows: DataFrame) -> DataFrame:
    """The factor of least determinant that steps from all starts come to."""
    params = cut(starts(rows))
    for _ in range(FIRST_STEPS):
        params = cut(concentrated(rows, params))
    best = cut(least(params))
    for _ in range(MOST_STEPS):
        stepped = cut(least(best.unionByName(concentrated(rows, best))))
        lower = stepped.select("pool", F.col("det").alias("now")).join(best.select("pool", "det"), "pool").where(F.col("now") < F.col("det") - 1e-9)
        settled = lower.isEmpty()
        best = stepped
        if settled:
            break
    return best


def estimates(rows: DataFrame) -> DataFrame:
    """The reweighted factor of each pool."""
    raw = least_determinants(rows)
    inner = rows.join(small(raw.drop("det")), "pool").where(squared_distance() <= INNER)
    return cut(factored(inner.groupBy("pool", "start").agg(*summed()), INNER_CONSISTENT).drop("det", "start"))


def fit(counts: DataFrame) -> DataFrame:
    """``fine_pool`` and the factor that judges it, from base counts with ``lang`` and ``source``."""
    rows, fine = pooled(counts.where(~F.col("base_failed")).select("lang", "source", *described()))
    params = estimates(cut(rows))
    return cut(fine.join(params, "pool").drop("pool"))


def verdicts(counts: DataFrame, model: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``distance2`` (null where the limits decide) and ``kept``, each after ``prefix``, to base counts that bear it too."""
    p = prefix
    named = small(model.select(*[F.col(c).alias(f"{p}{c}") for c in model.columns]))
    held = counts.columns
    joined = counts.select(*counts.columns, *described(p), pool_names()[1].alias(f"{p}pool"))
    joined = joined.join(named, F.col(f"{p}pool") == F.col(f"{p}fine_pool"), "left")
    joined = joined.withColumn(f"{p}distance2", F.when(~F.col(f"{p}base_failed"), squared_distance(p)))
    kept = ~F.col(f"{p}base_failed") & F.coalesce(F.col(f"{p}distance2") <= CUTOFF, F.lit(False))
    return joined.select(*held, f"{p}distance2", kept.alias(f"{p}kept"))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance2, kept`` of every row.

    ``distance2`` is null where the limits decide.  Null languages and sources
    are values of their own.  Repeated rows are judged alike.  An empty table
    gives an empty result; other columns are ignored.
    """
    counts = cut(base_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return verdicts(counts, fit(counts)).drop("lang", "source")


def passed(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the input's columns.

    Null and blank texts go; null languages and sources are values of their own; repeated rows are judged
    alike; an empty table gives an empty result.

    The model is fitted on the counts alone; then the texts are read once more,
    counted and judged row by row, so no text is shuffled.
    """
    model = fit(cut(base_counts(docs.select("lang", "source", "text")).drop("text")))
    return verdicts(once(base_counts(docs, prefix="_q_"), "_q_row"), model, "_q_").where("_q_kept and _q_row >= 0").select(*docs.columns)


def chi2_share(x: float, dims: int) -> float:
    """P(chi-square with an odd number of degrees <= x)."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(3, dims + 1, 2):
        total -= term
        term *= x / k
    return total
