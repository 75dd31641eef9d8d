"""Reconciling the feature names of a table with those of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.session import cut

# Patterns of lineage labels, ranks from the left parted by ``;``.
RANK_MARK = r"[a-zA-Z]__"
SPLIT_GENUS = r"(?U)(\w+)_\w$"
DEPTH = 6


def strip_ranks(label: Column) -> Column:
    """``g__Name`` as ``Name``, at every rank."""
    return F.regexp_replace(label, RANK_MARK, "")


def split_root(label: Column) -> Column:
    """The root of a genus that was split by a letter: ``Name_A`` as ``Name``."""
    return F.when(F.contains(F.element_at(F.split(label, ";"), -1), F.lit("_")), F.regexp_replace(label, SPLIT_GENUS, "$1")).otherwise(label)


def parts(label: Column) -> Column:
    """Ranks with question marks taken out."""
    return F.split(F.replace(label, F.lit("?"), F.lit("")), ";")


def final_rank(label: Column) -> Column:
    """The last rank that isn't blank; null if there is none."""
    return F.try_element_at(F.filter(parts(label), lambda p: F.trim(p) != ""), F.lit(-1))


def unknown(label: Column) -> Column:
    """Whether no rank says anything."""
    return F.forall(parts(label), lambda p: F.trim(p) == "")


def padded(label: Column, depth: int = DEPTH) -> Column:
    """The lineage filled up with blank ranks, or cut, to ``depth``."""
    return F.array_join(F.slice(F.concat(F.split(label, ";"), F.array_repeat(F.lit(""), depth)), 1, depth), ";")


def family(label: Column) -> Column:
    """All but the last rank, with a blank one in its place."""
    ranks = F.split(label, ";")
    return F.concat(F.array_join(F.slice(ranks, F.lit(1), F.size(ranks) - 1), ";"), F.lit(";"))


def numeric(label: Column) -> Column:
    """Whether a label is a whole number, minus signs allowed."""
    return label.rlike("^-*[0-9]+$")


def clean(x: DataFrame) -> DataFrame:
    """A lineage table ready for use: ranks stripped, numeric and unknown features, empty features and samples dropped, shares by sample."""
    y = x.withColumn("feature", padded(strip_ranks(F.col("feature")))).where(~unknown(F.col("feature")) & ~numeric(F.regexp_replace("feature", ";", "")))
    y = y.groupBy("feature", "sample").agg(F.sum("value").alias("value"))
    for axis in ("feature", "sample"):
        alive = y.groupBy(axis).agg(F.sum("value").alias("t")).where("t > 0").select(axis)
        y = y.join(alive, axis, "left_semi")
    total = y.groupBy("sample").agg(F.sum("value").alias("t"))
    return y.join(total, "sample").select("feature", "sample", (F.col("value") / F.col("t")).alias("value"))


def last_named(label: Column) -> Column:
    """The last named rank and the unknown ones after it: ``A;B;?`` as ``B;?``."""
    return F.regexp_replace(label, r".*;([^;?]+[;?]*)$", "$1")


def short_genus(names: DataFrame) -> DataFrame:
    """``(feature, short)``: the last named rank if one name alone contains it, else the last two ranks or, where several short names contain it too, the last three.

    Names are looked for in all names, so this is for tables of a model's size.
    """
    one = names.select("feature").distinct().withColumn("tail", last_named(F.col("feature")))
    if one.limit(20_001).count() > 20_000:
        raise ValueError("more than 20,000 names")
    other = F.broadcast(one.select(F.col("feature").alias("whole"), F.col("tail").alias("part")))
    n = one.join(other, F.contains(F.col("whole"), F.col("tail"))).groupBy("feature", "tail")
    n = n.agg(F.count("*").alias("n"), F.count_if(F.contains(F.col("part"), F.col("tail"))).alias("n_short"))
    ranks = F.split("feature", ";")
    last = lambda k: F.array_join(F.slice(ranks, F.greatest(F.size(ranks) - k + 1, F.lit(1)), F.lit(k)), ";")
    short = F.when(F.col("n") == 1, F.col("tail")).when(F.col("n_short") == 1, last(2)).when(F.col("n_short") > 1, last(3)).otherwise(F.col("tail"))
    return n.select("feature", short.alias("short"))


def validate_lineages(x: DataFrame) -> DataFrame:
    """A lineage table that is fit for matching, or a ``ValueError`` that says why it isn't.

    At least two features and samples; sample names that aren't all whole numbers; features
    and samples are swapped if over a fifth of the sample names say ``BACTERIA;``; rank marks go
    if the first ten features by name all have them; numeric and wholly unknown features,
    and features and samples without mass, are dropped; two features that are one
    after padding to genus depth are an error.  The rest is scaled by sample.
    """
    # The table is read often from here on; what is asked of labels is asked of tables of labels.
    x = cut(x)
    features = cut(x.groupBy("feature").agg(F.sum("value").alias("t")))
    samples = cut(x.groupBy("sample").agg(F.sum("value").alias("t")))
    if min(features.agg(F.count("feature")).first()[0], samples.agg(F.count("sample")).first()[0]) < 2:
        raise ValueError("a table needs two features and two samples; check the delimiter")
    names = samples.agg(F.every(F.col("sample").rlike("^[0-9]+$")).alias("numeric"), F.avg(F.contains(F.upper("sample"), F.lit("BACTERIA;")).cast("int")).alias("taxa")).first()
    if names["numeric"]:
        raise ValueError("all sample names are numbers: the header seems to lack")
    if names["taxa"] > 0.2:
        x = x.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")
        features = samples.withColumnRenamed("sample", "feature")
    first = features.orderBy("feature").limit(10)
    marked = first.agg(F.every(F.col("feature").rlike(RANK_MARK)).alias("marked")).first()["marked"]
    labels = features.withColumn("name", strip_ranks(F.col("feature")) if marked else F.col("feature")).where(~numeric(F.col("name")))
    wholes = labels.select("name").distinct().withColumn("whole", padded(F.col("name")))
    twice = wholes.groupBy("whole").agg(F.sort_array(F.collect_list("name")).alias("of")).where("size(of) > 1").orderBy("whole").first()
    if twice is not None:
        raise ValueError(f"features that are one at genus depth: {', '.join(twice['of'][:5])}")
    labels = labels.where(~unknown(F.col("name")))
    alive = labels.groupBy("name").agg(F.sum("t").alias("t")).where("t <> 0").select("name")
    labels = cut(labels.select("feature", "name").join(alive, "name"))
    y = x.join(labels, "feature").withColumn("feature", F.col("name")).select(*x.columns)
    totals = cut(y.groupBy("sample").agg(F.sum("value").alias("t")).where("t <> 0"))
    return y.join(totals, "sample").withColumn("value", F.col("value") / F.col("t")).select(*x.columns)


def missing(w: DataFrame, found: DataFrame) -> DataFrame:
    """Features of a model that nothing is mapped to."""
    return w.select(F.col("feature").alias("model_feature")).distinct().join(found, "model_feature", "left_anti")


def conflicts(found: DataFrame) -> DataFrame:
    """Inputs with several targets, and these in order."""
    lists = found.groupBy("input_feature").agg(F.sort_array(F.collect_list(F.struct("priority", "model_feature"))).alias("l"))
    return lists.where(F.size("l") > 1).select("input_feature", F.transform("l", lambda t: t["model_feature"]).alias("targets"))


def parted(left: DataFrame, right: DataFrame, key: str = "feature") -> DataFrame:
    """``(key, side)`` of the labels of two tables: ``left`` only, ``both``, ``right`` only."""
    a = left.select(key).distinct().withColumn("l", F.lit(True))
    b = right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


def match_identical(w: DataFrame, x: DataFrame) -> DataFrame:
    """``(input_feature, model_feature, priority, rule)`` of equal names."""
    both = x.select("feature").distinct().join(w.select("feature").distinct(), "feature")
    return both.select(F.col("feature").alias("input_feature"), F.col("feature").alias("model_feature"), F.lit(1).alias("priority"), F.lit("identical").alias("rule"))


def match_lineages(w: DataFrame, x: DataFrame, family_rollup: bool = True, hard: DataFrame | None = None) -> DataFrame:
    """Mapping by rules in order: identical, root of a split genus, equal last rank, family; an input keeps the first rule that fits.

    ``hard`` is ``(input_feature, model_feature)`` and overrides all.  Several
    model features under one rule stay, by name, as priorities 1, 2, ...
    """
    source = x.select(F.col("feature").alias("input_feature")).distinct()
    goal = w.select(F.col("feature").alias("model_feature")).distinct()
    s, g = F.col("input_feature"), F.col("model_feature")
    rules = [(1, "identical", s == g), (2, "split_genus", split_root(s) == g), (3, "final_rank", final_rank(s) == final_rank(g))]
    if family_rollup:
        rules.append((4, "family", family(s) == g))
    found = None
    if hard is not None:
        found = hard.join(source, "input_feature", "left_semi").select("input_feature", "model_feature", F.lit(0).alias("rule_ord"), F.lit("hard").alias("rule"))
    for order, name, fits in rules:
        one = source.join(goal, fits).select("input_feature", "model_feature", F.lit(order).alias("rule_ord"), F.lit(name).alias("rule"))
        found = one if found is None else found.unionByName(one)
    first = F.min("rule_ord").over(Window.partitionBy("input_feature"))
    kept = found.withColumn("first", first).where("rule_ord = first")
    return kept.select("input_feature", "model_feature", F.row_number().over(Window.partitionBy("input_feature").orderBy("model_feature")).alias("priority"), "rule")


def map_abundance(x: DataFrame, mapping: DataFrame) -> DataFrame:
    """Features renamed by their first mapping and summed; unmapped ones stay."""
    first = mapping.where("priority = 1").select(F.col("input_feature").alias("feature"), "model_feature")
    named = x.join(first, "feature", "left").select(F.coalesce("model_feature", "feature").alias("feature"), "sample", "value")
    return named.groupBy("feature", "sample").agg(F.sum("value").alias("value"))


def map_weights(w: DataFrame, x: DataFrame) -> DataFrame:
    """The model over the table's features: those it lacks have weight 0, those the table lacks are gone."""
    known = w.join(x.select("feature").distinct(), "feature", "left_semi")
    extra = x.select("feature").distinct().join(w.select("feature").distinct(), "feature", "left_anti")
    zero = extra.crossJoin(w.select("signature", "sig_ord").distinct()).withColumn("weight", F.lit(0.0))
    return known.select("feature", "signature", "sig_ord", "weight").unionByName(zero.select("feature", "signature", "sig_ord", "weight"))


def report(x: DataFrame, mapped: DataFrame, w: DataFrame) -> DataFrame:
    """One row: how many features and how much mass the model knows, before and after mapping."""
    known = w.select("feature").distinct().withColumn("known", F.lit(True))

    def side(t: DataFrame, name: str) -> DataFrame:
        flag = F.coalesce("known", F.lit(False))
        return t.join(known, "feature", "left").agg(F.count_distinct("feature").alias(f"{name}_features"), F.sum(F.when(flag, F.col("value")).otherwise(0.0)).alias(f"{name}_known_mass"), F.sum("value").alias(f"{name}_mass"))

    return side(x, "before").crossJoin(side(mapped, "after"))
