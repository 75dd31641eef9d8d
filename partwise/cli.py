"""Command line: choose a rank or a penalty, decompose, apply a model.  Tables are delimited, features first.  Parameters are logged and saved beside the result."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.operators import analysis, holdout, mapping, matrix, models, reapply
from partwise.session import build_session
from partwise.sources import models as store
from partwise.sources import tables

log = logging.getLogger("partwise")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="partwise")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("rank-select", "regu-select", "decompose", "transform", "reapply"):
        p = sub.add_parser(name)
        p.add_argument("-i", "--input", required=True, help="delimited matrix")
        p.add_argument("-o", "--output", required=True, help="new folder for the result")
        p.add_argument("-d", "--delimiter", default="\t")
        p.add_argument("--seed", type=int, default=0)
        p.add_argument("-v", "--verbose", action="store_true", help="log what is done")
        p.add_argument("--max-iter", type=int, default=3000)
        if name in ("rank-select", "decompose"):
            p.add_argument("-r", "--ranks", type=int, nargs="+", required=True)
        if name in ("rank-select", "regu-select"):
            p.add_argument("-n", "--shuffles", type=int, default=100)
        if name == "regu-select":
            p.add_argument("-k", "--rank", type=int, required=True)
            p.add_argument("-a", "--alphas", type=float, nargs="+")
            p.add_argument("--l1-ratio", type=float, default=1.0)
        if name == "decompose":
            p.add_argument("--starts", type=int, default=100)
            p.add_argument("--top", type=int, default=5)
            p.add_argument("--criterion", default="beta_divergence")
        if name == "reapply":
            p.add_argument("--match", choices=("identical", "lineages"), default="identical", help="how features are matched with the model's")
            p.add_argument("--no-family-rollup", dest="rollup", action="store_false", help="unknown genera aren't counted with their family")
            p.add_argument("--hard-mapping", help="delimited table: input feature, model feature")
            p.add_argument("--tol", type=float, default=1e-4)
        if name in ("transform", "reapply"):
            p.add_argument("-w", "--weights", required=True, help="delimited weights, signatures in the header")
    return top


def default_alphas(n_samples: int) -> list[float]:
    """0 and 2^-5 .. 2^1 over the number of samples."""
    return [0.0, *[2.0**e / n_samples for e in range(-5, 2)]]


def weights(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A delimited table of weights as ``(feature, signature, sig_ord, weight)``, signatures in the header's order by name."""
    w = tables.read_delimited(spark, path, sep)
    names = [r["sample"] for r in w.select("sample").distinct().orderBy("sample").collect()]
    order = F.array_position(F.array(*map(F.lit, names)), F.col("sample")).cast("int")
    return w.select("feature", F.col("sample").alias("signature"), order.alias("sig_ord"), F.col("value").alias("weight"))


def reapplied(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Sample weights of the input under a model; mapping, report and fit are written beside them."""
    x, w = tables.read_delimited(spark, args.input, args.delimiter), weights(spark, args.weights, args.delimiter)
    if args.match == "lineages":
        hard = None
        if args.hard_mapping:
            hard = spark.read.option("sep", args.delimiter).option("header", True).csv(args.hard_mapping).toDF("input_feature", "model_feature")
        model = reapply.lineage_model(w, family_rollup=args.rollup, hard=hard)
    else:
        model = reapply.Signatures(w, validate=matrix.validate, match=mapping.match_identical)
    got = model.reapply(x, rounds=args.max_iter, tol=args.tol)
    for name, table in (("report", got.report), ("mapping", got.feature_mapping), ("model_fit", got.model_fit())):
        table.coalesce(1).write.option("sep", args.delimiter).option("header", True).csv(f"{args.output}-{name}")
    return got.h


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The command's result, which is also written as a delimited table with a header."""
    if store.there(spark, args.output):
        raise FileExistsError(args.output)
    chosen = {k: v for k, v in sorted(vars(args).items()) if v is not None}
    for k, v in chosen.items():
        log.info("%s: %s", k, v)
    if args.command == "reapply":
        out = reapplied(spark, args)
    else:
        x = matrix.validate(tables.read_delimited(spark, args.input, args.delimiter))
        if args.command == "rank-select":
            if len(args.ranks) < 2:
                raise ValueError("choosing a rank needs at least two")
            out = holdout.summary(holdout.cross_validate(holdout.split(x, args.shuffles, seed=args.seed), args.ranks, seed=args.seed, max_iter=args.max_iter))
        elif args.command == "regu-select":
            alphas = sorted({0.0, *[a for a in args.alphas if a >= 0]}) if args.alphas else default_alphas(x.select("sample").distinct().count())
            out = holdout.summary(holdout.cross_validate(holdout.split(x, args.shuffles, seed=args.seed), [args.rank], alphas, seed=args.seed, max_iter=args.max_iter, l1_ratio=args.l1_ratio))
        elif args.command == "decompose":
            fits = analysis.top_models(models.decompose(x, args.ranks, args.starts, args.seed, max_iter=args.max_iter), args.criterion, args.top)
            tables.save_models(fits, f"{args.output}-fits")
            fits = tables.load_models(spark, f"{args.output}-fits")
            store.save_many(store.of_fits(fits, x), f"{args.output}-models")
            out = fits.drop("features", "samples", "w", "h")
        else:
            out = models.transform(x, weights(spark, args.weights, args.delimiter), args.max_iter)
    out.write.option("sep", args.delimiter).option("header", True).csv(args.output)
    store.write_json(spark, chosen, f"{args.output}-parameters")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    run(build_session("partwise"), args)


if __name__ == "__main__":
    main()
