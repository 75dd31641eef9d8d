"""Scoring samples as they arrive: fixed-weight updates need nothing but the model, so they run on a stream unchanged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from partwise.kernels.nmf import apply_fixed
from partwise.operators.models import dense_block, held, long_weights


def score_stream(samples: DataFrame, w: DataFrame, begin: float, rounds: int = 200) -> DataFrame:
    """``samples`` is ``(sample, features array, values array)``, streaming or not; ``begin`` is the start of every weight.

    Stateless: each arriving sample gives its rows ``(sample, signature, weight)``; features that the model lacks are ignored.
    """
    features, names, dense = held(w)
    place = pd.Series(np.arange(len(features)), index=features)
    sent = samples.sparkSession.sparkContext.broadcast((place, dense))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, dense = sent.value
        for block in batches:
            at = [place.reindex(list(fs)).to_numpy() for fs in block["features"]]
            known = [np.isfinite(a) for a in at]
            values = [np.asarray(x, float)[ok] for x, ok in zip(block["values"], known, strict=True)]
            v = dense_block([a[ok].astype(int) for a, ok in zip(at, known, strict=True)], values, len(dense))
            yield long_weights(block["sample"], names, apply_fixed(v, dense, begin, rounds)).drop(columns="sig_ord")

    return samples.select("sample", "features", "values").mapInPandas(run, "sample string, signature string, weight double")
