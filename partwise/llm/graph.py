"""Connected components of an edge table by random contraction; nothing is gathered but a bounded rest of edges in one task.

Each round every vertex goes to the vertex of least priority among itself and
its neighbours; priorities are hashes that change with the round, so a constant
share of the vertices vanishes each time, chains and stars alike.  The rounds'
maps, each a row a vertex, are then followed.  Once no more than ``FEW`` rows of
edges are left, one task contracts the rest of the way: the last rounds are many
and hold little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.session import cut, discard

MOST_ROUNDS = 60
#: Rows (each edge both ways, 16 bytes) up to which one task contracts the rest.
FEW = 200_000


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of n records' components under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def contracted(both: DataFrame) -> DataFrame:
    """``(v, to)``: the least vertex of each vertex's component, from one task that holds all of ``(a, b)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            a, b = (np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in range(2))
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = settle(len(ids), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["v", "to"])

    return both.select("a", "b").coalesce(1).mapInArrow(run, "v long, to long")


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` longs to ``(id, component)``: the least id of each vertex's component.  Loops and repeated edges do no harm."""
    both = edges.where("a <> b and a is not null and b is not null").select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    for turn in range(MOST_ROUNDS):
        left = both.limit(FEW + 1).count()
        if not left:
            break
        if left <= FEW:
            goal = cut(contracted(both))
            if labels is None:
                discard(both)
                return goal.select(F.col("v").alias("id"), F.col("to").alias("component"))
        else:
            least = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))).alias("least")
            goal = both.groupBy("a").agg(least)
            own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
            goal = cut(goal.select(F.col("a").alias("v"), F.least(own, F.col("least"))["to"].alias("to")))
        if labels is None:
            labels = cut(goal.select(F.col("v").alias("id"), F.col("to").alias("root")))
        else:
            step = goal.select(F.col("v").alias("root"), "to")
            older = labels
            labels = cut(labels.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
            discard(older)
        if left <= FEW:
            discard(both, goal)
            break
        ends = both.join(goal.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(goal.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        older = both
        both = cut(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        discard(older, goal)
    else:
        raise RuntimeError(f"components did not settle within {MOST_ROUNDS} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where(F.lit(False))
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(smallest, "root").select("id", "component")
