"""Shared pieces: the word rule, table reading, hashing of byte runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that part words, and the two patterns built on them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: str | Column) -> Column:
    """How many words a text has; null has none.

    Gaps become one blank each, then the blanks between words are counted, so no
    array of words is built.
    """
    tight = F.trim(F.regexp_replace(text_or_empty(col), GAP, " "))
    blanks = F.length(tight) - F.length(F.translate(tight, " ", ""))
    return F.when(tight == "", F.lit(0)).otherwise(blanks + 1).cast("long")


#: Rows up to which a written table is sent to every executor.
BROADCAST_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a written table of a few narrow columns, if a count shows that it is small enough; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Bytes of text that a task holds as Python strings at a time (a longer text is alone).
PIECE = 1 << 22


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``PIECE`` bytes of a text column, of one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def small_batches(spark: SparkSession) -> None:
    """From now on send at most ``PIECE`` bytes at a time to Python tasks of this session, unless it has a lower limit.

    Arrow's buffers, in the JVM and in Python, stay as large as the largest batch that they have held.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m"))
    if not 0 < held <= PIECE:
        spark.conf.set(key, str(PIECE))


def once(df: DataFrame, name: str) -> DataFrame:
    """Keep costly columns from being copied into later filters.

    Catalyst moves a filter below the columns it tests by repeating their
    expressions, once for each mention.  It doesn't where a column, here one of
    this name, isn't deterministic; the filter must mention it (``name >= 0``),
    or the column is pruned.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
