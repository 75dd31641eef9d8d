"""Language identification by rank-order profiles (Cavnar and Trenkle 1994).

Training counts character n-grams (1 to 3, over letters, word edges as blanks)
of documents with a known language; the ``PROFILE`` most frequent of a language,
in order, are its profile.  A document's own ``PROFILE`` most frequent n-grams
are compared with each profile: an n-gram counts as many points as its two
ranks differ, or ``PROFILE`` if the profile lacks it.  The language of the least
sum wins, ties going to the first by name.

Profiles are a few hundred numbers a language, so they travel in the closure.
Predicting is one pass without a shuffle, vectorised over each document's code
points.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
#: Training reads about so many documents of a language, chosen by a hash of their ids.
SAMPLE_DOCS = 3_000
BITS = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(text: str) -> np.ndarray:
    """The text's letters, in lower case, other runs as one 0, with a 0 at both ends; empty if there is no letter."""
    ids = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not ids.any():
        return ids[:0]
    ids = np.concatenate([np.zeros(1, np.uint64), ids, np.zeros(1, np.uint64)])
    return ids[(ids != 0) | np.concatenate([[True], ids[:-1] != 0])]


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 as 63-bit numbers, and their counts.  Lone blanks aren't counted."""
    one = ids[ids != 0]
    two = (ids[:-1] << np.uint64(BITS)) | ids[1:]
    three = (two[:-1] << np.uint64(BITS)) | ids[2:]
    # The leading blank of a longer n-gram would make it look shorter; blanks are therefore stored as 1.
    two = np.where(ids[:-1] == 0, two | np.uint64(1 << BITS), two)
    three = np.where(ids[:-2] == 0, three | np.uint64(1 << 2 * BITS), three)
    three = np.where(ids[1:-1] == 0, three | np.uint64(1 << BITS), three)
    grams = np.concatenate([one, two, three])
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.append(first, len(grams)))


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by number."""
    return grams[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Ranks of n-grams by language, as one sorted table."""

    def __init__(self, by_language: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names = sorted(by_language)
        self.size = size
        self.grams = np.unique(np.array([g for p in by_language.values() for g in p], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            own = np.array(by_language[name], np.uint64)
            self.ranks[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how near it is, from 0 (nothing shared) to 1 (same ranks)."""
        ids = code_points(text or "")
        if not len(ids) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(*counted(ids), self.size)
        at = np.searchsorted(self.grams, own)
        inside = at < len(self.grams)
        inside[inside] = self.grams[at[inside]] == own[inside]
        ranks = self.ranks[np.where(inside, at, -1)]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.size * len(own)))


def fold(key: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def learn(labelled: DataFrame, size: int = PROFILE, sample_docs: int = SAMPLE_DOCS) -> Profiles:
    """Profiles from rows ``(doc_id, text, lang)``; rows without text or language teach nothing."""
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, min(1.0, sample_docs / n)).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)
    chosen = rows.where(draw < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = code_points(text)
                if len(ids):
                    tally = held.setdefault(lang, {})
                    grams, counts = counted(ids)
                    for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                        tally[g] = tally.get(g, 0) + n
        for lang, tally in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tally), pa.string()), pa.array(list(tally), pa.int64()), pa.array(list(tally.values()), pa.int64())], names=["lang", "gram", "n"])

    sums = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_language: dict[str, list[int]] = {}
    for r in sums.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").collect():
        by_language.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_language, size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything if nothing was learned.  Only the text is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold, predict all: ``doc_id, held_out, lang_pred, score``."""
    profiles = learn(docs.where(fold("doc_id") != 2))
    return predict(docs, profiles).select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")
