"""URL filters by a sorted digest array.

A list of rules (host, path) is packed into one file: the sorted 64-bit xxhash
digests of ``host NUL path``, where each rule's full text starts in a blob,
its verdict, and the blob.  Executors get the file from Spark's file server and
map it into memory; workers of one machine share the pages.  A url is judged by
probing all of its host's suffixes with all prefixes of its path that are as
long as some rule's path; the probes of a batch are looked up together by
binary search, and a hit counts only if the stored text equals the probe, so
colliding digests can't give a wrong answer.  The longest fitting rule wins,
then the one that blocks; without any, the url is allowed.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.common import LOWER, UPPER

# The rules of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAGIC = 0x5041525455524C31


def host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    col = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(col, "://")
    return F.when(at > 0, F.substring(col, at + 3, F.length(col))).otherwise("")


def pack(rules: Iterable[tuple[str, str, str]], file: str, digest=xxhash.xxh64_intdigest) -> None:
    """Write the rules' array to a file.  Of equal rules, one that blocks counts."""
    kept: dict[bytes, bool] = {}
    for h, p, verdict in rules:
        key = h.translate(str.maketrans(UPPER, LOWER)).encode() + b"\0" + p.encode()
        kept[key] = kept.get(key, False) or verdict == "block"
    listed = sorted((digest(k), k, b) for k, b in kept.items())
    texts = [k for _, k, _ in listed]
    sizes = np.array([len(k) for k in texts], np.uint64)
    lengths = np.unique(np.array([len(k.partition(b"\0")[2]) for k in texts], np.uint64))
    with open(file, "wb") as out:
        np.array([MAGIC, len(listed), len(lengths)], np.uint64).tofile(out)
        lengths.tofile(out)
        np.array([d for d, _, _ in listed], np.uint64).tofile(out)
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64).tofile(out)
        np.array([b for _, _, b in listed], np.uint8).tofile(out)
        out.write(b"".join(texts))


class DigestArray:
    """A packed file, mapped into memory."""

    def __init__(self, file: str, digest=xxhash.xxh64_intdigest) -> None:
        raw = np.memmap(file, np.uint8, "r")
        magic, n, m = (int(x) for x in raw[:24].view(np.uint64))
        if magic != MAGIC:
            raise ValueError(f"{file} is no digest array")
        at = 24
        self.lengths = raw[at : at + 8 * m].view(np.uint64).tolist()
        at += 8 * m
        self.digests = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.starts = raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.blocks = raw[at : at + n]
        self.blob = raw[at + n :]
        self.digest = digest

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule of each key, or -1.  Equal digests lie together; all of them are compared in full."""
        wanted = np.fromiter((self.digest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1, np.int64)
        for k in np.flatnonzero(at < len(self.digests)):
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == wanted[k]:
                if self.blob[int(self.starts[i]) : int(self.starts[i + 1])].tobytes() == keys[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
        """Rule and verdict of each pair."""
        probes: dict[bytes, int] = {}
        of: list[list[int]] = []
        for h, p in zip(hosts, paths, strict=True):
            own = []
            if h:
                raw, labels = p.encode(), h.encode().split(b".")
                tails = [b".".join(labels[i:]) for i in range(len(labels))]
                for n in self.lengths:
                    if n <= len(raw):
                        own += [probes.setdefault(t + b"\0" + raw[:n], len(probes)) for t in tails]
            of.append(own)
        found = self.find(list(probes))
        rules: list[str | None] = []
        verdicts = []
        for own in of:
            hits = [int(found[k]) for k in own if found[k] >= 0]
            best = max(hits, key=lambda i: (int(self.starts[i + 1] - self.starts[i]), bool(self.blocks[i])), default=None)
            if best is None:
                rules.append(None)
                verdicts.append("allow")
            else:
                rules.append(self.blob[int(self.starts[best]) : int(self.starts[best + 1])].tobytes().replace(b"\0", b"").decode())
                verdicts.append("block" if self.blocks[best] else "allow")
        return rules, verdicts


@lru_cache(maxsize=8)
def opened(name: str) -> DigestArray:
    """The array that Spark's file server brought under this name."""
    return DigestArray(SparkFiles.get(name))


def publish(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Send the rules' file to all executors, those that start later included; its name depends on its content."""
    folder = tempfile.mkdtemp(prefix="partwise-rules-")
    draft = os.path.join(folder, "draft")
    pack(rules, draft)
    with open(draft, "rb") as file:
        name = f"rules-{xxhash.xxh3_128_hexdigest(file.read())}.bin"
    os.rename(draft, os.path.join(folder, name))
    if name not in {os.path.basename(f) for f in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    A null url, or one without ``://``, has an empty host and path; no rule fits
    it and it is allowed.  Rows stay in place; only the url and id are read.
    """
    name = publish(pages.sparkSession, rules)
    split = pages.select("page_id", host("url").alias("host"), path("url").alias("path"))
    kind = split.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = opened(name)
        for batch in batches:
            found, verdicts = array.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The query in DuckDB.
SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM b
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
