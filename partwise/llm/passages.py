"""Repeated passages: every byte under a string of ``LENGTH`` bytes that occurs twice is removed.

Texts are cut into fragments: maximal runs of windows of ``LENGTH`` bytes that
share their anchor, the leftmost of the window's ``GRAM``-byte strings with the
least hash.  Equal windows have equal anchors at equal offsets, so only
fragments of one anchor can share a window.  Anchors that occur once are done;
fragments that occur twice as a whole are repeated as a whole.  What is left,
different fragments of one anchor, is compared by merging the Burrows-Wheeler
transforms of shards of them (see ``bwt``): a merged block of rows with a common
prefix of ``LENGTH`` bytes is a repeated window.  The comparison is exact; the
identity of fragments rests on 128 bits of hash.

Nothing is gathered but what one document holds and ``CROWD`` distinct fragments of
one anchor, twice; an anchor with more has them dealt to blocks, of which each is
compared with itself and every other.  Rows are known by a hash of id and text, so ids need not be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.bwt import Q, Shard, repeated
from partwise.llm.common import mix64, small
from partwise.llm.neardup import _BASE, _table, first_of_runs, grouped
from partwise.session import cut, release

LENGTH = 200
GRAM = 40
#: Anchors' places in a window.
SPAN = LENGTH - GRAM + 1
#: Half of a window's bytes besides its anchor.
HALF = (LENGTH - GRAM) // 2
#: Bytes that are cut into fragments at a time.
SLICE = 1 << 20
#: Distinct fragments of an anchor that are compared as one block.
CROWD = 500
#: Bytes in a shard.
SHARD = 1 << 19


def binary_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    data = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = data.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)), offsets


def fragments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, fragment hash, anchor's offset, number of windows and first window of each fragment.

    ``ends``: for each byte the end of its text; windows don't cross it.
    """
    n = len(raw)
    empty = np.empty(0, np.int64)
    if n < LENGTH:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    up, down = _table("up", _BASE, n), _table("down", pow(_BASE, -1, 1 << 64), n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(key) % SPAN
    full = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[SPAN - 1 : SPAN - 1 + windows])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.arange(windows) + LENGTH <= ends[:windows]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    over = valid.copy()
    over[:-1] &= new[1:] | ~valid[1:]
    low, high = np.flatnonzero(new), np.flatnonzero(over)
    at = anchor[low]
    content = mix64((sums[high + LENGTH] - sums[low]) * down[low])
    return grams[at], content, at - low, high - low + 1, low


def occurrences(docs: DataFrame) -> DataFrame:
    """``(anchor, content, doc, place)`` of every fragment; ``place`` packs first window, anchor's offset and windows less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = binary_of(batch.column(1))
            keys = batch.column(0).to_numpy()
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and offsets[stop + 1] - offsets[at] < SLICE:
                    stop += 1
                lo, end = int(offsets[at]), int(offsets[stop])
                while lo < end:
                    hi = min(end, lo + SLICE + LENGTH - 1) if stop == at + 1 else end
                    part = raw[lo:hi]
                    owner = np.repeat(np.arange(at, stop), np.diff(np.clip(offsets[at : stop + 1], lo, hi)))
                    ends = np.minimum(offsets[1:][owner], hi) - lo
                    anchor, content, offset, count, first = fragments(part, ends)
                    if len(first):
                        own = owner[first]
                        place = ((first + lo - offsets[own]) << 16) | (offset << 8) | (count - 1)
                        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(keys[own]), pa.array(place)], names=["anchor", "content", "doc", "place"])
                    if hi == end:
                        break
                    lo = hi - LENGTH + 1
                at = stop

    return docs.select("doc", "text").mapInArrow(run, "anchor long, content long, doc long, place long")


def contents(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(anchor, content, shape, bytes, blocks)`` of fragments ``(anchor, content, doc, place, blocks)``, cut from their documents."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "place", "blocks")).alias("found"))
    joined = docs.select("doc", "text").join(lists, "doc").select("text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                raw, offsets = binary_of(part.column(0))
                lists = part.column(1)
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                place = flat.field(2).to_numpy()
                first = offsets[owner] + (place >> 16)
                stop = first + (place & 0xFF) + LENGTH
                body = [raw[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(1), pa.array((place & 0xFFFF).astype(np.int32)), pa.array(body, pa.binary()), flat.field(3)], names=["anchor", "content", "shape", "bytes", "blocks"])

    return joined.mapInArrow(run, "anchor long, content long, shape int, bytes binary, blocks long")


def compared(parts: DataFrame) -> DataFrame:
    """``(anchor, content, shape, low, high)``: runs of windows of fragments that another fragment of the anchor has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            anchor, low, high, content, shape = (table.column(k).to_numpy() for k in range(5))
            again = np.zeros(len(anchor), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (low[1:] == low[:-1]) & (high[1:] == high[:-1]) & (content[1:] == content[:-1]) & (shape[1:] == shape[:-1])
            table = table.filter(pa.array(~again))
            anchor, low, high, content, shape = (c[~again] for c in (anchor, low, high, content, shape))
            strings = table.column(5).to_pylist()
            sizes = np.fromiter(map(len, strings), np.int64, len(strings))
            groups = first_of_runs(anchor, low, high)
            filled = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(groups) - 1:
                # As many anchors, or pairs of their blocks, as fit two shards are compared together.
                stop = at + 1
                while stop < len(groups) - 1 and filled[groups[stop + 1]] - filled[groups[at]] <= 2 * SHARD:
                    stop += 1
                lo, hi = int(groups[at]), int(groups[stop])
                at = stop
                if hi - lo < 2:
                    continue
                pick = np.arange(lo, hi)
                if high[lo:hi].any():
                    # A fragment is in several pairs of its anchor's blocks; met twice it would be its own repeat.
                    keys = np.stack([anchor[lo:hi], content[lo:hi], shape[lo:hi].astype(np.int64)], axis=1)
                    pick = lo + np.sort(np.unique(keys, axis=0, return_index=True)[1])
                pick = pick[paired(anchor[pick], shape[pick], [strings[k] for k in pick])]
                if len(pick) < 2:
                    continue
                found = shared_windows([strings[k] for k in pick])
                if len(found[0]):
                    who = pick[found[0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[who]), pa.array(content[who]), pa.array(shape[who]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))],
                        names=["anchor", "content", "shape", "low", "high"],
                    )

    block = F.pmod(F.xxhash64("content", "shape"), F.col("blocks"))
    dealt = parts.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("anchor", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "content", "shape", "bytes")
    ordered = cells.repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high", "content", "shape")
    return ordered.mapInArrow(run, "anchor long, content long, shape int, low int, high int").distinct()


def paired(anchor: np.ndarray, shape: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which fragments may share a window with another of their anchor.

    The anchor stands at the same place in equal windows, and at least half of
    what a window has besides it is on one side.  So fragments that share one
    have the same ``HALF`` bytes before their anchors or after them.
    """
    before: dict[tuple[int, bytes], int] = {}
    after: dict[tuple[int, bytes], int] = {}
    sides = []
    for name, offset, raw in zip(anchor.tolist(), (shape >> 8).tolist(), strings, strict=True):
        left = (name, raw[offset - HALF : offset]) if offset >= HALF else None
        right = (name, raw[offset + GRAM : offset + GRAM + HALF]) if offset + GRAM + HALF <= len(raw) else None
        sides.append((left, right))
        if left is not None:
            before[left] = before.get(left, 0) + 1
        if right is not None:
            after[right] = after.get(right, 0) + 1
    return np.array([before.get(left, 0) > 1 or after.get(right, 0) > 1 for left, right in sides], bool)


def shared_windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, first and last window of each run of windows that another string has too."""
    depth = LENGTH // Q
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    cuts, held = [0], 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > SHARD:
            cuts.append(k)
            held = 0
        held += n
    cuts.append(len(strings))
    shards, tails = [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        shard = Shard(strings[lo:hi], depth)
        inner = shard.starts - shard.firsts[shard.owner]
        shards.append(shard)
        tails.append(inner >= LENGTH - Q)
    which, row, _ = repeated(shards, tails, depth)
    text = np.empty(len(row), np.int64)
    window = np.empty(len(row), np.int64)
    for k, shard in enumerate(shards):
        own = which == k
        at = row[own]
        text[own] = shard.owner[at] + cuts[k]
        window[own] = shard.starts[at] - shard.firsts[shard.owner[at]]
    order = np.lexsort((window, text))
    text, window = text[order], window[order]
    if not len(text):
        return text, window, window
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text)) - 1
    return text[first], window[first], window[last]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, start, stop)``: byte spans, possibly overlapping, that together cover every repeated window of documents ``(doc, text)``."""
    spark = docs.sparkSession
    found = occurrences(docs)
    shape = F.col("place").bitwiseAND(0xFFFF).cast("int")
    anchors = found.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min(F.struct("content", shape)) != F.max(F.struct("content", shape))).alias("mixed")
    )
    anchors = cut(anchors.where("n > 1").select("anchor", "mixed"))
    release(spark)
    twice = cut(found.join(anchors, "anchor").select("anchor", "content", shape.alias("shape"), "doc", "place", "mixed"))
    release(spark)
    key = ["anchor", "content", "shape"]
    distinct = twice.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc", "place")).alias("at"), F.first("mixed").alias("mixed"))
    distinct = cut(distinct.where("n > 1 or mixed"))
    crowds = distinct.where("mixed").groupBy("anchor").agg(F.ceil(F.count("*") / CROWD).alias("blocks")).where("blocks > 1")
    single = distinct.where("mixed").join(small(cut(crowds)), "anchor", "left").select("anchor", "content", "at.doc", "at.place", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
    partial = cut(compared(contents(single, docs)))
    release(spark)
    whole = distinct.where("n > 1").select(*key, F.lit(0).alias("low"), F.col("shape").bitwiseAND(0xFF).alias("high"))
    partial = partial.join(whole.select(*key), key, "left_anti").select(*key, "low", "high")
    spans = twice.select(*key, "doc", "place").join(whole.unionByName(partial), key)
    start = F.shiftright("place", 16)
    return spans.select("doc", (start + F.col("low")).alias("start"), (start + F.col("high") + LENGTH).alias("stop"))


def removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and, if asked, ``kept`` (the bytes left).

    A null text is empty.  Rows that repeat a text repeat its passages, so from
    ``LENGTH`` bytes on nothing is left of them.  Texts shorter than that stay.
    An empty table gives an empty result; other columns are ignored.
    """
    keyed = docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(keyed).groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    joined = keyed.join(spans, "doc", "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, digests, kept = [], [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, at, n, cut_out = [], 0, 0, 0
                for low, high in merged([(s["start"], s["stop"]) for s in found or []]):
                    left.append(raw[at:low])
                    cut_out += high - low
                    n += 1
                    at = high
                rest = b"".join([*left, raw[at:]])
                sizes.append(len(raw))
                gone.append(cut_out)
                runs.append(n)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, runs)], pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out
