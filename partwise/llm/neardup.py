"""Near-duplicate documents: Chosen Path set similarity join (Christiani and Pagh 2017; CPSJoin 2018).

A document is the set of its word shingles.  Documents with equal sets are one
class from the start.  A tree of the join sends every class down from its root:
a node draws, from its own name, the minwise values that its records branch on,
one or with chance 1/4 two, 1.25 = 1/0.8 on average, so that a pair at the
threshold is expected to share a child at every level.  The ``TREES`` trees are
independent: each has minwise values of its own, whole ones, at each of the
first ``LEVELS`` levels.  After these a node's records are compared by sketch,
all with all, but for pairs that links connect already.

A sketch has four bits of each of ``WIDTH`` further minwise values.  Nodes larger
than ``CHUNK`` first meet pivots, which link what is like them; a node that this
connects is done, and records that a pivot took tightly are, too.  The rest
branches ``DEEPER`` levels on, by values of the sketch that the node's name
draws, for up to ``TURNS`` turns; what is large even then is compared in full,
block by block.  With twelve trees a pair at the threshold is missed by branching
alone with a chance of 0.000004 at 3 levels, 0.0001 at 5, 0.001 at 7 and 0.007 at
11, the deepest.

The join's loose links (estimated similarity of at least ``LOOSE``) only say
which classes to lay side by side.  Within their components links are confirmed
on the full sets, and what is confirmed is connected as it is found: a pair
that is already connected needs no proof, so a group of near copies costs
about as many proofs as it has members, and only spanning links are emitted.
Groups larger than ``CHUNK`` are proved in chunks that share pivots; members
that don't come out in the group's largest component are then compared with all
of the group, block by block.  Nothing is dropped, and no step holds more than
two chunks of sets in a task.

Words, and the shingles made of them, are known by 64-bit hashes, equal sets by
their size and 128 bits more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import mix64, small
from partwise.llm.graph import components, settle
from partwise.session import cut, discard

#: Minwise values in a sketch, of which it has four bits each.
WIDTH = 128
TREES = 12
#: Levels that are walked before records meet.
LEVELS = 3
#: Levels that a node too large for a task walks at a turn, and such turns.
DEEPER = 2
TURNS = 4
#: Nodes up to this size compare all their records.
SMALL = 48
#: Nodes and groups larger than this are split over tasks.
CHUNK = 1_500
PIVOTS = 6
LOOSE = 0.65
#: Estimated similarity from which a record that a pivot took needn't meet others: the threshold and a margin.
TIGHT = 0.9
#: Bits of the map of ids whose texts are wanted (2 MB), and of one piece of it.
BITS = 1 << 24
PIECE_BITS = 1 << 15
#: Bytes hashed at a time.
SLICE = 1 << 20
#: Words longer than this are hashed by xxh3: polynomials modulo 2^64 collide on long words of a known form.
LONG_WORD = 64

#: A record in a node; records with the same ``held`` are connected already.
NODE = ["node", "id", "held", "sketch"]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_ALONE = np.uint64(0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    held = _TABLES.get(name)
    if held is None or len(held) < n:
        held = _TABLES[name] = _powers(base, max(n, SLICE + 4096))
    return held[:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of some bytes starts, and its hash, A-Z taken as a-z.  Long texts are hashed in slices that end at a blank."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            tail = np.flatnonzero(_BLANK[raw[at:end]])
            if len(tail):
                end = at + int(tail[-1]) + 1
            else:
                ahead = np.flatnonzero(_BLANK[raw[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(raw)
        part = raw[at:end]
        inside = np.concatenate([[False], ~_BLANK[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[part] + np.uint64(1)) * _table("up", _BASE, len(part)), dtype=np.uint64)])
            starts.append(s + at)
            own = mix64((sums[e] - sums[s]) * _table("down", pow(_BASE, -1, 1 << 64), len(part))[s])
            for k in np.flatnonzero(e - s > LONG_WORD).tolist():
                own[k] = xxhash.xxh3_64_intdigest(_LOWER[part[s[k] : e[k]]].astype(np.uint8).tobytes())
            hashes.append(own)
        at = end
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(column: pa.Array, length: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; fewer words than a shingle has are one shingle; null or blank: none."""
    data = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = data.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    out = []
    at = 0
    while at < len(data):
        # As many texts as fit a slice are hashed together, with a blank after each.
        stop = at + 1
        while stop < len(data) and offsets[stop + 1] - offsets[at] + (stop - at) < SLICE:
            stop += 1
        size = int(offsets[stop] - offsets[at]) + stop - at
        block = np.full(size, 32, np.uint8)
        firsts = np.empty(stop - at + 1, np.int64)
        pos = 0
        for k in range(at, stop):
            n = int(offsets[k + 1] - offsets[k])
            block[pos : pos + n] = raw[offsets[k] : offsets[k + 1]]
            firsts[k - at] = pos
            pos += n + 1
        firsts[-1] = pos
        starts, words = word_hashes(block)
        bounds = np.searchsorted(starts, firsts).tolist()
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            own = words[lo:hi]
            if not len(own):
                out.append(own)
                continue
            width = min(length, len(own))
            joined = own[: len(own) - width + 1].copy()
            if width < length:
                joined = joined + _ALONE * np.uint64(length - width)
            for j in range(1, width):
                joined = mix64(joined * _PAIR + own[j : len(own) - width + 1 + j])
            joined = mix64(joined)
            joined.sort()
            out.append(joined[np.concatenate([[True], joined[1:] != joined[:-1]])])
        at = stop
    return out


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix64(np.arange(100_001, 100_001 + n, dtype=np.uint64))


def minwise(sets: list[np.ndarray]) -> Iterator[tuple[list[int], Iterator[np.ndarray]]]:
    """For runs of the sets that aren't empty: which they are, and their minwise values, those of the sketch and then those of the trees."""
    full = [k for k, s in enumerate(sets) if len(s)]
    a, b = _coefficients(WIDTH + 2 * LEVELS * TREES)
    at = 0
    while at < len(full):
        stop, size = at, 0
        while stop < len(full) and (stop == at or size + len(sets[full[stop]]) < 1 << 15):
            size += len(sets[full[stop]])
            stop += 1
        flat = np.concatenate([sets[k] for k in full[at:stop]])
        firsts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full[at:stop]])[:-1]])
        scratch = np.empty_like(flat)

        def values(flat=flat, firsts=firsts, scratch=scratch) -> Iterator[np.ndarray]:
            for j in range(len(a)):
                np.multiply(flat, a[j], out=scratch)
                scratch += b[j]
                yield mix64(np.minimum.reduceat(scratch, firsts))

        yield full[at:stop], values()
        at = stop


def branched(nodes: np.ndarray, owner: np.ndarray, values: list[np.ndarray], salts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One level: the children of (node, record) pairs by one value or two, and the record of each.  A node's draw depends on its name alone."""
    two = (mix64(nodes) >> np.uint64(56)) < 64
    out_nodes, out_owner = [], []
    for value, salt, chosen in zip(values, salts, (np.ones(len(nodes), bool), two), strict=True):
        out_nodes.append(mix64(mix64(nodes[chosen] * _PAIR + salt[chosen]) ^ value[chosen]))
        out_owner.append(owner[chosen])
    return np.concatenate(out_nodes), np.concatenate(out_owner)


def sketched(sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sketches, a row of bytes a set, and the nodes that each set reaches in all trees; empty sets have zeros and none."""
    rows = np.zeros((len(sets), WIDTH // 2), np.uint8)
    nodes: list[np.ndarray] = [np.empty(0, np.uint64)] * len(sets)
    for which, values in minwise(sets):
        parts = np.stack([next(values) & np.uint64(15) for _ in range(WIDTH)], axis=1).astype(np.uint8)
        rows[which] = parts[:, ::2] | (parts[:, 1::2] << 4)
        reached, owners = [], []
        for t in range(TREES):
            at, owner = np.full(len(which), mix64(np.array([t + 1], np.uint64))[0]), np.arange(len(which))
            for _ in range(LEVELS):
                one, other = next(values), next(values)
                at, owner = branched(at, owner, [one[owner], other[owner]], [np.zeros(len(at), np.uint64), np.ones(len(at), np.uint64)])
            reached.append(at)
            owners.append(owner)
        flat, owner = np.concatenate(reached), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        for k, own in zip(which, np.split(flat[order], np.cumsum(np.bincount(owner, minlength=len(which)))[:-1]), strict=True):
            nodes[k] = own
    return rows, nodes


def described(docs: DataFrame, length: int = 2) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sketch, nodes``: the set's size, two 64-bit digests of it, its sketch, and its nodes in all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(1), length)
                rows, nodes = sketched(sets)
                f1 = [int(mix64(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                f2 = [int(np.bitwise_xor.reduce(s * _PAIR)) if len(s) else 0 for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(n) for n in nodes])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(f1, np.uint64).view(np.int64)),
                        pa.array(np.array(f2, np.uint64).view(np.int64)),
                        pa.array([r.tobytes() for r in rows], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *nodes]).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "nodes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary, nodes array<long>")


def matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows of their values."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), WIDTH // 2)
    out = np.empty((len(column), WIDTH), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def share(similarity: float) -> float:
    """The share of equal values in the sketches of sets that are so similar; four bits agree by chance in a sixteenth of the rest."""
    return 1 / 16 + similarity * 15 / 16


def descend(nodes: np.ndarray, rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level below the first ones, by values of the sketch that the node's name draws."""
    draw = mix64(nodes ^ np.uint64(0x5851F42D4C957F2D))
    picks = [((draw >> np.uint64(shift)) % np.uint64(WIDTH)).astype(np.int64) for shift in (0, 20)]
    return branched(nodes, owner, [rows[owner, p].astype(np.uint64) for p in picks], [p.astype(np.uint64) + np.uint64(2 + k * WIDTH) for k, p in enumerate(picks)])


def deeper(nodes: DataFrame, levels: int) -> DataFrame:
    """``(node, id, held, sketch)`` so many levels below ``(node, id, held, sketch)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, at, owner = matrix(batch.column(3)), batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows)
            for _ in range(levels):
                at, owner = descend(at, rows, owner)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), *[batch.column(k).take(take) for k in (1, 2, 3)]], names=NODE)

    return nodes.select(*NODE).mapInArrow(run, "node long, id long, held long, sketch binary")


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows, whole groups each, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        last = [table.column(k)[-1].as_py() for k in range(keys)]
        same = np.ones(table.num_rows, bool)
        for k in range(keys):
            same &= table.column(k).to_numpy() == last[k]
        n = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        if n:
            yield table.slice(0, n)
        held = table.slice(n).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def all_pairs(sizes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair within each of many small runs."""
    a, b = [], []
    for s in np.unique(sizes):
        if s > 1:
            i, j = np.triu_indices(int(s), 1)
            base = firsts[sizes == s][:, None]
            a.append((base + i).ravel())
            b.append((base + j).ravel())
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def estimate(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal sketch values of pairs."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = (rows[a[part]] == rows[b[part]]).mean(axis=1)
    return out


def closeness(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Share of sketch values in which each row equals ``one``."""
    same = np.ascontiguousarray(rows == one).view(np.uint64)
    return ((same.sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)) / WIDTH


def spanning(rows: np.ndarray, label: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning loose links between records ``first`` and ``second``: all pairs are compared, but for those that ``label`` or earlier links connect."""
    label, a, b = label.copy(), [], []
    for i in first:
        open_ = second[label[second] != label[i]]
        if not len(open_):
            continue
        hit = open_[closeness(rows[open_], rows[i]) >= share(LOOSE)]
        if len(hit):
            merged, at = np.unique(label[hit], return_index=True)
            a += [int(i)] * len(at)
            b += hit[at].tolist()
            label[np.isin(label, merged)] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def star(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links among records as one link from each to the first of its component."""
    label = settle(len(ids), a, b)
    other = np.flatnonzero(label != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], names=["a", "b"])


def loose_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: spanning loose links of each node that fits a task.

    ``nodes``: ``node, id, held, sketch``; records with the same ``held`` are
    connected already.  Records come by id, so that nodes of much the same
    records name the same centre.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 1):
            node = table.column(0).to_numpy()
            sizes = np.diff(first_of_runs(node))
            keep = np.repeat(sizes > 1, sizes)
            if not keep.any():
                continue
            node, ids, held = node[keep], table.column(1).to_numpy()[keep], table.column(2).to_numpy()[keep]
            rows = matrix(table.column(3).filter(pa.array(keep)).combine_chunks())
            cuts = first_of_runs(node)
            sizes, firsts = np.diff(cuts), cuts[:-1]
            tiny = sizes <= SMALL
            a, b = all_pairs(sizes[tiny], firsts[tiny])
            apart = held[a] != held[b]
            a, b = a[apart], b[apart]
            fit = estimate(rows, a, b) >= share(LOOSE)
            links = [(a[fit], b[fit])]
            for lo, n in zip(firsts[~tiny].tolist(), sizes[~tiny].tolist(), strict=True):
                every = np.arange(n)
                i, j = spanning(rows[lo : lo + n], held[lo : lo + n], every, every)
                links.append((i + lo, j + lo))
            yield star(ids, np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))

    return nodes.select(*NODE).repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, "a long, b long")


def split_large(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loose links of nodes too large for a task ``(node, id, held, sketch, n, m)``, from ``m`` chunks that share pivots, and ``(node, id, held, sketch)`` of what no pivot took tightly, ``held`` being a pivot that it is linked to if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            node, chunk, first, ids, held = (table.column(k).to_numpy() for k in range(5))
            rows = matrix(table.column(5).combine_chunks())
            cuts = first_of_runs(node, chunk)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                pivots = lo + np.flatnonzero(first[lo:hi])
                close = np.stack([closeness(rows[lo:hi], rows[p]) for p in pivots]) if len(pivots) else np.zeros((1, hi - lo))
                p, r = np.nonzero(close[: len(pivots)] >= share(LOOSE))
                # Pivots come first and by id, so a component's first record is its pivot of least id, the same in every chunk.
                label = settle(hi - lo, pivots[p] - lo, r)
                mine = ids[lo:hi]
                tied = np.flatnonzero(mine[label] != mine)
                now = held[lo:hi].copy()
                now[tied] = mine[label[tied]]
                now[: len(pivots)] = mine[label[: len(pivots)]]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(tied), pa.int64()), pa.array(mine[tied]), pa.array(mine[label[tied]]), pa.nulls(len(tied), pa.binary())], names=NODE)
                far = np.flatnonzero((close.max(axis=0) < share(TIGHT)) & (first[lo:hi] == 0))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + far]), pa.array(mine[far]), pa.array(now[far]), table.column(5).take(pa.array(lo + far)).combine_chunks()], names=NODE)

    # By the id alone, so that nodes of much the same records have much the same pivots.
    rank = F.xxhash64("id")
    sample = nodes.withColumn("h", rank).where(F.col("h").cast("double") < F.lit(-(2.0**63)) + F.lit(8.0 * PIVOTS * 2.0**64) / F.col("n"))
    pivots = sample.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("h", "id"))).where(F.col("r") <= PIVOTS)
    many = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("first", F.lit(1))
    laid = nodes.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("m"))).withColumn("first", F.lit(0))
    names = ["node", "chunk", "first", "id", "held", "sketch"]
    dealt = laid.select(*names).unionByName(many.select(*names)).repartition("node", "chunk").sortWithinPartitions("node", "chunk", F.desc("first"), "id")
    out = cut(dealt.mapInArrow(run, "node long, id long, held long, sketch binary"))
    return out.where("node is null").select(F.col("id").alias("a"), F.col("held").alias("b")), out.where("node is not null")


def block_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: spanning loose links of nodes ``(node, id, held, sketch, m)``, dealt to ``m`` blocks of which each meets itself and every other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 3):
            node, low, high, block, ids, held = (table.column(k).to_numpy() for k in range(6))
            rows = matrix(table.column(6).combine_chunks())
            cuts = first_of_runs(node, low, high)
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                part, own = rows[lo:hi], block[lo:hi]
                a, b = spanning(part, held[lo:hi], np.flatnonzero(own == low[lo]), np.flatnonzero(own == high[lo]))
                yield star(ids[lo:hi], a, b)

    dealt = nodes.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("m"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("node", "low", "high", "block", "id", "held", "sketch")
    key = ["node", "low", "high"]
    return dealt.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(run, "a long, b long")


def candidates(classes: DataFrame) -> DataFrame:
    """Loose links of all classes ``(id, sketch, nodes)``: small nodes are compared in full, nodes too large for a task meet pivots and branch on.

    Most nodes hold one record, which has nobody to meet there; only records of
    nodes with more take their sketches along.
    """

    def counted(nodes: DataFrame) -> DataFrame:
        """Size and number of chunks of nodes that are too large for a task or hold records that aren't connected yet (``open``)."""
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n"), (F.min("held") != F.max("held")).alias("open"))
        return cut(sizes.where((F.col("n") > CHUNK) | F.col("open")).withColumn("m", F.ceil(F.col("n") / CHUNK)))

    # Rows that repeat an id have sketches of their own.
    own = classes.withColumns({"held": F.col("id"), "record": F.xxhash64("id", "sketch")})
    nodes = own.select(F.explode("nodes").alias("node"), "record", "id", "held", "sketch")
    found = []
    for turn in range(TURNS + 1):
        sizes = counted(nodes)
        large = sizes.where(F.col("n") > CHUNK)
        some = not large.isEmpty()
        few = nodes.join(small(large.select("node")), "node", "left_anti") if some else nodes
        if turn == 0:
            met = few.select("node", "record").join(sizes.where(F.col("n") <= CHUNK).select("node"), "node")
            few = met.join(own.select("record", "id", "held", "sketch"), "record")
        found.append(loose_links(few))
        if not some:
            break
        rest = nodes.join(small(large.where("open").drop("open")), "node").drop("record")
        if turn == TURNS:
            found.append(block_links(rest))
            break
        links, left = split_large(rest)
        found.append(links)
        # What pivots have connected as a whole has nothing left to find.
        parted = left.groupBy("node").agg((F.min("held") != F.max("held")).alias("open")).where("open").select("node")
        nodes = cut(deeper(left.join(parted, "node"), DEEPER))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def linked(a: np.ndarray, b: np.ndarray, least: int = 80) -> bool:
    """Whether 100 * intersection >= least * union, on full sorted sets."""
    if min(len(a), len(b)) * 100 < least * max(len(a), len(b)):
        return False
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    shared = int((big[at] == small).sum())
    return shared * 100 >= least * (len(a) + len(b) - shared)


def prove(sets: list[np.ndarray], rows: np.ndarray, left: np.ndarray, right: np.ndarray, least: int = 80) -> tuple[list[int], list[int]]:
    """Spanning confirmed links between ``left`` and ``right`` records, by descending estimate; connected pairs are skipped."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    others = rows[right]
    for at in range(0, len(left), 64):
        part = left[at : at + 64]
        close = np.stack([closeness(others, rows[i]) for i in part])
        i, j = np.nonzero(close >= share(LOOSE))
        first, second = part[i], right[j]
        fit = first != second
        rounds.append((first[fit], second[fit], close[i[fit], j[fit]]))
    if not rounds:
        return [], []
    first, second, close = (np.concatenate([r[k] for r in rounds]) for k in range(3))
    twice = first > second
    first, second = np.where(twice, second, first), np.where(twice, first, second)
    order = np.lexsort((second, first, -close))
    for i, j in zip(first[order].tolist(), second[order].tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y and linked(sets[i], sets[j], least):
            root[max(x, y)] = min(x, y)
            a_out.append(i)
            b_out.append(j)
    return a_out, b_out


def proofs(laid: DataFrame, least: int) -> DataFrame:
    """Confirmed spanning links of each (group, cell): between its ``side`` 0 and all of it if there is a side 1, else within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, 2):
            group, cell, side, ids = (table.column(k).to_numpy() for k in range(4))
            cuts = first_of_runs(group, cell)
            rows = matrix(table.column(4).combine_chunks())
            raw = table.column(5).to_pylist()
            a, b = [], []
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                sets = [np.frombuffer(x, np.uint64) for x in raw[lo:hi]]
                place = np.arange(hi - lo)
                own = side[lo:hi]
                i, j = prove(sets, rows[lo:hi], place[own == 0], place if (own == 0).all() else place[own == 1], least)
                a += [int(ids[lo + x]) for x in i]
                b += [int(ids[lo + x]) for x in j]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    names = ["group", "cell", "side", "id", "sketch", "hashes"]
    return laid.select(*names).repartition("group", "cell").sortWithinPartitions("group", "cell").mapInArrow(run, "a long, b long")


def marked(docs: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """``docs`` with ``_near_wanted``: true for rows whose ``key`` is the ``id`` of a member, false for most others and all without one.

    The members' ids set bits of a map of ``BITS`` bits, sent to all tasks in
    pieces of 4 KB; a row is wanted if its bit is set.
    """

    def bit(name: str) -> Column:
        return F.pmod(F.xxhash64(name, F.lit(9)), F.lit(BITS))

    bits = members.select(bit("id").alias("bit")).groupBy((F.col("bit") / PIECE_BITS).cast("long").alias("_near_piece"))
    held = cut(bits.agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(PIECE_BITS))).alias("_near_bits")))
    at = F.pmod(bit(key), F.lit(PIECE_BITS))
    byte = F.conv(F.hex(F.substring("_near_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (at % 8).cast("int")) == 1
    named = docs.withColumn("_near_piece", (bit(key) / PIECE_BITS).cast("long")).join(F.broadcast(held), "_near_piece", "left")
    return named.withColumn("_near_wanted", F.coalesce(on, F.lit(False)) & F.col(key).isNotNull()).drop("_near_piece", "_near_bits")


def among(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``docs`` without most rows whose ``id`` no member has, so that a join needn't shuffle their texts."""
    return marked(docs, members).where("_near_wanted").drop("_near_wanted")


def with_sets(members: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Members ``(id, ...)`` with the sets of the documents of their ids, as bytes in ``hashes``."""
    joined = members.join(among(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), members), "id")
    names = [c for c in joined.columns if c != "text"]
    place = joined.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(place), length)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(names) + 1) if k != place], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "hashes"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "text"), "hashes binary"])
    return joined.mapInArrow(run, schema)


def confirmed(classes: DataFrame, docs: DataFrame, loose: DataFrame, length: int, least: int) -> DataFrame:
    """Links that hold on full sets: spanning links of the classes' components."""
    groups = loose.withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    groups = groups.join(sizes.withColumn("m", F.ceil(F.col("n") / CHUNK)), "group")
    members = classes.join(groups, "id").select("id", "sketch", "group", "n", "m")
    sets = with_sets(members, docs, length).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("m")))
    pivot = F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < PIVOTS
    spread = F.when((F.col("m") > 1) & pivot, F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).otherwise(F.array("chunk"))
    links = cut(proofs(sets.withColumn("cell", F.explode(spread)).withColumn("side", F.lit(0)), least))
    large = cut(groups.where("m > 1"))
    if large.isEmpty():
        return links
    # Groups in chunks: what isn't in the group's largest component meets the whole group.
    labels = large.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labels.groupBy("group", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("group").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"))
    stray = cut(labels.join(main, "group").where("parts > 1").withColumn("stray", F.col("component") != F.col("main")).select("id", "group", "m", "stray"))
    if stray.isEmpty():
        return links
    strays = stray.where("stray").groupBy("group").agg(F.ceil(F.count("*") / CHUNK).alias("blocks"))
    whole = classes.join(stray.join(strays, "group"), "id").select("id", "sketch", "group", "m", "stray", "blocks")
    whole = with_sets(whole, docs, length).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("m"))).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    ask = whole.where("stray").withColumn("chunk", every("m")).withColumn("side", F.lit(0))
    told = whole.withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    cells = ask.unionByName(told).withColumn("cell", F.col("block") * F.col("m") + F.col("chunk"))
    return links.unionByName(proofs(cells, least))


def near_duplicates(docs: DataFrame, length: int = 2, least: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    ``length`` words make a shingle; ``least`` is the threshold in hundredths.
    Null and blank texts have the empty set and are linked with nothing.  Rows
    with equal sets are linked.  Rows that repeat an id are one vertex.  A row
    with a null id belongs to the component of the rows with its set that have
    one, and otherwise to a null component of its own and is kept.  An empty
    table gives an empty result; other columns are ignored.
    """
    rows = cut(described(docs, length))
    key = ["n_shingles", "f1", "f2"]
    full = rows.where("n_shingles > 0 and doc_id is not null")
    first = F.first(F.struct("sketch", "nodes")).alias("first")
    classes = cut(full.groupBy(*key).agg(F.min("doc_id").alias("id"), first).select(*key, "id", "first.*"))
    found = cut(candidates(classes))
    loose = cut(components(found))
    discard(found)
    links = confirmed(classes.select("id", "sketch"), docs, loose, length, least)
    exact = components(links)
    named = classes.select(*key, "id").join(exact, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    rows = rows.select("doc_id", *key)
    # Empty sets are linked with nothing; they would all meet under one key.
    out = rows.where("n_shingles > 0").join(named, key, "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def same(a: Column, b: Column) -> Column:
    """Equal, or both null."""
    return a.eqNullSafe(b)


def deduplicated(docs: DataFrame, length: int = 5, least: int = 80) -> DataFrame:
    """One row of each component, with the input's columns: that of the least id.

    Of rows that repeat an id one stays; rows with a null id all stay.
    """
    verdict = cut(near_duplicates(docs, length, least)).where("doc_id is not null")
    gone = cut(verdict.where("not kept").select(F.col("doc_id").alias("id")).distinct())
    again = cut(verdict.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"))
    # Only rows that may go are shuffled; most others stay where they are, however many go.
    rows = marked(docs.withColumn("_near_id", F.col("doc_id").cast("long")), gone.unionByName(again), "_near_id")
    asked = rows.where("_near_wanted").join(gone.withColumnRenamed("id", "_near_gone"), F.col("_near_id") == F.col("_near_gone"), "left_anti")
    if not again.isEmpty():
        asked = asked.dropDuplicates(["_near_id"])
    return rows.where("not _near_wanted").unionByName(asked).drop("_near_id", "_near_wanted")
