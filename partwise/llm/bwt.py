"""Burrows-Wheeler transforms of shards, and their merge by interleave refinement.

A shard is a set of byte strings.  It is indexed by wide symbols: the symbol at
byte p is the ``Q`` bytes from p on, and the next symbol starts at p + Q, so a
string's Q phases are strings over wide symbols and a context of h symbols is
h * Q bytes.  The transform lists, in order of their contexts, the rows
(suffixes) with the symbol before each and the last-to-first map.

Shards are merged as Holt and McMillan (2014) do: start with the rows of one
shard after the other, and refine: after round h rows are in order of their
first h symbols.  One round is a stable sort of the current rows by the symbol
before each, followed by the last-to-first map; rows of one shard keep their
order, so no suffix is compared again.  A border that appears in round h means a
common prefix of h - 1 symbols (the Gap algorithm of Egidi and Manzini); blocks
of one row can't hold a repeat and leave the refinement.
"""

from __future__ import annotations

import numpy as np

#: Bytes in a wide symbol.
Q = 8


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers, by 16-bit digits."""
    top = int(values.max(initial=0))
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while top >> shift:
        digit = ((values[order] >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


class Shard:
    """Transform of some strings, to a context of ``depth`` symbols; rows of equal contexts keep the order of the text."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        raw = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.firsts = np.cumsum(sizes) - sizes
        n = len(raw)
        wide = np.zeros(max(n - Q + 1, 0), np.uint64)
        for k in range(Q):
            wide = (wide << np.uint64(8)) | raw[k : n - Q + 1 + k]
        owner = np.repeat(np.arange(len(strings)), sizes)
        #: Byte positions that have a whole symbol.
        self.starts = np.flatnonzero(np.arange(len(wide)) + Q <= (self.firsts + sizes)[owner[: len(wide)]])
        self.owner = owner[self.starts]
        self.values, symbol = np.unique(wide[self.starts], return_inverse=True)
        row_of = np.full(n + 1, -1, np.int64)
        row_of[self.starts] = np.arange(len(self.starts))
        following = self._shifted(row_of, sizes, Q)
        rank, reach = symbol + 1, 1
        while reach < depth:
            after = np.where(following >= 0, rank[following], 0)
            key = rank * (int(rank.max(initial=0)) + 1) + after
            rank = np.unique(key, return_inverse=True)[1] + 1
            following = np.where(following >= 0, following[following], -1)
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        before = self._shifted(row_of, sizes, -Q)[self.order]
        #: By row: the symbol of the row that starts Q bytes earlier (-1: there is none), and that row.
        self.bwt = np.where(before >= 0, symbol[before], -1)
        self.last_to_first = np.where(before >= 0, place[before], -1)
        self.first = symbol[self.order]

    def _shifted(self, row_of: np.ndarray, sizes: np.ndarray, by: int) -> np.ndarray:
        """For each start the entry of the position ``by`` bytes on in the same string, or -1."""
        at = self.starts + by
        inside = (at >= self.firsts[self.owner]) & (at < (self.firsts + sizes)[self.owner])
        return np.where(inside, row_of[np.where(inside, at, 0)], -1)


def repeated(shards: list[Shard], tail: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of ``depth`` symbols that more than one row has.

    ``tail`` marks, by shard and text order of its starts, the rows whose
    context's last symbol begins there.  Returns shard, start and block of each
    row found; rows of a block have equal contexts of ``depth`` symbols.
    """
    values = np.unique(np.concatenate([s.values for s in shards])) if shards else np.empty(0, np.uint64)
    symbols, bwt, jump, origin, base = [], [], [], [], 0
    for s in shards:
        new = np.searchsorted(values, s.values)
        symbols.append(new[s.first])
        bwt.append(np.where(s.bwt >= 0, new[s.bwt], -1))
        jump.append(np.where(s.last_to_first >= 0, s.last_to_first + base, -1))
        origin.append(s.order)
        base += len(s.order)
    first, before, back = np.concatenate(symbols), np.concatenate(bwt), np.concatenate(jump)
    marked = np.concatenate([t[s.order] for s, t in zip(shards, tail, strict=True)])
    rows = np.flatnonzero(marked)
    # Round 1: the rows, shard after shard, in order of their first symbol.
    rows = rows[stable_order(first[rows])]
    block = first[rows]
    for turn in range(1, depth + 1):
        border = np.concatenate([[True], block[1:] != block[:-1]]) if len(rows) else np.zeros(0, bool)
        alone = border & np.concatenate([border[1:], [True]]) if len(rows) else border
        rows, block = rows[~alone], np.cumsum(border)[~alone]
        if turn == depth or not len(rows):
            break
        ahead = before[rows] >= 0
        rows, block = rows[ahead], block[ahead]
        symbol = before[rows]
        order = stable_order(symbol)
        pair = symbol[order] * (int(block.max(initial=0)) + 1) + block[order]
        rows, block = back[rows[order]], pair
    shard_of = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])[rows]
    place = np.concatenate(origin)[rows] if len(rows) else rows
    return shard_of, place, block
