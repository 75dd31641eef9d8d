"""BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match.  A sequence of tokens is
the encoding of its bytes exactly if every token encodes itself and every
adjacent pair encodes itself, so the proposals of all new words of a batch are
checked together: their distinct adjacent pairs are looked up in a table of
verdicts with one vectorised search.  Only words with an incompatible pair go
through the exact merge loop.  Words repeat, so verdicts and encodings are kept
for the life of a Python worker, in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import pieces

# Unicode's White_Space characters, and the public byte-level word pattern.
WHITE = "\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Chunks no longer than this, in characters, are kept with their encodings.
KEPT_CHUNK = 64
#: At most about so many chunks and words are kept in the newer of two tables each; a full one takes the older's place, which is dropped.
KEPT = 600_000
#: At most about so many pairs' verdicts are kept; a full table is emptied.
KEPT_PAIRS = 1_200_000
#: Texts encoded together.
BATCH = 512


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by character.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the
    characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary read from a public ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        model = spec["model"]
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        size = 1 + max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        self.ranks = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = (bytes(letters[c] for c in left), bytes(letters[c] for c in right))
            self.ranks.setdefault(pair, rank)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self.added_re = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.longest = max(map(len, self.ids))
        self.chunk_re = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.word_re = regex.compile(SPLIT)
        self.chunks: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self.kept = KEPT
        self.older_chunks: dict[str, str] = {}
        self.older_words: dict[str, str] = {}
        self.names = [str(i) for i in range(size)]
        self.bytes_by_name = dict(zip(self.names, self.bytes_of, strict=True))
        self.pair_keys = np.empty(0, np.int64)
        self.pair_fits = np.empty(0, bool)
        self.speculated = self.merged = 0
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in self.ranks], np.int64)
        ranks = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        made = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks, self.merge_made = keys[order], ranks[order], made[order]
        self._build_trie()

    def _build_trie(self) -> None:
        """Prefix tree over the tokens that merging makes of their own bytes; another is never proposed."""
        tokens = list(self.ids)
        own = [token for token, got in zip(tokens, self.merge_many(tokens), strict=True) if got == (self.ids[token],)]
        states, edges, ends = 1, {}, [-1]
        for token in own:
            at = 0
            for b in token:
                step = edges.get((at << 8) | b)
                if step is None:
                    step = edges[(at << 8) | b] = states
                    states += 1
                    ends.append(-1)
                at = step
            ends[at] = self.ids[token]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_to = np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.ends = np.array(ends, np.int64)
        #: Out of the root a byte leads on without a search.
        self.first = np.array([edges.get(b, -1) for b in range(256)], np.int64)

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge many words of similar length in lockstep.  rows: byte ids, padded; every round joins each word's best pair."""
        none = np.int64(1 << 60)
        width = rows.shape[1]
        columns = np.arange(width)

        def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            keys = (left << 32) | right
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            return np.where(self.merge_keys[at] == keys, at, -1)

        rows, sizes = rows.copy(), sizes.copy()
        found = np.full(rows.shape, -1, np.int64)
        if width > 1:
            found[:, :-1] = look(rows[:, :-1], rows[:, 1:])
            found[:, :-1][columns[1:] >= sizes[:, None]] = -1
        ranks = np.where(found >= 0, self.merge_ranks[found], none)
        live = np.arange(len(rows))
        out = rows.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            going = ranks[every, at] < none
            if not going.all():
                out[live[~going]] = rows[~going]
                rows, sizes_live, ranks, found, at, live = rows[going], sizes[live[going]], ranks[going], found[going], at[going], live[going]
                if not len(live):
                    break
                every = np.arange(len(rows))
            else:
                sizes_live = sizes[live]
            token = self.merge_made[found[every, at]]
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            rows = np.take_along_axis(rows, take, 1)
            ranks = np.take_along_axis(ranks, take, 1)
            found = np.take_along_axis(found, take, 1)
            rows[every, at] = token
            sizes_live = sizes_live - 1
            sizes[live] = sizes_live
            ranks[:, -1] = none
            for left in (at - 1, at):
                fit = (left >= 0) & (left + 1 < sizes_live)
                spot = np.where(fit, left, 0)
                got = np.where(fit, look(rows[every, spot], rows[every, np.minimum(spot + 1, width - 1)]), -1)
                found[every[fit], spot[fit]] = got[fit]
                ranks[every[fit], spot[fit]] = np.where(got[fit] >= 0, self.merge_ranks[got[fit]], none)
                if left is at:
                    ranks[every[~fit], at[~fit]] = none
        return out, sizes

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact encodings of many words; short ones in lockstep by length, long ones one by one."""
        out: list[tuple[int, ...]] = [()] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (4, 8, 12, 16, 24, 40):
            for block in np.array_split(pick := np.flatnonzero((sizes > low) & (sizes <= width)), max(1, len(pick) // 20_000)):
                if len(block):
                    raw = b"".join(words[k].ljust(width, b"\0") for k in block)
                    rows = self.byte_ids[np.frombuffer(raw, np.uint8).reshape(len(block), width)]
                    ids, left = self._merge_rows(rows, sizes[block])
                    for k, row, n in zip(block.tolist(), ids.tolist(), left.tolist(), strict=True):
                        out[k] = tuple(row[:n])
            low = width
        for k in np.flatnonzero(sizes > low):
            out[k] = self.merge(words[k])
        return out

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact encoding of one word: join the pair of lowest rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 200:
            return self._merge_long(parts)
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ids[p] for p in parts)

    def _merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same by a heap over linked parts, for words where a scan a merge would be quadratic."""
        import heapq

        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        live: list[bytes | None] = list(parts)
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if live[i] != left or j < 0 or live[j] != right:
                continue
            live[i], live[j] = left + right, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (rank := self.ranks.get((live[a], live[b]))) is not None:
                    heapq.heappush(heap, (rank, a, live[a], live[b]))
        return tuple(self.ids[p] for p in live if p is not None)

    def propose_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words in lockstep over the prefix tree: all ids in order, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        stop = start + sizes
        owners, tokens = [], []
        live, at = np.flatnonzero(sizes), start[sizes > 0]
        while len(live):
            state = self.first[raw[at]]
            best, length = self.ends[state], np.ones(len(live), np.int64)
            walking, depth = np.arange(len(live)), 1
            while len(walking):
                on = at[walking] + depth
                inside = on < stop[live[walking]]
                walking = walking[inside]
                keys = (state[walking] << 8) | raw[on[inside]]
                spot = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
                fit = self.edge_keys[spot] == keys
                walking, spot = walking[fit], spot[fit]
                depth += 1
                state[walking] = self.edge_to[spot]
                end = self.ends[state[walking]]
                good = end >= 0
                best[walking[good]], length[walking[good]] = end[good], depth
            owners.append(live)
            tokens.append(best)
            at = at + length
            more = at < stop[live]
            live, at = live[more], at[more]
        if not owners:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return token[order], owner[order]

    def _pairs_fit(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left id * 2**32 + right id) encodes itself; new pairs are merged once and kept."""
        distinct, back = np.unique(keys, return_inverse=True)
        spot = np.searchsorted(self.pair_keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.pair_keys)
        known[inside] = self.pair_keys[spot[inside]] == distinct[inside]
        fits = np.zeros(len(distinct), bool)
        fits[known] = self.pair_fits[spot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            sides = [(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in distinct[new]]
            merged = self.merge_many([self.bytes_of[a] + self.bytes_of[b] for a, b in sides])
            fits[new] = [got == side for got, side in zip(merged, sides, strict=True)]
            if len(self.pair_keys) + len(new) > KEPT_PAIRS:
                self.pair_keys, self.pair_fits = distinct, fits
            else:
                every = np.concatenate([self.pair_keys, distinct[new]])
                order = np.argsort(every, kind="stable")
                self.pair_keys = every[order]
                self.pair_fits = np.concatenate([self.pair_fits, fits[new]])[order]
        return fits[back]

    def learn(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words: propose all, check every adjacent pair at once, merge those that fail."""
        flat, owner = self.propose_many(words)
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        adjacent = np.flatnonzero(owner[1:] == owner[:-1])
        failing: list[int] = []
        if len(adjacent):
            bad = ~self._pairs_fit((flat[adjacent] << 32) | flat[adjacent + 1])
            failing = np.unique(owner[adjacent[bad]]).tolist()
        self.speculated += len(words)
        self.merged += len(failing)
        ids = flat.tolist()
        out = {w: tuple(ids[bounds[k] : bounds[k + 1]]) for k, w in enumerate(words)}
        out.update(zip([words[k] for k in failing], self.merge_many([words[k] for k in failing]), strict=True))
        return out

    def _encode_chunks(self, chunks: list[str]) -> dict[str, str]:
        """For each distinct chunk its ids in decimal, joined by commas."""
        if len(self.words) > self.kept:
            self.older_words, self.words = self.words, {}
        known, older, names = self.words, self.older_words, self.names
        parts = [self.word_re.findall(c) for c in chunks]
        # A word that is a whole chunk is kept as that chunk.
        inner = {w for p in parts if len(p) > 1 for w in p}
        known.update((w, older[w]) for w in inner if w not in known and w in older)
        new = list({w for p in parts for w in p if w not in known})
        fresh = {}
        if new:
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            learnt = self.learn(raw)
            fresh = {w: ",".join([names[i] for i in learnt[r]]) for w, r in zip(new, raw, strict=True)}
        out = {c: fresh.get(p[0]) or known[p[0]] if len(p) == 1 else ",".join([fresh.get(w) or known[w] for w in p]) for c, p in zip(chunks, parts, strict=True)}
        known.update((w, fresh[w]) for w in inner if w in fresh and len(w) <= KEPT_CHUNK)
        return out

    def encode_joined(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by commas."""
        if len(self.chunks) > self.kept:
            self.older_chunks, self.chunks = self.chunks, {}
        cache, older = self.chunks, self.older_chunks
        get, split, found, new = cache.get, [], [], set()
        for t in texts:
            part = self._split(t)
            ids = [*map(get, part)]
            if None in ids:
                new.update([c for c, i in zip(part, ids, strict=True) if i is None])
            split.append(part)
            found.append(ids)
        if not new:
            return [",".join(ids) for ids in found]
        fresh = {c: older[c] for c in new if c in older}
        fresh |= self._encode_chunks([c for c in new if c not in fresh and c not in self.added]) | {a: str(i) for a, i in self.added.items()}
        out = [",".join([fresh[c] if i is None else i for c, i in zip(part, ids, strict=True)] if None in ids else ids) for part, ids in zip(split, found, strict=True)]
        cache.update((c, i) for c, i in fresh.items() if len(c) <= KEPT_CHUNK)
        return out

    def _split(self, text: str) -> list[str]:
        """Chunks: runs of what isn't white space with the blank before them, and the white space between.

        No word spans two chunks.  An added token's own text is a chunk of its
        own; elsewhere its text can't be one, as it would have been cut out.
        """
        if self.added_re is None or not self.added_re.search(text):
            return self.chunk_re.findall(text)
        out, at = [], 0
        for m in self.added_re.finditer(text):
            out += self.chunk_re.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.chunk_re.findall(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_names(self, names: list[str]) -> str:
        """The same of ids in decimal."""
        return b"".join(map(self.bytes_by_name.__getitem__, names)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One vocabulary a worker."""
    return Tokenizer(path)


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep_ids: bool = True, kept: int = KEPT) -> DataFrame:
    """Add to each row ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``token_ids`` (binary, little-endian int32).

    ``vocabulary`` is a path that exists on every executor (an installed
    package's file, or one sent with ``--files``).  Null text counts as empty:
    no tokens, digests of the empty string.  Columns of the input that bear one
    of the added names are replaced.  Rows stay in place: no shuffle.  With
    fewer chunks and words ``kept`` (see ``KEPT``), a Python worker takes less
    memory and more time.
    """
    path = vocabulary or default_vocabulary()
    added = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["token_ids binary"] if keep_ids else [])]
    names = {a.split()[0] for a in added}
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), *added])
    place = docs.columns.index(text)
    names_out = [*docs.columns, *[a.split()[0] for a in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        model.kept = kept
        for batch in pieces(batches, place):
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                texts = [t or "" for t in part.column(place).to_pylist()]
                counts, id_digests, text_digests, raw = [], [], [], []
                for joined in model.encode_joined(texts):
                    ids = joined.split(",") if joined else []
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded = model.decode_names(ids)
                    text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep_ids:
                        raw.append(np.fromstring(joined, "<i4", sep=",").tobytes() if joined else b"")
                columns = [*part.columns, pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                if keep_ids:
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document."""
    return encode(docs.select("doc_id", "text"), vocabulary, keep_ids=False).select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
