"""Secret scans: three plain rules, and formats learned by grammar inference.

The rules give spans (kind, start, end) in code points.  Their matches in all
documents are labelled credentials, the label being the kind; of each kind a
bounded sample is learned from.
For each kind the credentials' prefix tree is reduced to a probabilistic
deterministic automaton by state merging (Alergia: Carrasco and Oncina 1994):
two states merge if the Hoeffding bound tells neither their ends nor their next
symbols apart, and the same holds for all states that the merge folds together.
A background model, digram frequencies of character classes in all other words,
says how likely the same token is in ordinary text.  Every
candidate token of every text, those within the rules' spans too, is then scored
by its log-likelihood ratio, bits a symbol; the best kind's candidates over
``LEAST_BITS`` become spans of kind ``like_<kind>``.  Spans that the rules found
stay as they are.

Only the automata, a few thousand numbers whatever the corpus, go to the
executors.  Learning reads the documents once, and the scan is another pass
without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.llm.common import pieces
from partwise.session import cut

# The rules' patterns, kinds in order, and lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
TRIGGERS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Learned candidates: whole runs of these characters, with a digit and a letter, from this length on.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: At most so many distinct credentials of a kind are learned from, those of least hash.
SAMPLE_CREDENTIALS = 2_000
#: Characters whose digrams are counted at a time.
STRETCH = 1 << 18
ALPHA = 0.01
LEAST_BITS = 1.5


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """The rules' spans as (start, place of the kind, end), in order."""
    found = []
    low = text.lower()
    if any(t in low for t in TRIGGERS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def symbol(c: str) -> str:
    """Character class: digits, hex letters, other letters by case, and the rest as they are."""
    if c.isdigit():
        return "0"
    if c in "abcdef":
        return "a"
    if c in "ABCDEF":
        return "A"
    if c.islower():
        return "z"
    if c.isupper():
        return "Z"
    return c


CLASSES = str.maketrans({chr(i): symbol(chr(i)) for i in range(128)})
#: The same by code, with 32 for blanks and 127 for all that isn't ASCII, of which no candidate has any.
_CODES = np.array([32 if chr(i).isspace() else ord(symbol(chr(i))) for i in range(127)] + [127] * 2, np.uint8)
_WIDE_BLANKS = np.array([i for i in range(128, 0x3001) if chr(i).isspace()], np.uint32)


def digrams(texts: list[str]) -> np.ndarray:
    """How often each pair of classes follows one another in the texts' words, as 128 * first + second; a word's edge is 32."""
    joined = " ".join(["", *texts, ""])
    pairs = np.zeros(128 * 128, np.int64)
    for at in range(0, len(joined) - 1, STRETCH):
        # Stretches share a character, so that no pair is lost between them.
        points = np.frombuffer(joined[at : at + STRETCH + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _CODES[np.minimum(points, 128)]
        far = np.flatnonzero(codes == 127)
        codes[far[np.isin(points[far], _WIDE_BLANKS)]] = 32
        pairs += np.bincount(codes[:-1].astype(np.int64) * 128 + codes[1:], minlength=128 * 128)
    pairs[32 * 128 + 32] = 0
    return pairs


def outside(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a blank for each of the rules' spans."""
    parts, at = [], 0
    for start, _, end in spans:
        parts.append(text[at : max(at, start)])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


class Automaton:
    """A probabilistic deterministic automaton learned from strings of symbols."""

    def __init__(self, words: Counter[str], alpha: float = ALPHA) -> None:
        """words: strings with their counts."""
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [defaultdict(int)]
        self.ends = [0]
        for word, count in sorted(words.items()):
            at = 0
            for c in word:
                self.flow[at][c] += count
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.flow.append(defaultdict(int))
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += count
        self._reduce()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.flow[state].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.total(x), self.total(y)
            if self._differ(self.ends[x], n, self.ends[y], m):
                return False
            for c in self.flow[x].keys() | self.flow[y].keys():
                if self._differ(self.flow[x].get(c, 0), n, self.flow[y].get(c, 0), m):
                    return False
                if c in self.next[x] and c in self.next[y]:
                    todo.append((self.next[x][c], self.next[y][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            for c, f in self.flow[y].items():
                self.flow[x][c] += f
                if c in self.next[y]:
                    if c in self.next[x]:
                        todo.append((self.next[x][c], self.next[y][c]))
                    else:
                        self.next[x][c] = self.next[y][c]

    def _reduce(self) -> None:
        """Red states are kept; each blue one, a child of a red one, is folded into the first red that it is like, or kept."""
        red, queue = [0], [(0, c) for c in sorted(self.next[0])]
        while queue:
            parent, c = queue.pop(0)
            blue = self.next[parent][c]
            if blue in red:
                continue
            same = next((r for r in red if self._alike(r, blue)), None)
            if same is None:
                red.append(blue)
                queue += [(blue, d) for d in sorted(self.next[blue])]
            else:
                self.next[parent][c] = same
                self._fold(same, blue)
                queue += [(same, d) for d in sorted(self.next[same]) if self.next[same][d] not in red and (same, d) not in queue]
        self.states = len(red)

    def table(self) -> dict[tuple[int, str], tuple[int, float]]:
        """(state, symbol) to (next state, log2 of its probability); the empty symbol ends."""
        out = {}
        seen, todo = {0}, [0]
        while todo:
            s = todo.pop()
            n = self.total(s)
            if self.ends[s]:
                out[s, ""] = (-1, math.log2(self.ends[s] / n))
            for c, f in self.flow[s].items():
                t = self.next[s][c]
                out[s, c] = (t, math.log2(f / n))
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return out


def likelihood(table: dict, word: str) -> float | None:
    """log2 of the automaton's probability of a string; None if it has none."""
    at, total = 0, 0.0
    for c in word:
        step = table.get((at, c))
        if step is None:
            return None
        at, bits = step
        total += bits
    end = table.get((at, ""))
    return None if end is None else total + end[1]


class Formats:
    """The learned automata by kind, and the background model."""

    def __init__(self, credentials: dict[str, Counter[str]], ordinary: Counter[str]) -> None:
        """credentials: strings of classes by kind; ordinary: words of classes with their counts."""
        pairs: Counter[str] = Counter()
        for word, count in ordinary.items():
            for a, b in zip("^" + word, word + "$", strict=True):
                pairs[a + b] += count
        self._fit(credentials, pairs)

    @classmethod
    def of_digrams(cls, credentials: dict[str, Counter[str]], pairs: Counter[str]) -> Formats:
        """From counts of digrams, ``^`` before and ``$`` after each word, in place of words."""
        made = cls.__new__(cls)
        made._fit(credentials, pairs)
        return made

    def _fit(self, credentials: dict[str, Counter[str]], pairs: Counter[str]) -> None:
        self.tables = {k: Automaton(c).table() for k, c in sorted(credentials.items()) if c}
        singles: Counter[str] = Counter()
        for pair, count in pairs.items():
            singles[pair[0]] += count
        self.pairs = {p: math.log2((c + 1) / (singles[p[0]] + 16)) for p, c in pairs.items()}
        self.rare = {a: math.log2(1 / (c + 16)) for a, c in singles.items()}

    def background(self, word: str) -> float:
        total = 0.0
        for a, b in zip("^" + word, word + "$", strict=True):
            total += self.pairs.get(a + b, self.rare.get(a, -4.0))
        return total

    def best(self, token: str) -> tuple[str, float] | None:
        """The kind whose automaton beats the background most, with its bits a symbol."""
        word = token.translate(CLASSES)
        scores = [(score, kind) for kind, table in self.tables.items() if (score := likelihood(table, word)) is not None]
        if not scores:
            return None
        score, kind = max(scores)
        return kind, (score - self.background(word)) / len(word)


def credential(text: str, start: int, kind: int, end: int) -> str:
    """The secret part of a rule's span."""
    if kind:
        return text[start:end]
    return ASSIGN.match(text, start, end)[2]  # type: ignore[index]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs of credential characters with a digit and a letter."""
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            yield m.start(), m.end()


def learn(docs: DataFrame, most: int = SAMPLE_CREDENTIALS) -> Formats:
    """Fit the automata on the rules' matches in all documents.

    What comes to the driver is bounded in rows: at most ``most`` whole
    credentials of a kind (by least hash, whatever the corpus), and the counts of
    digrams of all words outside the rules' spans, of which there are at most as
    many as pairs of ASCII classes.
    """
    chosen = docs.select("text").where(F.col("text").isNotNull())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()
        pairs = np.zeros(128 * 128, np.int64)
        size = 0
        for batch in pieces(batches, 0):
            ordinary: list[str] = []
            held = 0
            for text in batch.column(0).to_pylist():
                spans = rule_spans(text)
                for start, kind, end in spans:
                    word = credential(text, start, kind, end)
                    counts[KINDS[kind], word] += 1
                    size += len(word)
                ordinary.append(outside(text, spans) if spans else text)
                held += len(text)
                if held > STRETCH:
                    pairs += digrams(ordinary)
                    ordinary, held = [], 0
                if len(counts) > 200_000 or size > 1 << 24:
                    yield packed(counts)
                    counts.clear()
                    size = 0
            pairs += digrams(ordinary)
        for k in np.flatnonzero(pairs).tolist():
            a, b = divmod(k, 128)
            counts["", ("^" if a == 32 else chr(a)) + ("$" if b == 32 else chr(b))] += int(pairs[k])
        yield packed(counts)

    def packed(counts: Counter[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["kind", "word", "n"]
        )

    summed = cut(chosen.mapInArrow(found, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    pairs = Counter({r["word"]: r["n"] for r in summed.where("kind = ''").collect()})
    credentials: dict[str, Counter[str]] = {}
    for kind in KINDS:
        rows = summed.where(F.col("kind") == kind).orderBy(F.xxhash64("word"), "word").limit(most).collect()
        credentials[kind] = Counter(r["word"].translate(CLASSES) for r in rows)
    return Formats.of_digrams(credentials, pairs)


def all_spans(text: str, formats: Formats, least_bits: float = LEAST_BITS) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """The rules' spans, and the learned ones of every candidate, whether a rule found it or not."""
    extra = []
    for s, e in candidates(text):
        best = formats.best(text[s:e])
        if best and best[1] >= least_bits:
            extra.append((s, f"like_{best[0]}", e))
    return rule_spans(text), extra


def beyond(base: list[tuple[int, int, int]], extra: list[tuple[int, str, int]]) -> int:
    """How many learned spans touch none of the rules'."""
    return sum(not any(a < e and s < b for a, _, b in base) for s, _, e in extra)


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned, n_beyond`` of every row.

    ``n_learned`` counts the learned spans, ``n_beyond`` those that touch none of the rules'.

    A null text is empty: no spans, and the digest of the empty string.  An
    empty table teaches nothing and gives an empty result.  Repeated rows are
    scanned alike; other columns are ignored.
    """
    learned = formats or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            counts: list[list[int]] = [[], [], []]
            digests, spans, learnt, alone = [], [], [], []
            for text in batch.column(1).to_pylist():
                base, extra = all_spans(text or "", learned)
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in base))
                digests.append(hashlib.sha256(",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in base]).encode()).hexdigest())
                every = sorted([(s, k, KINDS[k], e) for s, k, e in base] + [(s, 3, k, e) for s, k, e in extra])
                spans.append(",".join([f"{k}:{s}:{e}" for s, _, k, e in every]))
                learnt.append(len(extra))
                alone.append(beyond(base, extra))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(learnt, pa.int64()), pa.array(alone, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned", "n_beyond"],
            )

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long, n_beyond long")


def redact(docs: DataFrame, mark: str = "[secret]", formats: Formats | None = None) -> DataFrame:
    """The rows with every span of their texts, learned ones included, replaced by ``mark``; ``n_chars`` follows where it exists.

    Spans that overlap become one mark.  Null and empty texts, other columns and
    repeated rows stay as they are; an empty table gives an empty result.
    """
    learned = formats or learn(docs)
    names = docs.columns
    place, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            sizes = columns[chars].to_pylist() if chars is not None else []
            for i, text in enumerate(texts):
                if not text:
                    continue
                base, extra = all_spans(text, learned)
                if not base and not extra:
                    continue
                parts, at = [], 0
                for s, e in sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in extra]):
                    if e > at:
                        parts += [text[at : max(at, s)], mark] if s >= at else []
                        at = e
                texts[i] = "".join(parts) + text[at:]
                if chars is not None:
                    sizes[i] = len(texts[i])
            columns[place] = pa.array(texts, columns[place].type)
            if chars is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
