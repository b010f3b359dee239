"""Language-model scores: logistic mixing of hashed-context bit predictors, and an add-half unigram base.

Tokens are a text's lower-cased (A-Z) words, then one end. The model writes a text in binary decisions of two kinds,
each predicted by several hashed contexts, mixed by gated weights and refined by an adaptive probability map:

* Segments (module lm_match): at every SPAN-th place, chosen by its context's hash, one decision says whether the text
  goes on as that context went on most often elsewhere in training; if it does, the words up to the next place are written
  by that decision. These contexts cross words: the four and the twelve words before, and how the last decisions went.
* Words: else a word is written as its bytes and a blank, the end as one line feed, each byte as the decisions of a prefix
  code. Contexts are the bytes before within the word (orders 1 to 4 and the whole prefix) and the decisions so far.

The probabilities of all texts sum to at most one. Training texts are scored by the counts without the token or
segment at hand, as an online model scores a text before it learns from it; held-out texts by all counts. So a word
has two constants, and training works on counts, scoring on distinct words:

1. Distinct words are counted over all training documents; the prefix code is of the bytes of these counts.
2. Words are sorted and packed in groups of about BLOCK bytes. A group adds up its own decisions by context (a 64-bit
   hash, no table of fixed size). Whole prefixes stay in their group but for those of its first and last word; other
   contexts are dealt to buckets, whose number grows with the words, added up there, and sent back to each group.
   Added up exactly, a context's counts are then kept in eighths of a power of two (exact while small).
3. Mixing weights, gated by how often the two longest contexts were seen, and the map are learnt online: each group
   learns from all its decisions, in a mixed order and each token taken out of its own counts; groups are averaged by tokens.
4. Every distinct word gets its scores once. Documents take scores and counts of frequent words from a broadcast
   table of bounded size; their rarer words are joined with the table of words by hash.

Null, empty and blank texts are the end alone. Words beyond RUN bytes are written in runs with contexts of their
own. Without training documents N and V are 0 and all predictors are even. Repeated rows each get their row and
count each; other columns are ignored, whatever their names. A null id counts as an empty text for the fold.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lm_match
from .common import cut

END = b"\n"
#: Bytes before that the predictors within words see (None: the whole prefix).
CONTEXTS = (1, 2, 3, 4, None)
RUN = 4096
#: Bytes of words in a group, and of texts that are scored together.
BLOCK, TEXTS = 1 << 17, 4 << 20
#: The counts of so many words at most are broadcast.
TOP_WORDS = 1_000_000
#: Words that a counting task holds before it sends them on.
COUNTED = 400_000
EVEN = 0.4
LEVELS = 4
STEPS = 33
#: Distinct words for each bucket of contexts, and decisions that a group learns from at a time.
BUCKET_WORDS, BATCH = 20_000, 8192
_K = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(RUN + 1)], np.uint64)


def tokens(data: bytes | None) -> list[bytes]:
    return [*(data or b"").lower().split(), END]


class Code:
    """A prefix code for bytes: at depth d, a byte's node and the decision taken there."""

    def __init__(self, texts: list[bytes], seen: np.ndarray | None = None):
        """seen: how often each byte occurs, by default in texts."""
        seen = (np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256) if seen is None else seen) * 16 + 1
        heap = [(int(n), i, (i,)) for i, n in enumerate(seen)]
        heapq.heapify(heap)
        steps: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            (n0, i, left), (n1, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, left), (1, right)):
                for x in side:
                    steps[x].append((node, bit))
            heapq.heappush(heap, (n0 + n1, i, left + right))
        self.length = np.array([len(x) for x in steps])
        self.node, self.bit = np.zeros((2, self.length.max(), 256), np.int64)
        for x, path in enumerate(steps):
            for d, (node, bit) in enumerate(reversed(path)):
                self.node[d, x], self.bit[d, x] = node, bit

    def decisions(self, data: np.ndarray):
        """(rows, node, bit) at each depth, for the bytes that go as deep."""
        rows, d = np.arange(len(data)), 0
        while len(rows):
            yield rows, self.node[d][data[rows]], self.bit[d][data[rows]]
            d += 1
            rows = rows[self.length[data[rows]] > d]


class Bytes:
    """The distinct (prefix, next byte) of some words: contexts of each, and where the words use them."""

    def __init__(self, words: list[bytes]):
        parts = [w + b" " if w != END else w for w in words]
        of = np.arange(len(parts))
        if any(len(p) > RUN for p in parts):
            split = [[p[i : i + RUN] for i in range(0, len(p), RUN)] for p in parts]
            of, parts = np.repeat(of, [len(x) for x in split]), [p for x in split for p in x]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.cumsum(lengths) - lengths
        self.word = np.repeat(of, lengths)
        at = np.arange(len(data)) - np.repeat(starts, lengths)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[at]
        after = np.cumsum(terms, dtype=np.uint64)
        before = after - terms
        base = np.repeat(before[starts], lengths)
        later = np.repeat(np.r_[False, of[1:] == of[:-1]], lengths)  # runs after a word's first
        base = base - later.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        self.use, unique = pd.factorize(after - base + at.astype(np.uint64) * _K)
        first = np.empty(len(unique), np.int64)
        first[self.use[::-1]] = np.arange(len(data))[::-1]
        self.data = data[first]
        prefix, place = (before - base)[first], at[first]
        #: Whether a whole prefix may also occur in other groups of the sorted words.
        self.shared = np.isin(prefix, (before - base)[later | (self.word == 0) | (self.word == len(words) - 1)])
        self.hashes, key = [], np.zeros(len(first), np.uint64)
        for k in CONTEXTS:
            if k is None:
                h = prefix + place.astype(np.uint64) ^ _K
            else:
                last = data[np.maximum(first - k, 0)].astype(np.uint64) + np.uint64(1)
                last[place < k] = 0
                key = key | last << np.uint64(9 * (k - 1))
                h = key + np.uint64(k)
            h = h * _K
            self.hashes.append(h ^ (h >> np.uint64(29)))

    def keys(self, rows: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        """For each context the hashes of the decisions at node."""
        salt = (node + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return [(h[rows] ^ salt) * _K for h in self.hashes]


#: Counts are kept as a byte each, in eighths of a power of two: exact while small, close when large.
_CODES = np.round(2.0 ** (np.arange(256) / 8) - 1)
_N0, _N1 = np.repeat(_CODES, 256), np.tile(_CODES, 256)


def compact(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts of each slot as one 16-bit number."""
    code = lambda n: np.minimum(np.round(8 * np.log2(n.astype(np.float64) + 1)), 255).astype(np.uint16)
    return code(n0) << np.uint16(8) | code(n1)


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen: never, once, a few times, often."""
    return ((n >= 0.5).astype(np.uint8) + (n >= 1.5) + (n >= 5.5)).astype(np.uint8)


class Mixer:
    """Gated weights over stretched predictions, then an adaptive probability map for each node."""

    def __init__(self, inputs: int = len(CONTEXTS), gates: int = LEVELS * LEVELS, nodes: int = 255):
        self.weights = np.full((gates, inputs), 1.5 / inputs)
        self.squares = np.full((gates, inputs), 1e-3)
        self.learnt = np.zeros(gates)
        self.hits = np.tile(_squash((np.arange(STEPS) - STEPS // 2) * 0.5) * 24, (nodes, 1))
        self.seen = np.full((nodes, STEPS), 24.0)

    @staticmethod
    def place(x: np.ndarray):
        at = np.clip(x * 2 + STEPS // 2, 0, STEPS - 1.001)
        low = at.astype(np.int64)
        return low, at - low

    def mixed(self, xs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        total = xs[0] * self.weights[:, 0][gate]
        for i, x in enumerate(xs[1:], 1):
            total += x * self.weights[:, i][gate]
        return np.clip(total, -14, 14)

    def refined(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        low, part = self.place(x)
        t, at = (self.hits / self.seen).reshape(-1), node * STEPS + low
        p = t[at] * (1 - part) + t[at + 1] * part
        return np.clip((p + _squash(x)) / 2, 1e-6, 1 - 1e-6)

    def learn(self, xs: list[np.ndarray], gate: np.ndarray, node: np.ndarray, bit: np.ndarray, times: np.ndarray, note: bool = True) -> None:
        """One batch: gradient of the coding cost, steps scaled by each weight's past gradients; then the map."""
        x, gates = self.mixed(xs, gate), len(self.weights)
        error = (bit - _squash(x)) * times
        seen = np.bincount(gate, times, gates)
        grad = np.stack([np.bincount(gate, v * error, gates) for v in xs], axis=1) / np.maximum(seen, 1)[:, None]
        self.squares += grad * grad
        self.weights += 0.05 * grad / np.sqrt(self.squares)
        self.learnt += seen
        if note:
            low, part = self.place(x)
            at, share = np.concatenate([node * STEPS + low, node * STEPS + low + 1]), np.concatenate([(1 - part) * times, part * times])
            self.hits += np.bincount(at, share * np.tile(bit, 2), self.hits.size).reshape(self.hits.shape)
            self.seen += np.bincount(at, share, self.seen.size).reshape(self.seen.shape)

    def sums(self) -> np.ndarray:
        """What merged() adds up: weights by tokens, tokens, and what the map has learnt."""
        fresh = Mixer(self.weights.shape[1], len(self.weights), len(self.hits))
        parts = (self.weights * self.learnt[:, None], self.learnt, self.hits - fresh.hits, self.seen - fresh.seen)
        return np.concatenate([x.ravel() for x in parts])

    def merged(self, sums: np.ndarray) -> Mixer:
        """A fresh mixer's shape filled with the sums of several that learnt apart."""
        gates, inputs = self.weights.shape
        cuts = np.cumsum([gates * inputs, gates, self.hits.size])
        weights, learnt, hits, seen = np.split(sums, cuts)
        known = learnt > 0
        self.weights[known] = weights.reshape(gates, inputs)[known] / learnt[known, None]
        self.learnt, self.hits, self.seen = learnt, self.hits + hits.reshape(self.hits.shape), self.seen + seen.reshape(self.seen.shape)
        return self


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often each byte is written for all training tokens of words."""

    def run(batches):
        seen = np.zeros(256)
        for batch in batches:
            parts, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            seen += np.bincount(np.frombuffer(b"".join(parts), np.uint8), np.repeat(c, lengths), 256)
            seen[ord(" ")] += sum(n for n, w in zip(c, parts) if w != END)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()])], ["seen"])

    found = words.filter("c > 0").select("word", "c").mapInArrow(run, "seen binary").collect()
    return sum((np.frombuffer(r[0], np.float64) for r in found), np.zeros(256))


class Tokens:
    """The tokens of some texts: their numbers in `words` (distinct, the end last), one text after another, and where texts begin."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
        if b"" in distinct:  # before and behind a text's outer blanks
            blank = codes == distinct.index(b"")
            ends = ends - np.r_[0, np.cumsum(blank)][ends]
            codes = codes[~blank]
        self.words = [*distinct, END]
        self.codes = np.insert(codes.astype(np.int64), ends, len(distinct))
        self.ends = ends + np.arange(1, len(texts) + 1)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64)
        self.lengths = self.ends - self.starts


def text_blocks(batch: pa.RecordBatch):
    """Parts of a batch whose column text has about TEXTS bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(size, (size[first - 1] if first else 0) + TEXTS)) + 1
        yield batch.slice(first, min(last, len(batch)) - first)
        first = last


def read(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From one reading of the texts of (id, text, train): words and segments.

    word (binary), c: all words; c counts those of rows with train. key, train, a, b, s: arrays of a row's segments.
    """
    schema = "word binary, c long, key binary, train boolean, a array<long>, b array<long>, s array<long>"
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.bool_(), *[pa.list_(pa.int64())] * 3]
    names = ["word", "c", "key", "train", "a", "b", "s"]

    def run(batches):
        def send():
            rows = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(rows + [pa.nulls(len(seen), k) for k in kinds[2:]], names)

        seen: dict[bytes, int] = {}
        for batch in batches:
            for part in text_blocks(batch):
                found, train = Tokens(part.column("text")), part.column("train").to_numpy(zero_copy_only=False)
                times = np.bincount(found.codes, np.repeat(train, found.lengths), len(found.words)).astype(np.int64)
                there = np.bincount(found.codes, minlength=len(found.words)) > 0
                for word, n, known in zip(found.words, times.tolist(), there.tolist()):
                    if known:
                        seen[word] = seen.get(word, 0) + n
                if len(seen) >= COUNTED:
                    yield send()
                    seen = {}
                begins, *columns = lm_match.segments(keys_of(found.words).view(np.uint64)[found.codes], found.starts)
                cuts = pa.array(np.searchsorted(begins, np.r_[found.starts, len(found.codes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(c.view(np.int64))) for c in columns]
                blank = [pa.nulls(len(part), k) for k in kinds[:2]]
                yield pa.RecordBatch.from_arrays([*blank, lm_match.keys_of(part), part.column("train"), *lists], names)
        yield send()

    rows = cut(docs.mapInArrow(run, schema))
    words = rows.filter("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c"))
    return words, rows.filter("key IS NOT NULL").select("key", "train", "a", "b", "s")


def _pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _unpack(data, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(bytes(data)), kind)


def _rows(batch, *names: str):
    """Rows of a batch, one by one: their bytes are large."""
    for i in range(len(batch)):
        yield [batch.column(n)[i].as_py() for n in names]


def groups_of(counts: DataFrame, n_words: int, size: int = BLOCK) -> DataFrame:
    """id, words, times: sorted words in groups of about size bytes."""

    def pack(batches):
        first, made = TaskContext.get().partitionId() << 32, 0

        def group():
            row = [first + made], [_pack(b" ".join(words))], [_pack(np.array(times, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))], ["id", "words", "times"])

        words, times, held = [], [], 0
        for batch in batches:
            for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if words and held >= size:
                    yield group()
                    words, times, held, made = [], [], 0, made + 1
                words.append(w)
                times.append(c)
                held += len(w) + 1
        if words:
            yield group()

    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_words // 100_000)
    ordered = counts.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return cut(ordered.mapInArrow(pack, "id long, words binary, times binary"))


class Group:
    """A group's decisions: the unique (prefix, byte) of each, node, bit, tokens, and the places of their contexts' counts."""

    def __init__(self, words, times, code: Code):
        self.words = zstandard.decompress(bytes(words)).split(b" ")
        self.times = _unpack(times, np.int64)
        self.own = Bytes(self.words)
        weight = np.bincount(self.own.use, self.times.astype(np.float64)[self.own.word], len(self.own.data))
        self.rows, self.node, self.bit = (np.concatenate(x) for x in zip(*code.decisions(self.own.data)))
        self.weight = weight[self.rows]

    def contexts(self) -> None:
        """keys: sorted hashes of contexts that other groups may have; counts of them, then of the group's own."""
        *short, whole = self.own.keys(self.rows, self.node)
        salted = [k ^ np.uint64((i + 1) * 0x9FB21C651E98DF25 % (1 << 64)) for i, k in enumerate((*short, whole))]
        shared = self.own.shared[self.rows]
        found = [pd.factorize(k)[::-1] for k in (*salted[:-1], salted[-1][shared], salted[-1][~shared])]
        keys = np.concatenate([k for k, _ in found[:-1]])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, starts = keys[order], np.cumsum([0, *(len(k) for k, _ in found)])
        self.at = [rank[starts[i] + inverse] for i, (_, inverse) in enumerate(found[:-2])]
        last = np.empty(len(self.rows), np.int64)
        last[shared], last[~shared] = rank[starts[-3] + found[-2][1]], starts[-2] + found[-1][1]
        self.at.append(last)
        self.n = np.zeros((2, int(starts[-1])))
        for at in self.at:
            for bit in (0, 1):
                self.n[bit] += np.bincount(at, self.weight * (self.bit == bit), self.n.shape[1])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def counted(groups: DataFrame, code: Code, n_words: int) -> DataFrame:
    """groups with codes: compact counts over all groups, for each decision of a group a row of as many as CONTEXTS.

    A row without words is what a group's mixer has learnt (sums) from the group's decisions.
    """
    buckets = max(1, -(-n_words // BUCKET_WORDS))

    def gather(batches):
        for batch in batches:
            for at, words, times in _rows(batch, "id", "words", "times"):
                group = Group(words, times, code)
                group.contexts()
                cuts = np.searchsorted(bucket_of(group.keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
                full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                parts = [slice(cuts[b], cuts[b + 1]) for b in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([at] * len(full), pa.int64()), pa.array([_pack(group.keys[p]) for p in parts], pa.binary()),
                     pa.array([_pack(np.ascontiguousarray(group.n[:, p])) for p in parts], pa.binary())],
                    ["bucket", "id", "keys", "n"],
                )

    def add(batch):
        keys = [_unpack(k, np.uint64) for k in batch["keys"]]
        n = np.concatenate([_unpack(x, np.float64).reshape(2, -1) for x in batch["n"]], axis=1)
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        codes = np.split(compact(*(np.bincount(inverse, x, len(unique)) for x in n))[inverse], np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"id": batch["id"], "bucket": batch["bucket"], "codes": [_pack(c) for c in codes]})

    def solve(batches):
        names, types = ["id", "words", "times", "codes", "sums"], [pa.int64(), *[pa.binary()] * 4]
        learnt = 0
        for batch in batches:
            for at, words, times, parts in _rows(batch, "id", "words", "times", "parts"):
                group = Group(words, times, code)
                group.contexts()
                found = compact(*group.n)
                found[: len(group.keys)] = np.concatenate([_unpack(p["codes"], np.uint16) for p in sorted(parts, key=lambda p: p["bucket"])])
                codes = np.stack([found[at] for at in group.at])
                learnt = learnt + learn(group, codes).sums()
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((at, words, times, _pack(codes), None), types)], names)
        if not np.isscalar(learnt):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, learnt.tobytes()), types)], names)

    sums = groups.mapInArrow(gather, "bucket long, id long, keys binary, n binary").groupBy("bucket").applyInPandas(add, "id long, bucket long, codes binary")
    back = sums.groupBy("id").agg(F.collect_list(F.struct("bucket", "codes")).alias("parts"))
    joined = groups.join(back, "id").select("id", "words", "times", "parts")
    return cut(joined.mapInArrow(solve, "id long, words binary, times binary, codes binary, sums binary"))


#: Of each pair of counts: stretched prediction and level; without an occurrence of 0, without one of 1, and with all.
_PAIRS = [(np.maximum(_N0 - a, 0), np.maximum(_N1 - b, 0)) for a, b in ((1, 0), (0, 1), (0, 0))]
_X = np.stack([_stretch((n1 + EVEN) / (n0 + n1 + 2 * EVEN)).astype(np.float32) for n0, n1 in _PAIRS])
_LEVELS = np.stack([_level(n0 + n1) for n0, n1 in _PAIRS])


def predictions(codes: np.ndarray, left: np.ndarray | int):
    """Stretched predictions and gate; left says which occurrence is left out (2: none)."""
    xs = [_X[left, c] for c in codes]
    return xs, _LEVELS[left, codes[-1]].astype(np.int64) * LEVELS + _LEVELS[left, codes[-2]]


def learn(group: Group, codes: np.ndarray) -> Mixer:
    """A mixer that has learnt all training decisions of a group, each out of its own counts, in a mixed order."""
    mixer = Mixer()
    there = np.flatnonzero(group.weight)
    there = there[np.argsort(there.astype(np.uint64) * _K, kind="stable")]
    for i in range(0, len(there), BATCH):
        part = there[i : i + BATCH]
        bit = group.bit[part]
        mixer.learn(*predictions(codes[:, part], bit), group.node[part], bit, group.weight[part])
    return mixer


def mixer_of(words: DataFrame) -> Mixer:
    """The groups' mixers, averaged by tokens."""
    rows = words.filter("words IS NULL").select("sums").collect()  # one for each task
    return Mixer().merged(sum(np.frombuffer(r[0], np.float64) for r in rows)) if rows else Mixer()


def word_scores(words: DataFrame, code: Code, mixer) -> DataFrame:
    """k, c, score, own: a word's hash, its training count, and its log10 probability by all counts and without one occurrence; mixer is broadcast."""

    def run(batches):
        def total(group, xs, gate):
            p = mixer.value.refined(mixer.value.mixed(xs, gate), group.node)
            cost = np.bincount(group.rows, np.log10(np.where(group.bit == 1, p, 1 - p)), len(group.own.data))
            return np.bincount(group.own.word, cost[group.own.use], len(group.words))

        for batch in batches:
            for w, t, codes in _rows(batch, "words", "times", "codes"):
                group, codes = Group(w, t, code), _unpack(codes, np.uint16).reshape(len(CONTEXTS), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys_of(group.words)), pa.array(group.times), pa.array(total(group, *predictions(codes, 2))), pa.array(total(group, *predictions(codes, group.bit)))],
                    ["k", "c", "score", "own"],
                )

    return words.filter("words IS NOT NULL").mapInArrow(run, "k long, c long, score double, own double")


def keys_of(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _columns(rows: DataFrame) -> list[np.ndarray]:
    """k, c, score and own of a table of bounded size as arrays sorted by k; they reach the driver as packed bytes, not as rows."""
    kinds = {"k": np.int64, "c": np.int64, "score": np.float64, "own": np.float64}

    def pack(batches):
        for batch in batches:
            parts = [pa.array([batch.column(n).to_numpy().astype(t).tobytes()], pa.binary()) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(parts, list(kinds))

    found = rows.select(*kinds).mapInArrow(pack, "k binary, c binary, score binary, own binary").collect()
    columns = [np.frombuffer(b"".join(r[i] for r in found), t) for i, t in enumerate(kinds.values())]
    order = columns[0].argsort()
    return [x[order] for x in columns]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP_WORDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    counts, places = read(docs.select("id", "text", (~F.col("held_out")).alias("train")))
    counts = cut(counts)
    code = Code([], byte_counts(counts))
    n, v, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()
    words = counted(groups_of(counts, n_words), code, n_words)
    lexicon = cut(word_scores(words, code, spark.sparkContext.broadcast(mixer_of(words))))
    rank = F.floor(F.log2(F.col("c") + 1) * 8)
    held, cutoff = 0, 1 << 20  # the lowest rank from which on words fit the broadcast table
    for r, found in sorted(lexicon.groupBy(rank.alias("r")).count().collect(), reverse=True):  # a few hundred ranks at most
        held += found
        if held > top:
            break
        cutoff = r
    shared = spark.sparkContext.broadcast(_columns(lexicon.filter(rank >= cutoff)))
    below = n + 0.5 * (v + 1)
    kind = docs.schema["id"].dataType.simpleString()
    runs = lm_match.decisions(places)

    def score(batches):
        hashes, counts, *scores = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_blocks(batch):
                found = Tokens(part.column("text"))
                h = keys_of(found.words)
                at = np.minimum(hashes.searchsorted(h), max(len(hashes) - 1, 0))
                there = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                c = np.where(there, counts[at] if len(hashes) else 0, -1)
                by_fold = [np.where(there, x[at] if len(hashes) else 0.0, 0.0) for x in scores]
                base = np.where(there, np.log10((np.maximum(c, 0) + 0.5) / below), 0.0)
                codes, held = found.codes, part.column("held_out").to_numpy(zero_copy_only=False)
                each = np.where(np.repeat(held, found.lengths), by_fold[0][codes], by_fold[1][codes])
                begins = lm_match.segments(h.view(np.uint64)[codes], found.starts)[0]
                rare = np.flatnonzero(~there[codes])
                total = lambda x: np.add.reduceat(x, found.starts)
                of_text = lambda x: np.searchsorted(x, np.r_[found.starts, len(codes)])
                first_segment = of_text(begins)
                rare_at = np.searchsorted(begins, rare, "right") - np.repeat(first_segment[:-1], np.diff(of_text(rare)))
                lists = lambda x, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))
                columns = {
                    "id": part.column("id"), "held_out": part.column("held_out"),
                    "row": pa.array(np.arange(row, row + len(part))), "key": lm_match.keys_of(part),
                    "size": pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()),
                    "n_tokens": pa.array(found.lengths), "n_top": pa.array(total((c > 0).astype(np.int64)[codes])),
                    "base_top": pa.array(total(base[codes])), "score_top": pa.array(total(each)),
                    "segments": lists(lm_match.sums(each, begins, found.starts), first_segment),
                    "rare": lists(h[codes[rare]], of_text(rare)), "rare_at": lists(rare_at.astype(np.int32), of_text(rare)),
                }
                row += len(part)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    first = docs.mapInArrow(
        score,
        f"id {kind}, held_out boolean, row long, key binary, size long, n_tokens long, n_top long, base_top double, score_top double,"
        " segments array<double>, rare array<long>, rare_at array<int>",
    )
    # a segment that its decision has written is not written word by word
    hits = F.coalesce("hits", F.array().cast("array<int>"))
    written = F.aggregate(hits, F.lit(0.0), lambda a, i: a + F.element_at("segments", i))
    kept = cut(
        cut(first).join(runs, "key", "left").select(
            "id", "held_out", "row", "size", "n_tokens", "n_top", "base_top", "rare", "rare_at", hits.alias("hits"),
            (F.col("score_top") - written + F.coalesce("run_score", F.lit(0.0))).alias("score_top"),
        )
    )
    each = kept.select("row", "held_out", "hits", F.explode(F.arrays_zip("rare", "rare_at")).alias("x"))
    each = each.select("row", "held_out", F.col("x.rare").alias("k"), F.array_contains("hits", F.col("x.rare_at")).alias("done"))
    joined = each.join(lexicon.filter(rank < cutoff), "k")
    late = joined.groupBy("row").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("n_rare"),
        F.sum(F.log10((F.col("c") + 0.5) / F.lit(below))).alias("base_rare"),
        F.sum(F.when(F.col("done"), 0.0).when(F.col("held_out"), F.col("score")).otherwise(F.col("own"))).alias("score_rare"),
    )
    score_all = F.col("score_top") + F.coalesce("score_rare", F.lit(0.0))
    return kept.drop("rare", "rare_at", "hits").join(late, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), score_all.alias("score"),
        (-score_all / math.log10(2) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
