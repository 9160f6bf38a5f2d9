"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry resolves to its id with
one probe and one comparison, for all new pre-tokens of a slice at once. Tier two takes the misses: their bytes form a
linked list, a heap yields the adjacent pair of lowest rank (leftmost first), and each merge pushes the two pairs it
makes. Results are remembered per worker in two memos, each emptied when it reaches ``MEMO`` entries; what is longer than
``SHORT`` characters is not remembered, so that text without spaces takes no memory.

Texts are cut at single spaces between two characters that no definition takes for white space; there a pre-token always
begins, so whole stretches such as `` word,`` are remembered. Ids equal those of encoding each pattern match on its own.

Null texts count as empty: no ids, and the digest of nothing. Repeated rows encode alike; ties of rank cannot occur, as
ranks are distinct, and equal pairs merge from the left. The vocabulary is a file of base64 tokens and ranks, read on
the driver and broadcast: its size does not grow with the data.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillgrid.llm.encoding import SHORT, worker_memory
from quillgrid.llm.textbatch import Words, add_columns, mix

MEMO = 600_000
#: A space with two neighbours that are no white space, control or format character by any definition.
_SAFE_SPACE = re.compile(r"(?<=[!-~¡-¬®-ᙿ]) (?=[!-~¡-¬®-ᙿ])")
_UNSAFE_SPACE = re.compile(r"(?:^|[^!-~¡-¬®-ᙿ]) | (?:[^!-~¡-¬®-ᙿ]|$)")
_ALL = np.ones(256, bool)

FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order; the ranks of the file must run from 0 without gaps."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def hash_tokens(tokens: list[bytes]) -> np.ndarray:
    off = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=off[1:])
    return Words(np.frombuffer(b"".join(tokens), np.uint8), off, _ALL).hash


@dataclass
class PerfectHash:
    """Hash and displace: every bucket of keys holds the seed that sends its keys to slots of their own; a bucket of one
    key holds a shift to a slot that was left."""

    seed: np.ndarray
    shift: np.ndarray
    id_at: np.ndarray

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """Largest buckets first. Keys must differ in hash."""
        n = len(h)
        buckets = max(1, n // 3)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        seed, shift = np.zeros(buckets, np.uint64), np.zeros(buckets, np.int64)
        id_at, free = np.full(n, -1, np.int64), np.ones(n, bool)
        sizes = np.diff(cut)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1]:
            keys, at = order[cut[b] : cut[b + 1]], 0
            while True:
                seeds = np.arange(at, at + 512, dtype=np.uint64)
                slot = _slots(h[keys][:, None], seeds, n)
                ranked = np.sort(slot, 0)
                good = np.flatnonzero(free[slot].all(0) & (ranked[1:] != ranked[:-1]).all(0))
                if len(good):
                    seed[b] = seeds[good[0]]
                    free[slot[:, good[0]]] = False
                    id_at[slot[:, good[0]]] = keys
                    break
                at += 512
        alone = by_size[sizes[by_size] == 1]
        keys, slot = order[cut[alone]], np.flatnonzero(free)
        shift[alone] = (slot - _slots(h[keys], seed[alone], n)) % n
        id_at[slot] = keys
        return cls(seed, shift, id_at)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The only id each hash can stand for."""
        n, b = len(self.id_at), (h % np.uint64(len(self.seed))).astype(np.int64)
        return self.id_at[(_slots(h, self.seed[b], n) + self.shift[b]) % n]


def _slots(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + seed * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def merge_bytes(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token outside the vocabulary: merges of lowest rank first, over linked bytes and a heap."""
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged into an earlier one
    before = list(range(-1, n))
    get, heap = rank.get, []
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j == n or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            r = get(word[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        p = before[i]
        if p >= 0:
            r = get(word[p:k])
            if r is not None:
                heapq.heappush(heap, (r, p, i, k))
    ids, i = [], 0
    while i < n:
        ids.append(rank[word[i : end[i]]])
        i = end[i]
    return ids


def stretches(text: str) -> list[str]:
    """The text cut before every safe space; each stretch but the first begins with its space."""
    if not text:
        return []
    first, *rest = _SAFE_SPACE.split(text) if _UNSAFE_SPACE.search(text) else text.split(" ")
    return [first, *[" " + x for x in rest]]


def _remember(memo: dict[str, bytes], learnt: dict[str, bytes]) -> Callable[[str], bytes]:
    """Adds what is short to a memo; looks up what is there or was learnt just now."""
    long = {k: v for k, v in learnt.items() if len(k) > SHORT}
    memo.update(learnt if not long else {k: v for k, v in learnt.items() if len(k) <= SHORT})
    if not long:
        return memo.__getitem__
    return lambda k: long[k] if len(k) > SHORT else memo[k]


class Encoder:
    """Encodes texts with a vocabulary; a Python worker makes it once and keeps it with its memos for its next task."""

    @classmethod
    def kept(cls, key: tuple[str, str], shared) -> Encoder:
        """This worker's encoder for a vocabulary and a pattern."""
        made = worker_memory()
        if key not in made:
            made[key] = cls(*shared.value, key[1])
        return made[key]

    def __init__(self, tokens: list[bytes], perfect: PerfectHash, pattern: str):
        self.tokens, self.perfect = tokens, perfect
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of new stretches: the perfect hash first, the heap for what it does not hold."""
        found = list(map(self.find, new))
        if len(self.known) > MEMO:
            self.known = {}
        parts, learnt = list({p for each in found for p in each}.difference(self.known)), {}
        if parts:
            coded = [p.encode() for p in parts]
            for part, word, i in zip(parts, coded, self.perfect.probe(hash_tokens(coded)).tolist()):
                learnt[part] = i.to_bytes(4, "little") if self.tokens[i] == word else b"".join([x.to_bytes(4, "little") for x in merge_bytes(word, self.rank)])
        get = _remember(self.known, learnt)
        return dict(zip(new, [b"".join(map(get, each)) for each in found]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [stretches(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        new = {s for found in cut for s in found}.difference(self.memo)
        get = _remember(self.memo, self.learn(list(new)) if new else {})
        return [b"".join(map(get, found)) for found in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """The frame with a column of ids (binary, little-endian unsigned 32-bit); a column of that name is replaced."""
    return _with(docs, ranks_path, pattern, text, [T.StructField(name, T.BinaryType())], lambda coder, ids, _: [pa.array(ids, pa.binary())])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """The frame with the number of ids, their digest, and the digest of the bytes they decode to."""

    return _with(docs, ranks_path, pattern, text, FIELDS, lambda coder, ids, _: _digests(ids, [coder.decode(x) for x in ids]))


def encode_checked(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """As ``encode``, with the columns of ``round_trip``; fails if any text's ids do not decode to it."""

    def derive(coder, ids, texts):
        back = [coder.decode(x) for x in ids]
        if any(x != t.encode() for x, t in zip(back, texts)):
            raise ValueError("ids do not decode to their text")
        return [pa.array(ids, pa.binary()), *_digests(ids, back)]

    return _with(docs, ranks_path, pattern, text, [T.StructField(name, T.BinaryType()), *FIELDS], derive)


def _digests(ids: list[bytes], back: list[bytes]) -> list[pa.Array]:
    sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(back)]


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The frame with the bytes that a column of ids stands for; null ids decode to nothing."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            found = [b"".join(map(tokens.value.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.binary())], [*names, name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.BinaryType())]))


def _with(docs: DataFrame, ranks_path: str, pattern: str, text: str, fields: list[T.StructField], derive) -> DataFrame:
    tokens = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, PerfectHash.build(hash_tokens(tokens))))
    key = (ranks_path, pattern)

    def compute(data, off):
        coder = Encoder.kept(key, shared)
        low = int(off[0])
        whole = data[low : int(off[-1])].tobytes()
        texts = [whole[a - low : b - low].decode() for a, b in zip(off, off[1:])]
        return derive(coder, coder.encode(texts), texts)

    return add_columns(docs, text, fields, compute)
