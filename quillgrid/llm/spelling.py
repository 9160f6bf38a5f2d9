"""Words one letter apart, found with a trie over letter-group counts, and the common form that each rare one stands for.

A word is a vector: how many of its letters fall into each group (code point modulo ``GROUPS``). One inserted, deleted or
replaced letter adds at most one to one group and takes at most one from another. A trie arranges words by these counts,
group after group; a search goes down it with a budget of one letter more and one letter less than its word has, and
what a leaf holds is compared letter by letter.

The top of the trie is spread over tasks: the length and the counts of the first ``TOP`` groups say which subtrie a word
stands in, and a search is sent to every subtrie that its budget reaches. Of two words only one looks for the other, so
each pair is found once. A subtrie of more than ``BLOCK`` words is cut into blocks, and searches visit all of them. Inside a
task the search runs depth first over runs of words at a time; what it holds is bounded by a run and the depth.

Null texts have no words. Rows are counted as they come, repeated ones each time; a null key counts as empty text. An empty table gives no
words. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.encoding import windows
from quillgrid.llm.textbatch import slices
from quillgrid.session import stored

GROUPS = 32
#: Groups from the top of the trie down: those of common letters first, as they separate most words.
LEVELS = [*dict.fromkeys([*(ord(c) % GROUPS for c in "etaoinshrdlcumwfgypbvkjxqz"), *range(GROUPS)])]
TOP = 4
BLOCK = 1 << 13
#: A node of so few words is a leaf.
_LEAF = 4
_RUN = 1 << 16
#: Distinct words a task counts before it hands them on.
_HELD = 1 << 19
#: Words up to this length are compared side by side, longer ones one by one.
_WIDE = 63

_WORD = re.compile("[A-Za-zÀ-ÿ]+")
_BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 1, min_count: int = 1, damage: int | None = None) -> DataFrame:
    """``word`` and ``n``: runs of Latin letters with A-Z in lower case, and how often each occurs.

    ``damage`` makes misspellings to look for: where it divides h, the crc32 of key, colon and run, the run loses its
    letter h modulo its length. The counts of a task are combined before they are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")

    def run(batches):
        counts: Counter = Counter()
        for part in slices(batches, "text"):
            for name, whole in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                start = zlib.crc32(f"{name}:".encode())
                # Bytes know no case but that of ASCII.
                for piece in windows(whole.encode().lower().decode(), _BETWEEN):
                    for word, n in Counter(_WORD.findall(piece)).items():
                        if damage and (h := zlib.crc32(word.encode(), start)) % damage == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= min_length:
                            counts[word] += n
            if len(counts) >= _HELD:
                yield _counted(counts)
                counts.clear()
        yield _counted(counts)

    return rows.mapInArrow(run, "word string, n bigint").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in sequence (all below 256), and the length of each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.array([len(w) for w in words], np.int64)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of each word's letters by group, in the order of the trie's levels."""
    letters, size = _letters(words)
    row = np.repeat(np.arange(len(words)), size)
    counts = np.bincount(row * GROUPS + (letters & (GROUPS - 1)), minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return counts[:, LEVELS]


#: What a letter adds to the number of a subtrie, by length and by top group: no word is so long that the sum leaves 64 bits.
#: Two subtries that share a number only cost time.
_STEP = np.random.default_rng(17).integers(1, 2**30, TOP + 1, dtype=np.int64)

#: What a search adds to its own subtrie's number, with the letters more and less that it may still find below the top:
#: words of its length, of which those with more of an earlier top group are looked for, and words one letter longer.
REACH = [(0, 1, 1)]
REACH += [(int(_STEP[i]), 0, 1) for i in range(1, TOP + 1)]
REACH += [(int(_STEP[i]) - int(_STEP[j]), 0, 0) for i in range(1, TOP + 1) for j in range(i + 1, TOP + 1)]
REACH += [(int(_STEP[0]), 1, 0)]
REACH += [(int(_STEP[0]) + int(_STEP[i]), 0, 0) for i in range(1, TOP + 1)]


def _subtries(words: list[str]) -> np.ndarray:
    size = np.array([len(w) for w in words], np.int64)
    top = vectors(words)[:, :TOP]
    return size * _STEP[0] + (top * _STEP[1:]).sum(1)


class Trie:
    """Words by subtrie and then by the counts below the top, level after level; nodes of few words end a path."""

    def __init__(self, roots: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((*counts.T[::-1], roots))
        roots, counts = roots[self.order], counts[self.order]
        self.rows, self.width = len(roots), int(counts.max(initial=0)) + 2
        #: By level: the sorted keys of its nodes, and the first word of each.
        self.keys, self.first = [], []
        new = np.ones(self.rows, bool)
        new[1:] = roots[1:] != roots[:-1]
        key = roots
        for level in range(counts.shape[1] + 1):
            at = np.flatnonzero(new)
            self.keys.append(key[at])
            self.first.append(np.append(at, self.rows))
            if level == counts.shape[1] or not (np.diff(self.first[-1]) > _LEAF).any():
                break
            key = (np.cumsum(new) - 1) * self.width + counts[:, level]
            new = new.copy()
            new[1:] |= counts[1:, level] != counts[:-1, level]

    def _node(self, level: int, key: np.ndarray) -> np.ndarray:
        """The node of each key, or -1."""
        keys = self.keys[level]
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def search(self, roots: np.ndarray, counts: np.ndarray, more: np.ndarray, less: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a search and a word whose counts lie within the search's budget (or share a leaf with such)."""
        node = self._node(0, roots)
        hit = np.flatnonzero(node >= 0)
        todo = [(0, hit, node[hit], more[hit], less[hit])]
        while todo:
            level, q, node, more, less = todo.pop()
            if len(q) > _RUN:
                todo += [(level, q[a : a + _RUN], node[a : a + _RUN], more[a : a + _RUN], less[a : a + _RUN]) for a in range(0, len(q), _RUN)]
                continue
            start, size = self.first[level][node], np.diff(self.first[level])[node]
            leaf = (size <= _LEAF) | (level + 1 == len(self.keys))
            at = np.flatnonzero(leaf)
            while len(at):
                n = max(1, int(np.searchsorted(np.cumsum(size[at]), 4 * _RUN)))
                some, at = at[:n], at[n:]
                end = np.cumsum(size[some])
                word = np.repeat(start[some] - (end - size[some]), size[some]) + np.arange(int(end[-1]))
                yield np.repeat(q[some], size[some]), self.order[word]
            go = np.flatnonzero(~leaf)
            if len(go):
                q, node, more, less = q[go], node[go], more[go], less[go]
                has = counts[q, level]
                found = []
                for step, may in ((0, None), (1, more > 0), (-1, (less > 0) & (has > 0))):
                    w = np.arange(len(q)) if may is None else np.flatnonzero(may)
                    child = self._node(level + 1, np.where(has[w] + step < self.width, node[w] * self.width + has[w] + step, -1))
                    ok = child >= 0
                    w = w[ok]
                    found.append((q[w], child[ok], more[w] - (step > 0), less[w] - (step < 0)))
                todo.append((level + 1, *map(np.concatenate, zip(*found))))


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Words:
    """Words side by side, each in a row of ``width`` code points with zeros behind it."""

    def __init__(self, words: list[str]):
        self.words = np.array(words, object)
        letters, self.size = _letters(words)
        self.letters = np.zeros((len(words), _WIDE + 1), np.uint8)
        end = np.cumsum(self.size)
        place = np.arange(len(letters)) - np.repeat(end - self.size, self.size)
        row = np.repeat(np.arange(len(words)), self.size)
        short = place <= _WIDE
        self.letters[row[short], place[short]] = letters[short]


def _verified(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs are near; words of b are as long as those of a, or longer by one."""
    grown = b.size[j] - a.size[i]
    good = (grown == 0) | (grown == 1)
    width = int(min(_WIDE, max(a.size[i].max(initial=0), b.size[j].max(initial=0)))) + 1
    x, y = a.letters[i, :width], b.letters[j, :width]
    differs = x != y
    same = (grown == 0) & (differs.sum(1) == 1)
    at = differs.argmax(1)
    behind = (x[:, :-1] != y[:, 1:]) & (np.arange(width - 1) >= at[:, None])
    good &= same | ((grown == 1) & ~behind.any(1))
    for k in np.flatnonzero((a.size[i] > _WIDE) | (b.size[j] > _WIDE)):
        good[k] = near(a.words[i[k]], b.words[j[k]])
    return good


def near_words(words: DataFrame) -> DataFrame:
    """Every pair of near words in both orders: ``word``, ``near`` and ``near_n``. ``words`` has distinct words and reads the same each time."""
    spark = words.sparkSession

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("word", "n")], pa.array(_subtries(batch.column("word").to_pylist()))], ["word", "n", "subtrie"])

    held = stored(words.select("word", "n").mapInArrow(place, "word string, n bigint, subtrie bigint"))
    # One row for every BLOCK words at most.
    large = held.groupBy("subtrie").count().where(F.col("count") > BLOCK).select("subtrie", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    nothing = F.lit(None).cast("int")
    residents = held.join(large, "subtrie", "left").select("subtrie", block.alias("block"), "word", "n", nothing.alias("more"), nothing.alias("less"))
    reach = F.array(*[F.struct(F.lit(step).cast("long").alias("step"), F.lit(more).alias("more"), F.lit(less).alias("less")) for step, more, less in REACH])
    sent = held.select(F.col("subtrie").alias("own"), "word", "n", F.explode(reach).alias("to"))
    sent = sent.select((F.col("own") + F.col("to.step")).alias("subtrie"), "word", "n", "to.more", "to.less").join(large, "subtrie", "left")
    sent = sent.select("subtrie", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "word", "n", "more", "less")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held.count() >> 16)
    met = residents.unionByName(sent).repartition(tasks, "subtrie", "block").sortWithinPartitions(F.col("more").isNotNull())
    return met.mapInArrow(_links, "word string, near string, near_n bigint")


def _links(batches) -> Iterator[pa.RecordBatch]:
    """Searches of a task against the words that stand in it; the words come first."""
    roots, words, count, trie = [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        root = batch.column("subtrie").to_numpy() ^ batch.column("block").to_numpy().astype(np.int64) * np.int64(0x9E3779B97F4A7C1)
        word, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        stands = batch.column("more").null_count
        if stands:
            roots.append(root[:stands])
            words += word[:stands]
            count.append(n[:stands])
        if stands == batch.num_rows or not words:
            continue
        if trie is None:
            trie, table, count = Trie(np.concatenate(roots), vectors(words)[:, TOP:]), _Words(words), np.concatenate(count)
        word, n, root = word[stands:], n[stands:], root[stands:]
        more, less = (batch.column(c).slice(stands).to_numpy().astype(np.int8) for c in ("more", "less"))
        asked = _Words(word)
        for q, r in trie.search(root, vectors(word)[:, TOP:], more, less):
            ok = _verified(asked, q, table, r)
            # Words of one subtrie look for each other: the earlier one has found the later.
            q, r = q[ok], r[ok]
            own = (more[q] == 1) & (less[q] == 1)
            once = ~own | (asked.words[q] < table.words[r])
            q, r = q[once], r[once]
            a, b = asked.words[q], table.words[r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, b]), pa.string()), pa.array(np.concatenate([b, a]), pa.string()), pa.array(np.concatenate([count[r], n[q]]))],
                ["word", "near", "near_n"],
            )


def forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Every word with its number of near words and its form: the most frequent near word (of equal ones the first by code
    points) if it is at least ``ratio`` times as frequent; ``root`` follows forms to the last one.

    Columns ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``. A form is more frequent than its word by the ratio,
    so the way to a root is as long as a logarithm, and half as long after every round.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    found = stored(found)
    way = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = stored(way.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if way.where("moved").isEmpty():
            break
        way = way.drop("moved")
    return found.join(way.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
