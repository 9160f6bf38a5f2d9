"""Benchmark decontamination: joins on rare word pairs find passages that may hold an item, Smith-Waterman alignment scores them.

Words are runs of digits, letters and characters beyond ASCII, ASCII letters lower-cased. The score of a text and an item
is the best local alignment of their words (match 2, mismatch and gap -1) over that of the whole item with itself, so
edits lower it and do not hide it.

How many neighbouring pairs of words an item of n words must share with a passage follows from the score s alone:
an alignment of m matches has at most 2m - 2sn edits and spans at most (3 - 2s)n words, so it holds at least
t = (2s - 1)n - 1 pairs. Of an item's pairs the t/2 most frequent in the corpus may therefore be left aside: at least t/2 of the
rarer ones are in the passage. Those are the seeds. Texts and items meet in a join on them, however many items there are, and a
text goes on with the items of which it holds so many seeds within the span of an alignment. Items of 4 and 5 words may share no
pair if a word stands between any two of theirs; neighbours of such an item are also looked up one word apart. (Below
a ``min_score`` of 0.6 longer items may share none either and are missed if they do not.)

The corpus is read twice: for the places of all pairs that some item holds (a bitmap of fixed size sorts out most others), and for the
texts that hold candidates. No frequency drops a pair that counts: where all pairs of an item are common, the rarest of them seed.

Result: a row per key and item with a score of at least ``MIN_SCORE``. Null and empty texts hold nothing. Items of
fewer than k words are too short to prove anything and never match. Repeated rows give one row; equal items match
each for themselves. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.textbatch import _STEP, ALNUM_LOWER, Words, bitmap_of, in_bitmap, mix, slices, text_of
from quillgrid.session import stored

K = 4
MIN_SCORE = 0.6
#: Cells of a row of alignments that are computed together.
_CELLS = 1 << 16
#: Bits of the bitmap of item pairs: for few items and for very many.
_FEW_BITS, _MANY_BITS = 22, 26


def align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best local alignment of each row of ``a`` with the same row of ``b``; rows are padded with words that match nothing."""
    place = np.arange(b.shape[1] + 1, dtype=np.int32)
    row, best = np.zeros((len(b), b.shape[1] + 1), np.int32), np.zeros(len(b), np.int32)
    for word in a.T:
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(b == word[:, None], np.int32(2), np.int32(-1)), row[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        # A gap along b costs one a word: the best earlier cell, less the distance.
        row = np.maximum.accumulate(new + place, axis=1) - place
        np.maximum(best, row.max(axis=1), out=best)
    return best


def smith_waterman(a: np.ndarray, b: np.ndarray) -> int:
    """Best local alignment of two word sequences."""
    return int(align(np.asarray(a)[None], np.asarray(b)[None])[0])


def _paired(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    return mix(a * _STEP[0] + b * _STEP[1] + np.uint64(apart))


def pairs_of(w: Words, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every two words of a row that stand ``apart``."""
    at = np.flatnonzero(w.row[apart:] == w.row[: max(0, len(w.row) - apart)])
    return _paired(w.hash[at], w.hash[at + apart], apart), at


def must_share(n: np.ndarray, min_score: float) -> np.ndarray:
    """Neighbouring pairs that an alignment of an item of n words holds at least, by its score; may be 0 or less."""
    return n - 1 - np.floor(2 * n * (1 - min_score) + 1e-9).astype(np.int64)


def _items(benchmark: DataFrame, key: str, text: str, k: int) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for s in slices(batches, "text"):
            w = Words(*text_of(s.column("text")), ALNUM_LOWER, lower=True)
            cut = np.searchsorted(w.row, np.arange(s.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((np.int64(part) << 33) + number + np.arange(s.num_rows)),
                    s.column("key"),
                    pa.array([w.hash[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                ],
                ["item", "item_key", "item_words"],
            )
            number += s.num_rows

    plain = benchmark.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["key"].dataType.simpleString()
    return stored(plain.mapInArrow(run, f"item bigint, item_key {kind}, item_words binary").where(F.length("item_words") >= 8 * max(k, 1)))


def _item_pairs(items: DataFrame, min_score: float) -> DataFrame:
    """The distinct pairs of every item: ``item, pair, times``, with what holds for the item: ``aside`` (pairs that may be left
    aside), ``need`` (seeds a passage then holds at least), ``span`` (words they lie within) and ``short`` (looked up apart too)."""

    def run(batches):
        for batch in batches:
            out = []
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("item_words").to_pylist()):
                words = np.frombuffer(raw, np.uint64)
                n = np.array([len(words)])
                share, short = int(must_share(n, min_score)[0]), bool(must_share(n, min_score)[0] < 1)
                share = max(share, 1)
                # Neighbours of the item, as they stand in a text side by side or with a word between them.
                found = np.concatenate([_paired(words[:-1], words[1:], far) for far in ((1, 2) if short else (1,))])
                pair, times = np.unique(found, return_counts=True)
                span = int(np.ceil(len(words) * (3 - 2 * min_score)))
                out.append((np.full(len(pair), item), pair.view(np.int64), times, *(np.full(len(pair), x) for x in (share // 2, share - share // 2, span, short))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["item", "pair", "times", "aside", "need", "span", "short"])

    return items.select("item", "item_words").mapInArrow(run, "item bigint, pair bigint, times bigint, aside bigint, need bigint, span bigint, short boolean")


def _seeds(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The pairs of every item without its most frequent ones; an item's pairs are as few as its words."""
    counts = hits.groupBy("pair").agg(F.count("*").alias("n_hits"))
    common = Window.partitionBy("item").orderBy(F.desc("n_hits"), "pair").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pairs.join(counts, "pair", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))).withColumn("upto", F.sum("times").over(common))
    return ranked.where("upto > aside").select("pair", "item", "need", "span")


def _hits(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``key, uid, pair, place``: where texts hold a pair that some item holds, and a few others by chance."""
    facts = pairs.agg(F.count("*").alias("n"), F.max("short").alias("short")).first()
    bits = min(_MANY_BITS, max(_FEW_BITS, int(facts["n"]).bit_length() + 6))
    shared = texts.sparkSession.sparkContext.broadcast((bitmap_of(pairs, "pair", bits), (1, 2) if facts["short"] else (1,)))

    def run(batches):
        bitmap, apart = shared.value
        for s in slices(batches, "text"):
            w = Words(*text_of(s.column("text")), ALNUM_LOWER, lower=True)
            begin = np.searchsorted(w.row, np.arange(w.rows + 1))
            for far in apart:
                h, at = pairs_of(w, far)
                held = in_bitmap(bitmap, h)
                h, at = h[held], at[held]
                row = w.row[at]
                yield pa.RecordBatch.from_arrays([*(s.column(c).take(pa.array(row)) for c in ("key", "uid")), pa.array(h.view(np.int64)), pa.array(at - begin[row])], ["key", "uid", "pair", "place"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, uid bigint, pair bigint, place bigint")


def _near(places: Column, need: Column, span: Column) -> Column:
    """Places from which so many seeds lie within the span."""
    return F.filter(places, lambda p, i: F.get(places, (i + need - 1).cast("int")) - p <= span)


def _stretches(near: np.ndarray, span: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the stretches around some places in order; overlapping ones are one."""
    low, high = np.maximum(near - span, 0), np.minimum(near + span + 2, size)
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return low[first], high[np.append(first[1:], len(near)) - 1]


def _scores(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """The score of each item in the stretch of words beside it, computed together where lengths are alike."""
    scores = np.zeros(len(items))
    n, wide = np.array([len(x) for x in items], np.int64), np.array([len(x) for x in stretches], np.int64)
    order, at = np.lexsort((n, wide)), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * wide[order[end]] <= _CELLS:
            end += 1
        some = order[at:end]
        # Item and text are padded with different words.
        a, b = np.zeros((len(some), n[some].max()), np.uint64), np.ones((len(some), wide[some].max()), np.uint64)
        for k, i in enumerate(some):
            a[k, : n[i]] = items[i]
            b[k, : wide[i]] = stretches[i]
        scores[some] = align(a, b) / (2 * n[some])
        at = end
    return scores


def _aligned(candidates: DataFrame, min_score: float) -> DataFrame:
    """``key, item, score, first_word`` of the stretches of texts that match their item."""

    def run(batches):
        for s in slices(batches, "text"):
            w = Words(*text_of(s.column("text")), ALNUM_LOWER, lower=True)
            begin = np.searchsorted(w.row, np.arange(w.rows + 1))
            row, first, words, held = [], [], [], []
            for i, (near, span, raw) in enumerate(zip(*(s.column(c).to_pylist() for c in ("near", "span", "item_words")))):
                item = np.frombuffer(raw, np.uint64)
                for low, high in zip(*_stretches(np.array(near, np.int64), span, int(begin[i + 1] - begin[i]))):
                    row.append(i)
                    first.append(int(low))
                    words.append(item)
                    held.append(w.hash[begin[i] + low : begin[i] + high])
            scores = _scores(words, held)
            good = np.flatnonzero(scores >= min_score)
            row, first = np.array(row, np.int64)[good], np.array(first, np.int64)[good]
            yield pa.RecordBatch.from_arrays([*(s.column(c).take(pa.array(row)) for c in ("key", "item")), pa.array(scores[good]), pa.array(first)], ["key", "item", "score", "first_word"])

    kind = candidates.schema["key"].dataType.simpleString()
    return candidates.select("key", "item", "text", "near", "span", "item_words").mapInArrow(run, f"key {kind}, item bigint, score double, first_word bigint")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", k: int = K, min_score: float = MIN_SCORE) -> DataFrame:
    """Key and item key of texts that hold an item or an edited copy of it, the best score and the passage's first word."""
    items = _items(benchmark, item_key, text, k)
    pairs = stored(_item_pairs(items, min_score))
    whole = F.col(text).cast("string")
    # Rows of one key and text are one; a null or repeated key tells nothing.
    texts = docs.select(F.col(key).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("uid")).where("text <> ''")
    hits = stored(_hits(texts, pairs))
    met = hits.join(_seeds(pairs, hits), "pair").groupBy("key", "uid", "item", "need", "span").agg(F.array_sort(F.collect_set("place")).alias("places"))
    near = met.withColumn("near", _near(F.col("places"), F.col("need"), F.col("span"))).where(F.size("near") > 0)
    likely = stored(near.select("key", "uid", "item", "span", "near").join(items.select("item", "item_words"), "item"))
    same = (F.col("t.uid") == F.col("c.uid")) & F.col("t.key").eqNullSafe(F.col("c.key"))
    candidates = texts.alias("t").join(likely.alias("c"), same).select("t.key", "t.text", "c.item", "c.near", "c.span", "c.item_words")
    found = _aligned(candidates, min_score).join(items.select("item", "item_key"), "item")
    best = found.groupBy("key", "item_key").agg(F.max("score").alias("score"), F.max_by("first_word", F.struct("score", -F.col("first_word"))).alias("first_word"))
    return best.select(F.col("key").alias(key), F.col("item_key").alias(item_key), "score", "first_word")
