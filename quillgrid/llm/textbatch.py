"""Words, n-grams and their hashes over whole Arrow text columns, computed on the bytes with numpy.

A text column becomes one byte array with row offsets (null reads as empty). Every function works on such a slice of
rows; slices are bounded by bytes, a single long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 18

_RNG = np.random.default_rng(20240607)
#: A random value for every byte at every place of a word, place by place; places repeat after 64.
_BYTE_AT = _RNG.integers(0, 2**64, 64 * 256, dtype=np.uint64)
_STEP = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def _salt(n: int) -> np.uint64:
    return np.uint64(n * int(_LENGTH) & (2**64 - 1))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words cut at ASCII white space, and of words of digits, letters and everything beyond ASCII.
NOT_SPACE = ~_table((0x09, 0x0D), (0x20, 0x20))
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
ALNUM_LOWER = _table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    raw = a.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), off


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``limit`` text bytes, or of one row; empty batches vanish."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of a slice: ``hash``, ``start`` (byte), ``size`` (bytes) and ``row`` of each, ``count`` by row.

    ``inside`` holds the bytes of all words in sequence and ``place`` their position in the word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = False):
        low = int(off[0])
        b = data[low : int(off[-1])]
        if lower:
            b = LOWER[b]
        self.rows, n = len(off) - 1, len(b)
        within = table[b]
        cut = np.zeros(n + 1, bool)
        cut[off - low] = True
        begin = within.copy()
        if n:
            begin[1:] &= ~within[:-1] | cut[1:n]
        self.start = np.flatnonzero(begin)
        at = np.flatnonzero(within)
        self.first = np.searchsorted(at, self.start)
        self.size = np.diff(self.first, append=len(at))
        self.inside = b[at]
        self.place = np.arange(len(at), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.size)
        if len(self.start):
            value = _BYTE_AT.take((self.place & 63) << 8 | self.inside)
            if int(self.size.max()) > 64:
                value = value * (2 * (self.place >> 6) + 1).astype(np.uint64)
            total = np.add.reduceat(value, self.first)
        else:
            total = np.zeros(0, np.uint64)
        self.hash = mix(total + self.size.astype(np.uint64) * _LENGTH)
        self.row = np.searchsorted(off - low, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.bytes = b

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of k words inside one row."""
        h, m = self.hash, len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[k - 1 :] == self.row[:m])
        total = np.zeros(m, np.uint64)
        for j in range(k):
            total += h[j : j + m] * _STEP[j]
        return mix(total[at] + _salt(k)), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every shingle: runs of k words, or the whole sequence of a row with 1 to k - 1 words."""
        h, at = self.grams(k)
        row = self.row[at]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            first = np.searchsorted(self.row, short)
            total = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = self.count[short] > j
                total[has] += self.hash[first[has] + j] * _STEP[j]
            h = np.concatenate([h, mix(total + self.count[short].astype(np.uint64) * _LENGTH)])
            row = np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            h, row = h[order], row[order]
        return h, row

    def byte_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of n bytes (n up to 8) of a word; the byte before a word counts as a space."""
        at = np.flatnonzero(self.place >= n - 2)
        key = np.zeros(len(at), np.uint64)
        for j in range(n - 1):
            key |= self.inside[at - j].astype(np.uint64) << np.uint64(8 * j)
        before = np.where(self.place[at] >= n - 1, self.inside[at - (n - 1)], np.uint8(32))
        key |= before.astype(np.uint64) << np.uint64(8 * (n - 1))
        return mix(key + _salt(n)), np.repeat(self.row, self.size)[at]


def hash_words(words: list[str], k: int) -> np.ndarray:
    """Hashes of the k-grams of given words, equal to those of a text that holds them."""
    text = " ".join(words).encode()
    return Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), NOT_SPACE).grams(k)[0]


def bitmap_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for the leading bits of every hash; at most 2 ** (bits - 6) rows reach the driver."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{column}`, {64 - bits}) & 63 as int))")
    words = hashes.groupBy(F.shiftrightunsigned(column, 70 - bits).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(np.uint8)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit; hashes that were not given may have it too."""
    top = (hashes >> np.uint64(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[top >> 3] >> (top & 7).astype(np.uint8) & 1).astype(bool)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """The frame with columns computed from a text column in Arrow slices; columns of the same names are replaced.

    ``compute(data, off)`` gives one array per field. ``text`` itself stays unless a field replaces it.
    """
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in fields}]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])
    arrow = [f.name for f in fields]
    source = "__text"

    def run(batches):
        for part in slices(batches, source, limit):
            found = compute(*text_of(part.column(source)))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *[x if isinstance(x, pa.Array) else pa.array(x) for x in found]], [*names, *arrow])

    whole = df.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").cast("string").alias(source))
    return whole.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, taken by a hash of the key; all rows if there are no more.

    For fitting only. The share is set by the row count, so the sample does not grow with the table.
    """
    rows = df.count()
    if rows <= max_rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * max_rows / rows))
