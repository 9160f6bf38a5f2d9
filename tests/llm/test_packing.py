"""Encoding by pieces, best-fit packing, spelling variants and hard negatives against plain versions."""

import bisect
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrid.llm import encoding, negatives, packing, spelling
from quillgrid.llm.queries import QUERIES
from quillgrid.session import stored
from tests.llm.conftest import prose

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Be", "é", "É", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "　", "\xa0", "́", "'s", "'", "12", "<|endoftext|>", "<|startoftext|>", "<|", "漢字", "Σ", "!?", "$", "İ", "\U0001f600", "ß", "µ", "×", "'LL", "\x00"]


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize(("kind", "path"), [(encoding.WordEncoder, WORDS), (encoding.ByteLevelEncoder, BYTES)])
def test_pieces_are_the_library(monkeypatch, kind, path, plain):
    monkeypatch.setattr(encoding, "WINDOW", 30)
    library, dice = Tokenizer.from_file(path), random.Random(3)
    library.encode_special_tokens = plain
    encoder = kind(open(path, encoding="utf-8").read(), plain, remembered=40)
    for _ in range(1500):
        text = "".join(dice.choice(PARTS) for _ in range(dice.randint(0, 25)))
        assert encoder(text) == ids_of(library, text), repr(text)


def test_memory_is_bounded():
    """Text without spaces is not remembered, other pieces up to a number."""
    encoder = encoding.ByteLevelEncoder(open(BYTES, encoding="utf-8").read(), remembered=100)
    for i in range(300):
        encoder("漢字" * 200 + str(i) + f" word{i} plain")
    assert len(encoder.later) <= 100 and all(len(k) <= encoding.SHORT for d in (encoder.first, encoder.later) for k in d)
    long = "ab " * 1_500_000
    assert len(encoder(long)) == 4 * 1_500_001


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
    return len(rooms)


def check_packed(rows, capacity):
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


@pytest.mark.parametrize(("shape", "tasks"), [("even", 1), ("even", 5), ("short", 5), ("same", 5), ("long", 3), ("mixed", 7)])
def test_place(spark, monkeypatch, shape, tasks):
    """Every piece once, gapless, and about as few sequences as sequential best fit needs, however many tasks take part."""
    dice, capacity = random.Random(5), 256
    draw = {
        "even": lambda: dice.randint(1, capacity), "short": lambda: dice.randint(1, 20), "same": lambda: 90 if dice.random() < 0.6 else dice.randint(1, 60),
        "long": lambda: dice.randint(120, capacity), "mixed": lambda: max(1, min(capacity, int(dice.lognormvariate(3.5, 1.2)))),
    }[shape]
    lengths = [draw() for _ in range(3000)]
    monkeypatch.setattr(packing, "_tasks", lambda rows, spark: tasks)
    pieces = stored(spark.createDataFrame(list(enumerate(lengths)), "piece_id bigint, length bigint"))
    rows = packing.pack(pieces, capacity).collect()
    assert sorted((r["piece_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert check_packed(rows, capacity) <= max(plain_best_fit(lengths, capacity) * 1.02 + 1, 1 - (-sum(lengths) // capacity))


def test_sweep_is_best_fit():
    """One task alone gives the sequential result."""
    rows = [(9, None, 1), (7, None, 2), (7, 10, None), (6, 11, None), (2, 12, None), (1, None, 3), (1, 13, None), (1, 14, None), (1, 15, None)]
    found = list(packing._swept(rows, 0, 9))
    assert [(r[2], r[3], r[5]) for r in found if r[1] == "placed"] == [(10, 2, 2), (11, 1, 0), (12, 1, 6), (13, 3, 8), (14, 1, 8)]
    assert [(r[1], r[2], r[4], r[6]) for r in found if r[1] != "placed"] == [("waiting", 15, 1, 0), ("count", None, 0, 1)]


def test_lacking():
    dice = random.Random(1)
    for _ in range(200):
        lengths = [dice.randint(1, 30) for _ in range(dice.randint(0, 60))]
        assert packing._lacking(Counter(lengths), {}, 30) == plain_best_fit(lengths, 30)
    assert packing._lacking({5: 3, 4: 1}, {9: 1, 5: 1, 3: 4}, 20) == 1


def test_ranks():
    assert packing._starts([(1, 4, 2), (0, 3, 0), (2, 1, 1)]) == [(0, 0, 0), (1, 3, 0), (2, 7, 2)]


def test_pack_documents(spark, odd_docs, no_docs):
    assert packing.pack(stored(packing.encode(no_docs, WORDS, 0))).collect() == []
    pieces = stored(packing.encode(odd_docs, WORDS, 0, 512))
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack(pieces, 512).collect()
    check_packed(rows, 512)
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r["doc_id"]].append(ids_of(library, r["text"] or "") + b"\0\0\0\0")
    found = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: r["piece_id"]):
        assert r["start"] == 512 * r["piece"] and len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 512
        found[r["doc_id"]] += r["ids"]
    assert {k: len(v) for k, v in found.items()} == {k: sum(map(len, v)) for k, v in texts.items()}
    assert all(found[k] == v[0] for k, v in texts.items() if len(v) == 1)
    packed = stored(packing.pack(pieces, 512))
    for s in packing.sequences(packed).collect():
        parts = sorted((r["offset"], r["ids"]) for r in rows if r["sequence_id"] == s["sequence_id"])
        assert s["n_tokens"] * 4 == len(s["ids"])
    assert packing.sequences(packed).agg(F.sum("n_tokens")).first()[0] * 4 == sum(map(len, found.values())) and parts


def test_packing_query(spark, tmp_path):
    texts = [None, "", "one", *[" ".join(prose(30 + i, i) for _ in range(1 + i % 90)) for i in range(120)]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op11_bulk_best_fit"](spark, str(tmp_path)).collect()
    library, want = Tokenizer.from_file(WORDS), set()
    for i, t in enumerate(texts):
        ids = ids_of(library, t or "") + b"\0\0\0\0"
        want |= {(i, at // 8192, at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])) for at in range(0, len(ids), 8192)}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert check_packed(rows, 2048) <= plain_best_fit([w[3] for w in want], 2048) + 1


def counted(texts, damage):
    counts = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if w:
                counts[w] += 1
    return counts


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    form, nears = {}, {w: [x for x in words if one_apart(w, x)] for w in words}
    for w, found in nears.items():
        if found and words[best := min(found, key=lambda x: (-words[x], x))] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(nears[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def words_frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)


@pytest.mark.parametrize(("block", "seed"), [(1 << 13, 1), (8, 2)])
def test_forms(spark, monkeypatch, block, seed):
    """Random short words over few letters, so that many are near; a small block cuts every subtrie."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    dice = random.Random(seed)
    words = {"".join(dice.choice("abeÿÀà") for _ in range(dice.randint(1, 6))): 5 ** dice.randint(0, 6) for _ in range(400)}
    long = "long" * 40
    words |= {long: 500, long[:70] + long[71:]: 3, long[:70] + "x" + long[71:]: 5, "x" + long: 100, long + "xx": 1}
    rows = spelling.forms(stored(words_frame(spark, words))).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows} == plain_forms(words) and len(rows) == len(words)


def test_near():
    dice = random.Random(0)
    for _ in range(3000):
        a, b = ("".join(dice.choice("ab") for _ in range(dice.randint(0, 6))) for _ in "ab")
        assert spelling.near(a, b) == (a != b and one_apart(a, b))


def test_trie_leaves_out():
    """The search opens few of the words: those whose counts differ by one more and one less."""
    dice = random.Random(9)
    words = list({"".join(dice.choice("abcdefghijklmnopqrst") for _ in range(9)) for _ in range(3000)})
    counts = spelling.vectors(words)
    trie = spelling.Trie(np.zeros(len(words), np.int64), counts)
    opened = sum(len(q) for q, _ in trie.search(np.zeros(len(words), np.int64), counts, np.ones(len(words), np.int8), np.ones(len(words), np.int8)))
    assert len(words) <= opened < len(words) ** 2 / 30


def test_spelling_of_documents(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    assert spelling.forms(stored(spelling.count_words(no_docs))).collect() == []
    monkeypatch.setattr(spelling, "_HELD", 50)
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(i, prose(200, i) + " Éamber ÀMBER÷x colour" + " color colour" * i) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == dict(counted(texts, None))
    damaged = counted(texts, 199)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_spelling_variants"](spark, str(tmp_path)).collect()
    want = plain_forms({w: n for w, n in damaged.items() if len(w) >= 6 and n >= 5})
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows} == want


VECTORS = "vec_id bigint, embedding array<float>, label int, score double, leaf string"


def plain_negatives(rows, positives=5, negatives=10, every=100):
    """Rows (id, label, vector) taken one by one."""
    want = set()
    rows = list({(i, y, tuple(v)) for i, y, v in rows})
    for i, y, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in rows)
        for s, p, _ in [x for x in scored if x[2] == y and x[1] != i][:positives]:
            fits = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            want |= {(i, p, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits)}
    return want


def mined(found):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [1 << 12, 40])
def test_negatives(spark, monkeypatch, block):
    """Clusters and ties, with a tree of many nodes and cut leaves."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LEAF_SAMPLE", 16)
    rng = np.random.default_rng(block)
    centre = rng.integers(-30, 30, (12, 5))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in centre[i % 12] + rng.integers(-4, 4, 5)]) for i in range(900)]
    rows += [(i + 1000, i % 3, [10.0, 10.0, 0.0, 0.0, 0.0]) for i in range(40)] + rows[:30] + [(2001, 1, [3.0]), (2002, 1, []), (2100, 2, [-5.0, 1.0])]
    frame = spark.createDataFrame(rows, "id bigint, label bigint, vector array<double>").repartition(5)
    padded = [(i, y, [*v, *[0.0] * (5 - len(v))]) for i, y, v in rows]
    assert mined(negatives.mine(frame, F.col("id") % 50 == 0, sample_rows=300)) == plain_negatives(padded, every=50)


def test_tree_leaves_out():
    """On clusters most leaves are left out, and never one that holds a row of the window."""
    rng = np.random.default_rng(2)
    rows = (rng.normal(0, 40, (30, 8))[rng.integers(0, 30, 4000)] + rng.normal(0, 1, (4000, 8))).round()
    tree = negatives.Tree.fit(rows[::4], float((rows * rows).sum(1).max()), 8, 32)
    for node, _, d in tree.walk(rows):
        if d is not None:
            near = d.argmin(1)
            node.low = np.array([[d[near == j, i].min(initial=np.inf) for j in range(d.shape[1])] for i in range(d.shape[1])])
            node.high = np.array([[d[near == j, i].max(initial=-np.inf) for j in range(d.shape[1])] for i in range(d.shape[1])])
    leaf, asked = tree.leaf_of(rows), rows[:200]
    own = (asked * asked).sum(1)
    low, high, score = own * 0.8, own * 0.95, asked @ rows.T
    reached = {(int(q), to) for to, at in tree.reached(asked, low, high) for q in at}
    must = {(int(q), int(leaf[x])) for q, x in zip(*np.nonzero((score >= low[:, None]) & (score <= high[:, None])))}
    assert must and must <= reached and len(reached) < 0.5 * 200 * tree.leaves


def test_negatives_query(spark, tmp_path):
    rng = np.random.default_rng(8)
    good = [(i, [float(x) for x in rng.normal(0, 0.3, 6).astype(np.float32)], i % 4) for i in range(450)]
    bad = [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan")], 2), (800, [float("inf"), 1.0], 2), (900, [1.0], None), (None, [1.0], 1)]
    frame = spark.createDataFrame([(i, v, y, 0.5, "x") for i, v, y in good + bad], VECTORS)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * x)) for x in v]) for i, v, y in good]
    assert mined(QUERIES["op12_hard_negatives"](spark, str(tmp_path))) == plain_negatives(rows)
    frame.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op12_hard_negatives"](spark, f"{tmp_path}/none").collect() == []
