"""Encoders, rules and scans against brute force, plain libraries and hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgrid.llm import bpe, decontaminate, licenses, quality_rules, repair
from quillgrid.llm.encoding import SHORT
from quillgrid.llm.textbatch import ALNUM_LOWER, NOT_SPACE, Words
from tests.llm.conftest import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words_of(texts, table, lower=False):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return Words(np.frombuffer(b"".join(raw), np.uint8), off, table, lower), raw


def test_words_and_grams():
    texts = ["one two  three", "", "two\nthree one", "é É-x", "a" * 200 + " " + "a" * 200]
    w, raw = words_of(texts, NOT_SPACE)
    plain = [x for t in raw for x in t.split()]
    assert w.count.tolist() == [len(t.split()) for t in raw] and len(w.hash) == len(plain)
    assert len(set(zip(plain, w.hash.tolist()))) == len(set(plain)) == len(set(w.hash.tolist()))
    grams, at = w.grams(2)
    assert len(grams) == sum(max(0, len(t.split()) - 1) for t in raw)
    upper, _ = words_of(["One TWO"], ALNUM_LOWER, True)
    lower, _ = words_of(["one,two"], ALNUM_LOWER, True)
    assert upper.hash.tolist() == lower.hash.tolist()


@pytest.fixture(scope="module")
def encoder():
    tokens = bpe.read_ranks(RANKS)
    return bpe.Encoder(tokens, bpe.PerfectHash.build(bpe.hash_tokens(tokens)), public_tokenizers.PATTERN)


def test_perfect_hash_is_minimal(encoder):
    n = len(encoder.tokens)
    assert sorted(encoder.perfect.id_at.tolist()) == list(range(n))
    assert (encoder.perfect.probe(bpe.hash_tokens(encoder.tokens)) == np.arange(n)).all()
    for few in (1, 2, 3):
        h = bpe.hash_tokens([b"a", b"bc", b"d"][:few])
        assert bpe.PerfectHash.build(h).probe(h).tolist() == list(range(few))


def test_encoding_equals_the_library(encoder):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})
    rng = random.Random(5)
    letters = " \n\t\r\x0b\x1c\x1f\x85\xa0  　​aAé1²٣'sﬁ漢字😀̀-_.\\"
    texts = ["", " ", "it's  we'll", "<|endoftext|>", "x" * 3000, *["".join(rng.choices(letters, k=rng.randint(0, 15))) for _ in range(3000)]]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_round_trip_frame(spark, odd_docs, no_docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    rows = bpe.round_trip(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 10
    for r in rows:
        ids = np.array(own.encode_ordinary(r.text or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    coded = bpe.decode(bpe.encode_checked(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_repair_compresses_and_expands():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile([5, 6, 7, 8], 500), rng.integers(0, 30, 4000), [9] * 1000]).astype(np.uint32)
    ends = np.array([0, 10, 1999, 4000, len(ids) - 1])
    symbols, at, left, right, expanded = repair.compress(ids, ends, 100)
    assert (repair.expand(symbols, left, right, expanded, 100) == ids).all()
    # The 3,000 ids of the two repeated parts all but vanish, the 4,000 random ones do not compress.
    assert len(symbols) < 4300 and len(at) == len(ends)
    whole = {"symbols": symbols.astype("<u4").tobytes(), "at": at.tobytes(), "left": left.tobytes(), "right": right.tobytes(), "terminals": 100}
    for i, (a, b) in enumerate(zip([0, *(ends[:-1] + 1)], ends + 1)):
        assert (repair.access(whole, i) == ids[a:b]).all()
    assert all(x < 100 + i for i, x in enumerate(np.maximum(left, right).tolist()))


def test_repair_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 20, 3000), np.tile(rng.integers(20, 40, 7), 40), [41] * 200, rng.zipf(1.5, 2000) % 50]).astype(np.uint32)
    ends = np.array([100, 101, 3500, len(ids) - 1])
    symbols, at, left, right, expanded = repair.compress(ids, ends, 100)
    assert (repair.expand(symbols, left, right, expanded, 100) == ids).all()
    uses = Counter(pair for part in np.split(symbols, at[1:]) for pair in zip(part.tolist(), part[1:].tolist()))
    assert max(uses.values()) < repair.MIN_COUNT


@pytest.mark.parametrize("plain", [False, True])
def test_repair_ids_are_the_library(spark, tmp_path, plain):
    """Strings of added tokens are their ids, or ordinary text on request."""
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = plain
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n\n y", "<|endoftext", "plain"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    repair.write_shards(frame, VOCABULARY, str(tmp_path / "shards"), 2, plain=plain)
    got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in repair.read_shards(spark, str(tmp_path / "shards")).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert plain or got[0] == [64, 220, 50256, 275, 2]


def test_spaceless_text_is_not_remembered():
    tokens = bpe.read_ranks(RANKS)
    encoder = bpe.Encoder(tokens, bpe.PerfectHash.build(bpe.hash_tokens(tokens)), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["漢字仮名" * 300 + str(i) + " short" for i in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert max(map(len, [*encoder.memo, *encoder.known])) <= SHORT


def test_repair_files(spark, odd_docs, no_docs, tmp_path):
    t = Tokenizer.from_file(VOCABULARY)
    folder = str(tmp_path / "shards")
    repair.write_shards(odd_docs.repartition(4), VOCABULARY, folder, 2, shard_ids=500)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(repair.read_shards(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    for want, r in zip(rows, got, strict=True):
        ids = np.array([*t.encode(want.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.key, r.start, r.n_tokens, bytes(r.ids)) == (want.doc_id, start, len(ids), ids.tobytes())
        start += len(ids)
    crc = {r.start: r.ids_crc32 for r in repair.digest_shards(spark, folder).collect()}
    assert all(crc[r.start] == zlib.crc32(bytes(r.ids)) for r in got)
    repair.write_shards(no_docs, VOCABULARY, str(tmp_path / "none"), 2)
    assert repair.read_shards(spark, str(tmp_path / "none")).count() == 0


def base_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    marked = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked), failed


def test_quality_counts(spark, odd_docs, make_docs):
    repeated = prose(30, 1) + " " + prose(12, 1) + " " + prose(30, 5)
    more = make_docs(repeated, "a b c d e a b c d e a b", "x\nx\n \nx y\n" + prose(20, 2), "# | <a> é" * 9, "   a b " + prose(9, 1))
    untaught = quality_rules.fit(more.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    for frame in (odd_docs, more):
        for r in quality_rules.judge(frame, untaught).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_of(r.text)
            assert r.quality == pytest.approx(0.5) and r.kept == (not r.base_failed)
        assert quality_rules.keep_rows(frame, untaught).count() == quality_rules.judge(frame, untaught).where("kept").count()


def test_license_places(spark, odd_docs, no_docs, make_docs):
    texts = ["The MIT License. mit-license!", "see gnu General Public License, or CC BY-NC 4.0", "apache  licenses", "x Apache License y", "mit", None, "MIT License " * 300]
    notice = licenses.NOTICES[0][0].replace("free of charge", "entirely free of any charge")
    rows = {r.doc_id: r for r in licenses.scan(make_docs(*texts, notice + " " + prose(50, 1))).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        places = [(j, label) for p, label in licenses.PHRASES for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((j for j, _ in places), default=None), max((j for j, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert rows[1].labels == "cc-by,cc-by-nc,gpl" and rows[2].labels == "" and rows[2].score == 0
    assert rows[7].labels == "mit" and rows[7].base_labels == "" and 0.5 <= rows[7].score < 1
    assert licenses.scan(odd_docs).count() == 10 and licenses.scan(no_docs).count() == 0


def smith_waterman(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontaminate.smith_waterman(a, b) == smith_waterman(a.tolist(), b.tolist())


def test_leaks(spark, odd_docs, no_docs, make_docs):
    items = [prose(30, 1), prose(25, 2), prose(40, 4), "too short", None, prose(25, 2)]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    edited = items[2].split()
    for i in range(3, 40, 9):
        edited[i] = "changed"
    del edited[20]
    edited.insert(10, "added")
    # Passages begin and end with words of their own, so that no shared word touches them.
    texts = ["start " + items[0].upper() + " end", prose(200, 9), " ".join(edited), items[1][: len(items[1]) // 3], "", None, "x " * 500 + items[1] + " y" * 500, "too short"]
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(make_docs(*texts), benchmark).collect()}
    assert set(found) == {(0, 0), (2, 2), (6, 1), (6, 5)}
    assert found[0, 0] == found[6, 1] == 1 and 0.6 <= found[2, 2] < 1
    # The very long text begins with the very words of these items.
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs, benchmark).collect()} == {(4, 0), (4, 1), (4, 2), (4, 5)}
    assert decontaminate.find_leaks(no_docs, benchmark).count() == 0
    assert decontaminate.find_leaks(odd_docs, benchmark.where("false")).count() == 0
    many = make_docs(*[prose(20, i) + " " + items[0] + " " + prose(9, i) for i in range(30)], "a b " + items[1])
    assert decontaminate.find_leaks(many, benchmark).select("doc_id").distinct().count() == 31


def test_leaks_however_frequent(spark, make_docs):
    """An edited copy in very many texts is found, beside the item itself in one."""
    item = prose(20, 3).split()
    benchmark = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    edited = [f"x{i}" if i in (6, 10, 14, 18) else t for i, t in enumerate(item)]
    found = decontaminate.find_leaks(make_docs(" ".join(item), *[f"doc{i} " + " ".join(edited) + f" end{i}" for i in range(300)]), benchmark).collect()
    assert len(found) == 301 and sorted({r.score for r in found}) == [pytest.approx(0.7), 1.0]


def test_leaks_equal_alignment_of_everything(spark, monkeypatch):
    """Copies with a tenth to a third of their words edited, against every item aligned with every text."""
    monkeypatch.setattr(decontaminate, "_CELLS", 500)
    rng = random.Random(6)
    items = [prose(n, 20 + n) for n in (4, 5, 6, 9, 15, 20, 40, 59)]
    texts = ["q".join(f" {t} " for t in items[0].split()), " q ".join(items[1].split())]
    for words in (t.split() for t in items):
        texts += [" ".join("new" if i % 4 == at else t for i, t in enumerate(words)) for at in range(4)]
        for rate in (0.1, 0.2, 0.25, 0.3, 0.35):
            for _ in range(4):
                edit = lambda t: rng.choice([f"e{rng.randrange(99)}", "", f"{t} e{rng.randrange(99)}"]) if rng.random() < rate else t
                texts.append(prose(rng.randrange(60), 7) + " " + " ".join(map(edit, words)) + " " + prose(rng.randrange(60), 8))
    w, _ = words_of(texts, ALNUM_LOWER, True)
    v, _ = words_of(items, ALNUM_LOWER, True)
    want = {}
    for i in range(len(items)):
        a = v.hash[v.row == i]
        for d in range(len(texts)):
            score = smith_waterman(a.tolist(), w.hash[w.row == d].tolist()) / (2 * len(a))
            if score >= decontaminate.MIN_SCORE:
                want[d, i] = pytest.approx(score)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(docs, benchmark).collect()} == want


def test_common_pairs_are_left_aside(spark):
    """Of every item the most frequent pairs do not seed, as many as half of what a passage must share; others do, however common."""
    item = prose(30, 5).split()
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, "a b c d e")], "item_id bigint, text string")
    common = " ".join(item[:8])
    texts = spark.createDataFrame([(i, f"{common} z{i}", i) for i in range(50)], "key bigint, text string, uid bigint")
    items = decontaminate._items(benchmark, "item_id", "text", 4)
    pairs = decontaminate._item_pairs(items, 0.6)
    share = int(decontaminate.must_share(np.array([30]), 0.6)[0])
    seeds = decontaminate._seeds(pairs, decontaminate._hits(texts, pairs))
    kept = {r["item"]: (r["n"], r["need"]) for r in seeds.groupBy("item").agg(F.count("*").alias("n"), F.min("need").alias("need")).collect()}
    assert sorted(kept.values()) == [(8, 1), (29 - share // 2, share - share // 2)]
    frequent = {r["pair"] for r in decontaminate._hits(texts, pairs).groupBy("pair").count().where("count = 50").collect()}
    assert len(frequent) >= 7 > share // 2 and len(frequent & {r["pair"] for r in seeds.collect()}) >= 7 - share // 2
