"""Classifiers, chat templates, near duplicates, pages and the pipeline against brute force and hand-made cases."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from quillgrid.llm import chat, compression, factorization, jaccard, quality_rules, style_tree
from quillgrid.llm.components import components
from quillgrid.llm.queries import ORACLE, QUERIES, fold
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def labelled(spark, rows):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id bigint, text string, label int")


def test_machine_score_is_the_definition():
    rng = np.random.default_rng(0)
    m = factorization.Machine(np.zeros(0, np.int16), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    row, term = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 5, 0, 1])
    want = []
    for r in range(3):
        t = term[row == r]
        pairs = sum(float(m.vector[i] @ m.vector[j]) for n, i in enumerate(t) for j in t[n + 1 :])
        want.append(m.bias + m.weight[t].sum() + pairs)
    assert m.scores(row, term, 3) == pytest.approx(want)


def test_machine_learns_pairs():
    """Either term alone is harmless, both together are not."""
    rng = np.random.default_rng(4)
    has = rng.random((600, 2)) < 0.5
    y = (has[:, 0] & has[:, 1]).astype(int)
    row, bucket = np.nonzero(has)
    m = factorization.train(y, row, bucket.astype(np.int32), steps=600)
    assert (m.term >= 0).sum() == 2
    p = factorization.sigmoid(m.scores(row, m.term[bucket].astype(np.int64), 600))
    assert ((p > 0.5) == y).all()


def test_toxicity(spark, odd_docs, no_docs):
    rows = [(prose(40, i) + (" blockhead, " if i % 4 == 0 else " ") + prose(10, i + 1), int(i % 4 == 0)) for i in range(200)]
    model = factorization.fit(labelled(spark, rows))
    new = labelled(spark, [(prose(60, 300 + i) + (" blockhead!" if i % 2 else ""), i % 2) for i in range(40)])
    assert factorization.score(new, model).where("(score >= 0.7) <> (label = 1)").count() == 0
    scored = factorization.score(odd_docs, model).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored) and len({r.score for r in scored if not (r.text or "").strip()}) == 1
    assert factorization.score(no_docs, model).count() == 0
    for rows, prior in (([], 0.5), ([("a", 1), ("b", 1)], 2.5 / 3)):
        untaught = factorization.fit(labelled(spark, rows))
        assert factorization.score(odd_docs, untaught).select("score").distinct().collect()[0][0] == pytest.approx(prior)


def test_quality_rules_learn(spark):
    rows = [(prose(50, i) if i % 2 else " ".join(w + "$$$" for w in prose(50, i).split()), i % 2) for i in range(120)]
    weights = quality_rules.fit(labelled(spark, rows))
    new = labelled(spark, [(prose(70, 500 + i) if i % 2 else " ".join(w + "$$$" for w in prose(70, 500 + i).split()), i % 2) for i in range(30)])
    assert quality_rules.judge(new, weights).where("kept <> (label = 1)").count() == 0


def test_platt_is_calibrated():
    rng = np.random.default_rng(1)
    raw = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < factorization.sigmoid(0.7 * raw - 1)).astype(int)
    slope, shift = quality_rules.platt(raw, y)
    assert slope == pytest.approx(0.7, abs=0.05) and shift == pytest.approx(-1, abs=0.08)


def test_compression(spark, odd_docs, no_docs):
    bad = lambda i: " ".join(w.upper() + "!!" for w in prose(60, i).split())
    model = compression.fit(labelled(spark, [(prose(60, i) if i % 2 else bad(i), i % 2) for i in range(160)]))
    new = compression.score(labelled(spark, [(prose(80, 700 + i) if i % 2 else bad(700 + i), i % 2) for i in range(30)]), model)
    assert new.where("(score >= 0.7) <> (label = 1)").count() == 0
    scored = compression.score(odd_docs, model).collect()
    assert len(scored) == 10 and all(0 <= r.score <= 1 for r in scored)
    assert [r.score for r in scored if not r.text] == [pytest.approx(model.prior)] * 2
    assert compression.score(no_docs, model).count() == 0
    untaught = compression.fit(labelled(spark, []))
    assert {r.score for r in compression.score(odd_docs, untaught).collect()} == {0.5}


def test_compression_from_sizes_to_score(spark):
    """The score is the logistic curve over the difference of sizes, each piece compressed by itself."""
    bad = lambda i: " ".join(w.upper() + "!!" for w in prose(60 + i, i).split())
    rows = [(prose(60 + i, i) if i % 3 else bad(i), int(i % 3 > 0)) for i in range(150)]
    model = compression.fit(labelled(spark, rows))
    assert len(model.theta) == 2 and model.theta[1] > 0
    for r in compression.score(labelled(spark, [*rows[:20], ("é" * 5000, 1), ("x", 0)]), model).collect():
        raw, size = r.text.encode(), {}
        for name in ("good", "bad"):
            own = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(getattr(model, name)), write_content_size=False, write_dict_id=False)
            size[name] = sum(len(own.compress(raw[a : a + compression.PIECE])) for a in range(0, len(raw), compression.PIECE))
        z = model.theta[0] + model.theta[1] * 10 * (size["bad"] - size["good"]) / len(raw)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=0.02)


def test_dictionaries_are_of_whole_balanced_texts(monkeypatch):
    """Every text of the smaller class counts whole, and of the larger class as many whole texts as reach its size."""
    seen = []
    monkeypatch.setattr(compression, "_dictionary", lambda texts: seen.append(list(texts)) or b"\n".join(texts))
    texts = [prose(400 if i % 4 else 700, i).encode() for i in range(200)]
    y = np.array([int(i % 4 > 0) for i in range(200)])
    compression.train(texts, y)
    builds = [i for i in range(200) if i % compression.CALIBRATES]
    good, bad = seen
    assert bad == [texts[i] for i in builds if not y[i]]
    assert good == [texts[i] for i in builds if y[i]][: len(good)] and 0 <= sum(map(len, good)) - sum(map(len, bad)) < 5000


@needs_data
def test_compression_on_held_out_rows(spark):
    scored = QUERIES["op9_compression_classifier"](spark, SF.replace("0.001", "0.01")).where("held_out")
    truth = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").where("quality is not null")
    found = scored.join(truth, "doc_id").selectExpr("avg(cast(predicted = quality as int)) as right", "count(*) as n").first()
    assert found["n"] > 50 and found["right"] > 0.9


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    for r in spark.range(50).select("id", fold("id", 3).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.id).encode()) % 3


HARD = ["", "plain", "</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]", "ends \\", "\n", "[/INST]\n", "<s>user\nx\n</s>\n", "\n\n</s>", "<<SYS>> <</SYS>> <s></s>", "[INST][INST]", "é😀\u2028", "$1 \\1", "\\n"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "a\\b\nc", "[INST]", "", None]
    turns, want = [], {}
    for c in range(60):
        said = [(rng.choice(roles), rng.choice([*HARD, None, "".join(rng.choices(["<s>", "</s>", "\\", "\n", "[INST]", "[/INST]", "a", " "], k=8))])) for _ in range(rng.randint(1, 6))]
        turns += [(c, i, r, t) for i, (r, t) in enumerate(said)]
        want[c] = [(r or "", t or "") for r, t in said]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).repartition(5)
    done = chat.format_conversations(df)
    for r in done.collect():
        assert [(p.role, p.text) for p in r.parsed] == want[r.conv_id]
        learnt = [t for role, t in want[r.conv_id] if role == "assistant"]
        assert len(r.loss_spans) == len(learnt)
    for r in chat.digest(done).collect():
        said = want[r.conv_id]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(df.where("false"))).count() == 0
    twice = spark.createDataFrame([(None, None, "user", "a"), (None, None, "user", "a"), (None, 1, None, None)], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.digest(chat.format_conversations(twice)).collect()] == [(None, 3)]


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digest(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(docs):
    sets = {k: shingles(t) for k, t in docs}
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


def test_near_duplicates(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    rng = random.Random(8)
    texts = []
    for group in range(6):
        base = prose(80, group + 1).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    passage = prose(30, 50)
    texts += [passage + " " + prose(60, 100 + i) for i in range(25)] + ["One two", "one TWO", "three", "", None, " "] + texts[:5]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(frame).collect()}
    assert got == brute_components(docs)
    odd = jaccard.near_duplicates(odd_docs).collect()
    assert len(odd) == 10
    found = {r.doc_id: r.component_id for r in odd}
    assert found[5] == found[6] == 5 and found[1] == 1 and found[2] == 2 and found[3] == 3
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_signatures_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(1, n + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (a, b))
        assert jaccard.lacking(x, y) <= len(a) - both and jaccard.lacking(y, x) <= len(b) - both
        if jaccard.linked(both, len(a), len(b)):
            assert jaccard.may_link(x, len(a), y, len(b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 60), (60, 80), (7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 80: 60, 100: 60}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header>site</header>
<nav><ul><li>menu</li></ul></nav><!-- x --><div class="ad">buy</div>%s<footer>&copy; me</footer>"""


def pages_of(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(0))


def test_article_text(spark):
    article = PAGE % (
        "<article><header><h1>Head &amp; <b>line</b></h1></header><p><b>One  two<br>three<p>fo<i>ur</i>\n five<ul><li>six<li>seven</ul>"
        "<aside>side</aside><form>f<input></form><div class='user comments'><p>said</p></div><blockquote>eight</blockquote></article>"
    )
    rows = style_tree.extract(pages_of(spark, ("http://a.b/c", article), ("x", None), (None, ""), ("http://[", "<p>no mark"), ("http://q", "a < b &lt;c <b>d"))).collect()
    text = {r.page_id: r.text for r in rows}
    assert text[0] == "Head & line\nOne two three\nfour five\nsix\nseven\neight"
    assert (text[1], text[2], text[3], text[4]) == ("", "", "no mark", "a < b <c d")
    assert all(r.n_chars == len(r.text) for r in rows) and {r.url for r in rows if r.page_id in (1, 2)} == {"x", None}
    assert style_tree.extract(pages_of(spark, ("a", "b")).where("false")).count() == 0


def test_site_branches(spark):
    """A box that every page of a site repeats goes, repeated paragraphs of an article stay, other hosts do not matter."""
    marked = [("http://site/%d" % i, PAGE % f"<article><h1>T{i}</h1><div class=box>Read us daily</div><p>{prose(20, i)}</p><p>same words</p></article>") for i in range(12)]
    plain = [("http://plain/%d" % i, f"<body><div class=top>Our site</div><div class=text><p>{prose(20, i)}</p></div></body>") for i in range(12)]
    alone = [("http://alone/", PAGE % "<article><div class=box>Read us daily</div><p>x</p></article>")]
    copies = [("http://copies/%d" % i, PAGE % "<article><div class=x>copied <p>text</p></div></article>") for i in range(12)]
    text = {r.page_id: r.text for r in style_tree.extract(pages_of(spark, *marked, *plain, *alone, *copies)).collect()}
    for i in range(12):
        assert text[i] == f"T{i}\n{prose(20, i)}\nsame words"
        assert text[12 + i] == prose(20, i)
        assert text[25 + i] == "copied\ntext"
    assert text[24] == "Read us daily\nx"


def test_copies_keep_their_text(spark):
    """Copies count once: a path that only copies use stays, on hosts with and without marked articles."""
    other = [("http://site/%d" % i, PAGE % f"<article><h1>T{i}</h1><p>{prose(20, i)}</p></article>") for i in range(12)]
    story = [("http://site/s/%d" % i, PAGE % f"<article><h1>Story</h1><div class=story-17><p>{prose(30, 99)}</p></div></article>") for i in range(5)]
    same = [(u % i, f"<body><div class=text><p>{prose(20, 7)}</p></div></body>") for u in ("http://same/%d", "%d") for i in range(9)]
    few = [("http://same/few/%d" % i, f"<body><div class=text><p>{prose(20, 40 + i)}</p></div></body>") for i in range(3)]
    text = {r.page_id: r.text for r in style_tree.extract(pages_of(spark, *other, *story, *same, *few)).collect()}
    assert [text[i] for i in range(12, 17)] == ["Story\n" + prose(30, 99)] * 5
    assert [text[i] for i in range(17, 35)] == [prose(20, 7)] * 18
    assert [text[35 + i] for i in range(3)] == [prose(20, 40 + i) for i in range(3)]


def test_tree_decides_every_block(spark):
    """Paragraphs and text outside an article go or stay by importance, headings with what is around them."""
    rows = [(f"http://site/{i}", PAGE % f"<article><h2>Parts</h2><p class=lead>Read us daily</p><p>{prose(20, i)}</p></article>") for i in range(12)]
    rows += [(f"http://out/{i}", PAGE % f"<article><p>Card {i}</p></article><div class=body><p>{prose(30, i)}</p></div><div class=x>{prose(3, i)}</div>") for i in range(12)]
    rows += [(f"http://same/{i}", PAGE % f"<article><p>Card {i}</p></article><div class=body><p>{prose(30, 1)}</p></div>") for i in range(12)]
    text = {r.page_id: r.text for r in style_tree.extract(pages_of(spark, *rows)).collect()}
    for i in range(12):
        assert text[i] == f"Parts\n{prose(20, i)}"
        assert text[12 + i] == f"Card {i}\n{prose(30, i)}"
        assert text[24 + i] == f"Card {i}"


def test_names_do_not_wipe_articles(spark):
    """Whole words of a class, an article in a doubtful branch, and importance of a doubtful branch that holds most text."""
    p = "<p>%s</p>" % prose(30, 3)
    held = [
        f"<div class='layout has-sidebar no-comments'><article>{p}</article></div>",
        f"<form id=aspnetForm><main>{p}</main><div class=share>tell</div></form>",
        f"<div class=widget><article>{p}</article></div>",
        f"<article><div class='elementor-widget-container'>{p}</div><div class='cookie-notice'>ok</div></article>",
        f"<article><div class='related'>{p}</div><p>end</p></article>",
        f"<body class='search-open'><form><div>{p}</div></form></body>",
    ]
    rows = [(f"http://h{i}/", h) for i, h in enumerate(held)]
    rows += [("http://cards/", f"<body>loose<article>{p}</article><div class=related><article>card</article></div>")]
    rows += [(f"http://low/{i}", f"<article><div class=notice><p>{prose(30, 1)}</p></div><p>{i}</p></article>") for i in range(9)]
    text = {r.page_id: r.text for r in style_tree.extract(pages_of(spark, *rows)).collect()}
    assert [text[i] for i in range(7)] == [prose(30, 3) + ("\nend" if i == 4 else "") for i in range(7)]
    assert [text[7 + i] for i in range(9)] == [str(i) for i in range(9)]


def test_importance_is_entropy(spark):
    rows = [("http://h/%d" % i, f"<body><div class=a>{'x' if i < 6 else 'y' if i < 8 else i}</div></body>") for i in range(10)]
    tree = style_tree.style_tree(pages_of(spark, *rows)).where("pages = 10").collect()
    share = [0.6, 0.2, 0.1, 0.1]
    assert max(r.importance for r in tree) == pytest.approx(-sum(p * math.log(p) for p in share) / math.log(10))


@needs_data
def test_sql_counterparts(spark):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in ORACLE.items():
        df, result = QUERIES[name](spark, SF), con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    assert len(kept) == len(set(kept)) > 0
    text = {r.doc_id: r.text for r in docs.collect()}
    # Each stage by itself, on what the ones before it kept.
    frame, left = docs, set(text)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, frame, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert done.columns == docs.columns
        now = [r.doc_id for r in done.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= left
        if name == "n-gram Jaccard join":
            groups = brute_components([(k, text[k]) for k in left])
            assert sorted(groups[k][1] for k in now) == sorted({c for _, c in groups.values()})
        if name == "benchmark decontamination":
            items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {k for k in left if any(i and i <= shingles(text[k]) for i in items)}
            assert not whole & set(now) and left - set(now) == whole
        frame, left = docs.where(F.col("doc_id").isin(now)), set(now)
    assert set(kept) == left
