import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Words that no list of the operators knows.
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north otter plain quill ridge stone thorn umber vale willow yarrow zephyr".split()


def prose(n, seed=0):
    """n words, differing by seed."""
    return " ".join(WORDS[(i * 7 + seed * (i % 11 + 3)) % len(WORDS)] + ("s" if (i + seed) % 3 else "") + str((i * seed) % 17) for i in range(n))


@pytest.fixture
def make_docs(spark):
    def make(*texts, partitions=3):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).repartition(partitions)

    return make


@pytest.fixture
def odd_docs(spark):
    """Null keys, null and empty texts, a very long text, repeated rows, and columns that clash with results."""
    long = " ".join(prose(50, s) for s in range(400))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a null key"), (4, long), (5, prose(40, 3)), (5, prose(40, 3)), (6, prose(40, 3)), (7, "漢字 é ñandú \x00 x"), (8, "\U0001f600 b")]
    return spark.createDataFrame([(k, t, 9.0, 9, 9, "x", b"y", -1) for k, t in rows], "doc_id bigint, text string, score double, n_words int, component_id int, labels string, tokens binary, class int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
