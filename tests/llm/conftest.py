import pytest

# Names that operators use inside, here as columns of the input.
CLASHING = ("row int, part int, ids string, kept boolean, key string, bucket int, node long, host string, rule string, "
            "label int, component_id long, h0 long, rejected_id long, text_hash long")


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang, source) rows as documents, with many extra columns."""

    def build(rows):
        width = CLASHING.count(",") + 1
        return spark.createDataFrame(
            [(i, t, "en", s, len(t or ""), *[None] * width) for i, t, s in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, " + CLASHING)

    return build


LONG = "word, Another ÉTÉ " * 30_000
EDGE = [
    (3, None, "a"), (4, "", "a"), (5, "  \n\t ", "a"), (6, "one", None), (7, "a b c d", "b"), (8, "A B C D", "b"),
    (9, "x y z x y z x y z x y z", "b"), (9, "x y z x y z x y z x y z", "b"), (10, LONG, "c"),
    (11, "don't <|endoftext|> STOP 12ab,, ñandú ΣΑΣ é", "c"), (12, "日本語のテキスト 한국어 \U0001f600!", "c"),
    (None, "no id at all here", "c"), (13, "line one\nline two\nline one\n\n#$% |", "a"), (9, "another text, same id", "b"),
]


@pytest.fixture(scope="session")
def edge(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table, and its rows sorted by doc_id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
