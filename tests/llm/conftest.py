import pytest

#: Nulls, empty and odd texts, ties, repeated rows, one long text, and extra columns whose names clash with the operators' own.
TRICKY = [
    (1, "the quick brown fox jumps over the lazy dog again and again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again and again"),
    (3, None),
    (4, ""),
    (5, "  \n\t "),
    (6, "word"),
    (7, "Über naïve café — 東京 😀 ﬁ"),
    (None, "a text without an id"),
    (8, "as " * 500),
    (9, "x" * 5000),
    (10, " ".join(f"w{i % 997}" for i in range(8000))),
]

#: Names that the operators use themselves.
CLASHING = "hash copy copies rate order_key mixed drawn row key root node n fp hashes sha no spans passages found name dir path statements best license how inherited text_lang range next head edited fingerprint score x y piece start length offset".split()


@pytest.fixture(scope="session")
def tricky(spark):
    rows = [(i, t, "en" if n % 2 else None, None if n == 3 else f"s{n % 3}", None, *[f"{c}{n}" for c in CLASHING]) for n, (i, t) in enumerate(TRICKY)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
