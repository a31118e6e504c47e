import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of the driver's columns from texts, or from (doc_id, text, source)."""

    def build(rows, extra: bool = False):
        rows = [r if isinstance(r, tuple) else (i, r, f"s{i % 3}") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
        if extra:  # names that operators use themselves
            for c in ("size", "key", "h", "score", "count", "sig", "copies", "_id", "start"):
                df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return build


#: Null, empty and odd texts, ties, repeated rows and a very long one.
ODD = [
    (0, None, None), (1, "", "a"), (2, "   \n\t", "a"), (3, "one", "a"), (4, "Hello World again my friend of old", "b"), (4, "Hello World again my friend of old", "b"), (5, "Hello World again my friend of old", None),
    (None, "a null id has words too, and more", "c"), (6, "é ü 日本語   \x1c x", "c"), (7, "x" * 50_000, "a"), (8, "word " * 40_000, "b"), (9, "a\x00b <|endoftext|> 'S don't", "b"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
