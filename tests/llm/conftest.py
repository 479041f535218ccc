import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text)) with the other columns filled in."""

    def build(rows, **extra):
        full = [
            (i, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 5 else None, None if t is None else len(t))
            for k, (i, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture
def empty_documents(spark):
    return spark.createDataFrame([], DOCS)


AWKWARD = [
    (1, "Plain words in a row, and some more of them."),
    (1, "Plain words in a row, and some more of them."),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (None, "a text without an id"),
    (None, None),
    (5, "Ünïcödé Σ ΑΣ İ ß 漢字 \U0001f600 é \x00\x1c\x85 don't 12345"),
    (6, "word " * 30_000),
    (7, "a" * 50_000),
    (-8, "x"),
]


@pytest.fixture
def awkward(documents):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = ("fp score place epoch key row node first fingerprint component_id kept host path level0 tokens end text_hash").split()
    df = documents(AWKWARD)
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df
