import public_tokenizers
import pytest

WORDS = public_tokenizers.path("word_bpe_49k.json")

# Columns whose names the operators use themselves.
CLASHING = [
    ("keep_id", "int", 1), ("kept", "boolean", True), ("_hash", "string", "x"), ("_id", "double", 2.5),
    ("id", "string", "a"), ("size", "int", 3), ("_spans", "string", None), ("n", "int", 4),
]


@pytest.fixture(scope="session")
def words():
    return WORDS


@pytest.fixture(scope="session")
def frame(spark):
    """documents-like rows (doc_id, text) with clashing extra columns."""

    def make(rows, extra=True):
        columns = CLASHING if extra else []
        schema = ", ".join(["doc_id long", "text string", *(f"{name} {kind}" for name, kind, _ in columns)])
        return spark.createDataFrame([(*row, *(value for _, _, value in columns)) for row in rows], schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")


ODD = [
    (None, None),
    (None, "alone without an id but with quite a few words in it"),
    (7, None),
    (6, ""),
    (5, " \t\n"),
    (4, "same same text"),
    (3, "same  same\ntext"),
    (3, "same  same\ntext"),
    (9, "x" * 300_000),
    (8, "word " * 50_000),
    (10, "a　b <|endoftext|> Ünïcode 𝒳 İ"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
