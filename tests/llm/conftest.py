from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SF_DIR = "/root/testdata/sf0.001"
# Names that operators use inside: an input may have them too.
CLASHING = ["id", "row_hash", "fingerprint", "kept", "copies", "salt", "score", "tag", "node", "size", "times", "bands", "words", "key", "host"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)

LONG = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again", "en", "a"),
    (2, "THE quick brown fox jumps over the lazy dog again", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", None, "b"),
    (6, LONG, "en", None),
    (7, LONG, "en", "b"),
    (8, "x" * 5000, "de", "c"),
    (9, "Ünïcode ▁ text 😀 　 ends", "de", "c"),
    (10, "1234 5678 !!! ###", "fr", "c"),
    (11, f"before {PASSAGE} after", "fr", "d"),
    (12, f"{PASSAGE} then something else entirely", "fr", "d"),
    (13, PASSAGE, "fr", "a"),
    (13, PASSAGE, "fr", "a"),
    (14, PASSAGE.upper(), "fr", "a"),
    (None, "no id here but words enough to count for something", "en", "a"),
    (None, "no id here but words enough to count for something", "en", "a"),
]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids."""
    return list(TEXTS)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The edge rows with extra columns whose names operators use inside."""
    rows = [(*r, None if r[1] is None else len(r[1]), *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
