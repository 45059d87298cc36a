from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableprep.llm import line_runs

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "this line stands in many of the documents, more or less"


def expected(rows, least_docs=5, least_chars=40):
    """(id, n_lines, n_dropped, kept text) by reading all rows at once."""
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {line.strip(BLANKS).translate(LOWER) for line in (text or "").split("\n")}:
            holders[key].append(doc_id)
    out = []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = line.strip(BLANKS).translate(LOWER)
            ids = holders[key]
            last = max((i for i in ids if i is not None), default=None)
            if len(key) < least_chars or len(ids) < least_docs or doc_id == last:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def report(docs, **options):
    return found(line_runs.line_report(docs, **options).select("doc_id", "n_lines", "n_dropped", "kept_text"))


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


CASES = [
    *[(i, f"own {i}\n {LINE.upper()}\t\nend") for i in range(10, 16)],
    (16, f"{LINE}\n{LINE}\nmiddle\n{LINE}"), (17, LINE), (18, f"{LINE}\r\n\n"), (19, "\n"), (20, "\n\n\n"),
    *[(i, "É" * 39 + "x") for i in range(30, 35)], *[(i, "é" * 39 + "x") for i in range(35, 39)],
    *[(i, "y" * 39) for i in range(40, 50)], *[(i, "  " + "z" * 40 + " ") for i in range(50, 54)], (54, "z" * 40 + " "), (55, "z" * 40),
    *[(None, "a line that only rows without an id hold, five times\nx")] * 5,
    *[(None, LINE)] * 3, *[(60, "a line that stands five times in rows that all have one id")] * 5,
    *[(61, f"short\n{'twice in one document, so it counts once only' * 2}\n{'twice in one document, so it counts once only' * 2}")] * 2,
    (70, None), (71, ""), (72, "\n".join(f"{LINE}\nline number {i} of a document that has very many of them" for i in range(20_000))),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 3), (7, 2)])
def test_cases(spark, batches, fanout):
    assert report(made(spark, CASES), batches=batches, fanout=fanout) == expected(CASES)


def test_edge_rows(edge_docs, edge_rows):
    rows = [(i, t) for i, t, *_ in edge_rows]
    assert report(edge_docs) == expected(rows)
    assert report(edge_docs, least_docs=2, least_chars=10) == expected(rows, 2, 10)


def test_no_rows(no_docs):
    assert report(no_docs) == []


def test_documents(documents, document_rows):
    assert report(documents) == expected([(i, t) for i, t, *_ in document_rows])


def test_cleaned_documents_keep_their_columns(spark, edge_docs):
    cleaned = line_runs.drop_recurring_lines(edge_docs, least_docs=2, least_chars=10)
    assert cleaned.columns == edge_docs.columns and cleaned.count() == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect() if r["doc_id"] in (3, 4, 6, 7)}
    assert texts[3] is None and texts[4] == "" and texts[6] == "" and texts[7]
    clashing = made(spark, CASES).withColumns({c: F.lit(c) for c in ("id", "mark", "positions", "n_lines", "n_dropped", "kept_text", "__id")})
    assert line_runs.drop_recurring_lines(clashing).columns == clashing.columns


def test_a_batch_is_first_with_what_no_earlier_one_holds(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    seen: set[bytes] = set()
    docs = defaultdict(int)
    for batch in range(7):
        keys = [hashlib.md5(str(k % 23).encode()).digest() for k in range(batch * 5, batch * 5 + 12)]
        lines = spark.createDataFrame([(bytearray(k), 100 - batch, True) for k in keys], "key binary, id long, fresh boolean")
        own = runs.add(lines)
        assert {bytes(r["key"]) for r in own.where("first").collect()} == set(keys) - seen
        seen |= set(keys)
        for k in keys:
            docs[k] += 1
        assert sum(len(level) for level in runs.levels) <= 3
    assert {bytes(r["key"]): r["docs"] for r in runs.totals().collect()} == docs
    runs.forget()


def test_plan_has_no_python(spark):
    plan = line_runs.line_report(made(spark, CASES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
