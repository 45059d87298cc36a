from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from tableprep.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = filter_audit.COUNTS


def fails(text):
    words = WORDS.findall(text)
    return {
        c for c, bad in (
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)), ("D", re.search(r"[#$%&*|]", text)),
        ) if bad
    }


def expected(rows, labels):
    """The audit by applying the filters of every order to every document in turn."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    docs = []
    for doc_id, text, lang in rows:
        bad = fails(text or "")
        if doc_id is not None and doc_id > least[text or ""]:
            bad.add("E")
        docs.append((lang or "", bad, doc_id in good, doc_id in toxic))
    counts, shapley = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                row = counts[part, "".join(order), step]
                for own, bad, is_good, is_toxic in docs:
                    if own != part:
                        continue
                    alive, failing = not bad & set(order[: step - 1]), letter in bad
                    for name, holds in (
                        ("kept", alive and not failing), ("removed", alive and failing), ("redundant", failing and not alive),
                        ("unique_fails", bad == {letter}), ("good_lost", alive and failing and is_good), ("toxic_lost", alive and failing and is_toxic),
                    ):
                        row[name] += holds
                shapley[part, letter] += row["removed"]
    return sorted((*k, *(v[c] for c in COUNTS), shapley[k[0], k[1][k[2] - 1]]) for k, v in counts.items())


def audited(docs, labels):
    rows = filter_audit.audit(docs, labels).select("part", "filter_order", "step", *COUNTS, "shapley").collect()
    return sorted(tuple(r) for r in rows)


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (6, None, 1), (7, 1, None), (13, 1, 0), (99, 1, 1), (None, 1, 1)]
LABEL_SCHEMA = "doc_id long, quality int, toxic int, text string, n int"


def test_edge_rows(spark, edge_docs, edge_rows):
    labels = spark.createDataFrame([(*r, "x", 1) for r in LABELS], LABEL_SCHEMA)
    rows = [(i, t, lang) for i, t, lang, _ in edge_rows]
    found = audited(edge_docs, labels)
    assert found == expected(rows, LABELS)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_groups_of_copies(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(i % 300, text if i % 3 else f"{text} {i % 7}", ("en", None, "")[i % 3 - 1]) for i in range(900)]
    rows += [(None, text, "en")] * 5 + [(500 + i, "A" * i, "de") for i in range(20)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = audited(docs, spark.createDataFrame([(i, q, int(t), "", 0) for i, q, t in labels], LABEL_SCHEMA))
    assert found == expected(rows, labels)


def test_no_rows(spark, no_docs, edge_docs, edge_rows):
    none = spark.createDataFrame([], LABEL_SCHEMA)
    assert audited(no_docs, none) == []
    assert audited(edge_docs, none) == expected([(i, t, lang) for i, t, lang, _ in edge_rows], [])


def test_orders_are_all():
    assert len(set(filter_audit.orders("ABCDE"))) == 120


def test_plan_has_no_python(spark, edge_docs):
    plan = filter_audit.audit(edge_docs, spark.createDataFrame([], LABEL_SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
