"""Line dedup on many rows of one id, on very long documents, and its runs sized by rows."""

import time
from collections import Counter

import pytest

from geoloom.llm import line_dedup


def brute(rows, least=5, chars=40):
    keys = [[v.strip(" \t\n\x0b\x0c\r").lower() for v in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for ks in keys for k in set(ks) if len(k) >= chars)
    top = {}
    for (i, _), ks in zip(rows, keys):
        for k in ks:
            top[k] = max(top.get(k, -1), -1 if i is None else i)
    return [(i, "\n".join(v for v, k in zip((t or "").split("\n"), ks) if not (found[k] >= least and (-1 if i is None else i) < top[k]))) for (i, t), ks in zip(rows, keys)]


def test_many_rows_without_id(spark):
    """Ten thousand null ids hold lines in common with a document, with each other, and twice in themselves."""
    line = [f"line number {i} that stands in a great many documents of all" for i in range(40)]
    rows = [(None, f"own {i}\n{line[i % 40]}\nmiddle {i}\n{line[i * 7 % 40].upper()}\n{line[i % 40]}") for i in range(10_000)]
    rows += [(None, rows[3][1])] * 30 + [(7, "\n".join(line[:20])), (9, line[0]), (None, None), (8, "")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = lambda v: (v[0] is None, v[0] or 0, v[1])
    assert sorted(((r["doc_id"], r["kept"]) for r in got), key=order) == sorted(brute(rows), key=order)


def test_a_long_document_of_shared_lines(spark):
    lines = [f"shared line {i} of a document that is as long as a book, or two" for i in range(50_000)]
    rows = [(i, "\n".join(lines)) for i in range(6)] + [(9, "a line of its own that no other document has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 20
    assert got == {**{i: (50_000, 50_000) for i in range(5)}, 5: (50_000, 0), 9: (1, 0)}


def test_buckets_follow_rows(spark):
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    store = line_dedup.RunStore(spark, rows=95, bucket_lines=10)
    try:
        assert store.buckets == 10
        for base in (100, 0):
            store.add(spark.createDataFrame([(bytes([i]), base + i) for i in range(60)], "line binary, holder long"))
        plan = store.merged()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan
        assert {(r["n_docs"], r["top"] - r["line"][0]) for r in store.merged().collect()} == {(2, 100)}
    finally:
        store.close()
    assert spark.conf.get("spark.sql.shuffle.partitions") == tasks


@pytest.mark.parametrize("text", [None, "", "\n", "  \n\t"])
def test_texts_without_a_line(spark, text):
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text)] * 7, "doc_id long, text string")).collect()
    assert {(r["n_dropped"], r["kept"]) for r in got} == {(0, text or "")}
