"""The registered corpus queries against their SQL, and the pipeline's stages against their definitions."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from geoloom.llm import common, decontam, oracles, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, con, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontaminate", "mix_sources", "token_output"]


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    columns, start = docs.columns, docs.count()
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(common.materialize(stage(spark, kept[-1], SF)))
    assert all(k.columns == columns for k in kept[1:5])
    assert kept[1].count() == start  # all of these documents are in the four languages
    left = simhash.near_duplicates(kept[2])
    assert left.count() == left.select("component_id").distinct().count()
    assert decontam.contained_items(kept[3], queries.table(spark, SF, "benchmark")).isEmpty()
    gone = {r[0] for r in kept[2].select("doc_id").exceptAll(kept[3].select("doc_id")).collect()}
    assert gone == {r[0] for r in decontam.contained_items(kept[2], queries.table(spark, SF, "benchmark")).select("doc_id").distinct().collect()}
    assert kept[5].count() == kept[4].count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.materialize(stage(spark, empty, SF))
    assert empty.isEmpty()
