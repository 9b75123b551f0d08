"""Findings of round 4 on corpus operators: settings that a session does not have."""

from geoloom.llm import line_dedup


def test_line_runs_in_a_session_without_partitions(spark):
    """a session that never set the shuffle partitions ended in INVALID_CONF_VALUE."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    line = "a line of more than forty characters that five documents have"
    spark.conf.unset(key)
    try:
        own = spark.conf.get(key)
        docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(5)], "doc_id long, text string")
        got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs).collect()}
        assert spark.conf.get(key) == own
    finally:
        spark.conf.set(key, before)
    assert got == {**{i: f"own {i}" for i in range(4)}, 4: f"{line}\nown 4"}
