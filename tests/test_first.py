"""First record per id from a stream: statuses, restart, forgotten ids."""

from __future__ import annotations

import time
from datetime import datetime

from sigtide.session import scratch_path
from sigtide.streaming import run_first_records
from sigtide.streaming.first import STORE

KIND = "id string, timestamp timestamp, body string, status_code int, tags array<string>, m struct<a: int>"


def _at(hour):
    return None if hour is None else datetime(2024, 1, 1, hour)


def _land(spark, landed, rows):
    """Rows in any number of tasks, so their order within the batch says nothing."""
    spark.createDataFrame([(i, _at(h), body, 1, ["x", None], (7,)) for i, h, body in rows], KIND).repartition(
        3, "body").write.mode("append").parquet(landed)


def _run(spark, landed, path, state, **options):
    rows = spark.readStream.schema(KIND).parquet(landed)
    run_first_records(rows, path, state, **options).awaitTermination()


def test_statuses_over_restarts(spark):
    landed, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    before = spark.conf.get(STORE, None)
    _land(spark, landed, [("a", 5, "a5"), ("a", 4, "a4"), ("a", 4, "a4-"), ("b", None, "b"), ("c", None, "c"),
                          ("c", 9, "c9"), (None, 1, "n1"), (None, 1, "n1"), ("", 2, "empty"), ("z", 3, None)])
    _run(spark, landed, path, state)
    _land(spark, landed, [("a", 3, "a3"), ("a", 6, "a6"), ("a", None, "a?"), ("b", 8, "b8"), ("d", 1, "d"),
                          ("d", 1, "d"), ("c", 9, "c9"), (None, 2, "n2")])
    _run(spark, landed, path, state)
    got = spark.read.parquet(path)
    assert sorted((r["id"] or "-", r["body"] or "-", r["status"]) for r in got.collect()) == sorted([
        ("a", "a4", "first"), ("a", "a4-", "repeat"), ("a", "a5", "repeat"), ("b", "b", "first"),
        ("c", "c9", "first"), ("c", "c", "repeat"), ("-", "n1", "unkeyed"), ("-", "n1", "unkeyed"),
        ("-", "empty", "first"), ("z", "-", "first"), ("a", "a3", "late"), ("a", "a6", "repeat"),
        ("a", "a?", "repeat"), ("b", "b8", "late"), ("d", "d", "first"), ("d", "d", "repeat"),
        ("c", "c9", "repeat"), ("-", "n2", "unkeyed")])
    row = got.where("body = 'a4'").head()
    assert (row["timestamp"], row["tags"], row["m"]["a"]) == (_at(4), ["x", None], 7)
    assert spark.conf.get(STORE, None) == before


def test_a_batch_run_again_replaces_itself(spark):
    """The same files through a lost checkpoint: batch 0 is written anew, nothing is doubled."""
    landed, path = scratch_path(spark, "in"), scratch_path(spark, "out")
    _land(spark, landed, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    for _ in range(2):
        _run(spark, landed, path, scratch_path(spark, "state"))
    assert sorted((r["body"], r["status"]) for r in spark.read.parquet(path).collect()) == [
        ("x", "first"), ("y", "repeat"), ("z", "first")]


def test_forgotten_ids_are_first_again(spark):
    landed, path, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    _land(spark, landed, [("a", 1, "x")])
    _run(spark, landed, path, state, ttl=1)
    time.sleep(2)
    _land(spark, landed, [("a", 2, "y")])
    _run(spark, landed, path, state, ttl=1)
    assert {r["body"]: r["status"] for r in spark.read.parquet(path).collect()} == {"x": "first", "y": "first"}
