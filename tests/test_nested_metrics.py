"""Nested answers, payload guards and the metrics log."""

import json

import pytest

from skein.graph import payload
from skein.operators import metrics, nested
from skein.streaming.metrics import ROW, MetricsLog


def test_fields_are_collected_at_every_depth(spark):
    body = {"id": "a", "rows": [{"path": "p.py", "more": {"node_id": "b"}}, [{"src": "c"}]], "n": 3, "deep": {"d": {"d": {"d": {"d": {"id": "too deep"}}}}}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, '[{"id": "x"}, 4]'), (4, None)], "answer int, body string")
    got = {(r.answer, r.id, r.path) for r in nested.touched(df).collect()}
    assert got == {(1, "a", None), (1, None, "p.py"), (1, "b", None), (1, "c", None), (3, "x", None)}
    nodes = spark.createDataFrame([("a", "one.py"), ("b", "p.py")], "id string, file_path string")
    files = spark.createDataFrame([("one.py", 40_000), ("p.py", 8_000)], "path string, size_bytes long")
    cost = {r.answer: r.raw_tokens for r in metrics.impact(df, nested.touched(df), nodes, files).collect()}
    assert cost[1] == 12_000 and cost[2] == 1200


def test_payloads_with_source_at_any_depth_are_refused(spark):
    rows = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "row string")
    fine = rows({"id": 1, "list": [{"name": "source"}]}, {"a": {}})
    assert nested.guard(fine).count() == 2
    for bad in ({"a": [[{"b": {"Source": "x"}}]]}, {"context_line": None}):
        with pytest.raises(nested.Leak):
            nested.guard(rows({"id": 1}, bad))
    nodes = spark.createDataFrame([("a", 1, ("x",))], "id string, flags int, more struct<text:string>")
    with pytest.raises(ValueError):
        payload(nodes, nodes.select("id"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log = MetricsLog(spark, str(tmp_path / "m"))
    assert log.status().first()[:3] == (0, 0, 0)
    rows = lambda a, b: spark.sql(f"select concat('i', id) as id, 's' as session, concat('t', id % 2) as tool_name, timestamp_seconds(id) as ts, 100L as raw_tokens, 10L as optimized_tokens, 90L as tokens_saved, 2.0D as duration_ms from range({a}, {b})")
    for _ in range(2):
        log.append(rows(0, 4), 0)
    log.append(rows(3, 6), 1)  # an id that came before counts once
    assert [r.id for r in log.unsynced(2).collect()] == ["i0", "i1"] and log.status().first()[:3] == (6, 0, 6)
    for _ in range(2):
        log.mark_synced(rows(0, 2), 0)
    first = log.invocations().where("synced").agg({"synced_at": "max"}).first()[0]
    assert log.status().first() == (6, 2, 4, first) and [r.id for r in log.unsynced(2).collect()] == ["i2", "i3"]
    assert [tuple(r) for r in log.session_totals("s").collect()] == [("t0", 3, 270, 2.0), ("t1", 3, 270, 2.0)]
    assert metrics.report(log.invocations())[2].first().pending == 4
    log.reset()
    assert log.status().first()[:3] == (0, 0, 0)


def test_a_stream_is_stored_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select concat('i', id) as id, 's' as session, 't' as tool_name, timestamp_seconds(id) as ts, 1L as raw_tokens, 1L as optimized_tokens, 0L as tokens_saved, 1.0D as duration_ms from range(5)").write.parquet(str(src))
    log = MetricsLog(spark, str(tmp_path / "m"))
    for checkpoint in ("c1", "c1", "c2"):  # started again, and replayed from the start without its checkpoint
        log.sink(spark.readStream.schema(ROW).parquet(str(src)), str(tmp_path / checkpoint), None).awaitTermination()
    assert log.status().first()[:3] == (5, 0, 5)
