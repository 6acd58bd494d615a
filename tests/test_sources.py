"""Readers on odd input: cut-off lines, chains that go wrong, query blocks."""

import json

import pytest
from pyspark.sql import functions as F

from memlake.operators import vectors as vx
from memlake.sources import files as fi


def test_transcripts_of_both_dialects(spark, tmp_path):
    lines = {
        "a": [{"type": "user", "message": {"content": "plain words"}}, "{broken", {"type": "assistant", "message": {"content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "one"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/x"}}, {"type": "text", "text": "two"}]}},
            {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "gone", "is_error": True}]}}, {"type": "tool_result", "tool_use_id": "t2", "content": "late", "is_error": False}, "", '{"type": "user", "mes'],
        "b": [{"type": "session_meta", "payload": {"id": "s"}}, {"type": "response_item", "payload": {"type": "function_call", "name": "exec", "arguments": "{\"c\": 1}", "call_id": "k1"}},
              {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "k1", "output": {"is_error": True}}}, {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "why"}]}}, [1, 2]]}
    rows = [(f, i + 1, x if isinstance(x, str) else json.dumps(x)) for f, xs in lines.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "file string, line bigint, value string").repartition(4).write.json(str(tmp_path / "bundle"))
    back = fi.read_bundles(spark, str(tmp_path / "bundle"))
    records = fi.transcript_records(back)
    got = {(r.file, r.line): r for r in records.collect()}
    assert sorted(got) == [("a", i) for i in (1, 2, 3, 4, 5, 7)] + [("b", i) for i in range(1, 6)]
    a3, b2, b3 = got["a", 3], got["b", 2], got["b", 3]
    assert (a3.role, a3.text, a3.thinking, [tuple(c) for c in a3.calls]) == ("assistant", "one\n\ntwo", "hm", [("t1", "Read", '{"file_path":"/x"}')])
    assert got["a", 1].text == "plain words" and not got["a", 2].ok and got["a", 2].text is None
    assert [tuple(x) for x in got["a", 4].results] == [("t1", "gone", True)] and [tuple(x) for x in got["a", 5].results] == [("t2", "late", False)]
    assert b2.dialect_b and [tuple(c) for c in b2.calls] == [("k1", "exec", '{"c": 1}')] and [x.id for x in b3.results] == ["k1"] and b3.results[0].is_error
    assert got["b", 4].thinking == "why"
    cover = {r.file: (r.records, r.malformed, r.trailing_bytes) for r in fi.transcript_coverage(back, records).collect()}
    assert cover["a"] == (6, 2, 21) and cover["b"][0] == 5


def test_export_branches(spark):
    def export(current, nodes):
        mapping = {n: {"parent": p, "message": {"id": n, "author": {"role": "user"}, "content": {"content_type": "text", "parts": [f"text {n}"]}}} for n, p in nodes.items()}
        return json.dumps({"conversation_id": current or "none", "current_node": current, "mapping": mapping})

    docs = [export("c", {"a": None, "b": "a", "c": "b", "x": "a"}), export("loop", {"loop": "p", "p": "loop"}), export("gap", {"gap": "missing"}), export(None, {"a": None}), export("z", {}), "{", None]
    got = fi.messages_b(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()
    assert sorted((r.conversation_id, r.depth, r.node, r.text) for r in got) == [("c", 1, "a", "text a"), ("c", 2, "b", "text b"), ("c", 3, "c", "text c")]


def test_queries_meet_all_rows_in_blocks(spark):
    rows, queries = spark.range(5).withColumnRenamed("id", "r"), spark.range(7).withColumnRenamed("id", "q")
    want = sorted((r, q) for r in range(5) for q in range(7))
    for block in (2, 100):
        assert sorted(map(tuple, vx.against_all(rows, queries, block).collect())) == want
    assert vx.against_all(rows, queries.limit(0)).count() == 0
    with pytest.raises(ValueError, match="block"):
        vx.against_all(rows, queries.withColumn("wide", F.lit("x" * (9 << 20))), 100)
