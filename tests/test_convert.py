"""Raw records of both dialects."""

import base64
import json

from stepwell.operators import convert, passes


def lines(spark, *records):
    rows = [("s", "main.jsonl", 0, k + 1, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "session_id string, source_file string, file_rank int, line int, value string")


def record(kind, uuid, second, message=None, **more):
    return {"type": kind, "uuid": uuid, "timestamp": f"2025-01-01T00:00:{second:02}.000Z", "message": message, **more}


def test_first_dialect(spark):
    use = lambda i, n="Bash": {"type": "tool_use", "id": i, "name": n, "input": {"z": 1, "a": 2}}
    got = convert.convert(
        lines(
            spark,
            record("user", "u1", 1, {"role": "user", "content": " hello \n"}),
            record("assistant", "a1", 2, {"id": "m1", "model": "x", "content": [{"type": "text", "text": "one"}, use("c1")], "usage": {"input_tokens": 1, "output_tokens": 1}}),
            record("assistant", "a2", 3, {"id": "m1", "content": [{"type": "text", "text": "two"}, use("c1"), use("c2")], "usage": {"input_tokens": 5, "cache_read_input_tokens": 7, "output_tokens": 9}}),
            record("user", "u2", 4, {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "Exit code 3\nno", "is_error": True}]}),
            record("user", "u3", 5, {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "again"}, {"type": "tool_result", "tool_use_id": "zz", "name": "Read", "content": "orphan"}, {"type": "tool_result", "tool_use_id": "yy", "content": "nameless"}]}),
            record("user", "u1", 6, {"content": "a second record with that uuid"}),
            record("user", "u4", 7, {"content": [{"type": "text", "text": "  "}]}),
            "not json",
        )
    )
    steps = [tuple(r) for r in got["steps"].select("step_id", "source", "message", "prompt_tokens", "completion_tokens", "source_uuids").orderBy("step_id").collect()]
    assert steps == [(1, "user", " hello \n", None, None, '["u1"]'), (2, "agent", "one\n\ntwo", 12, 9, '["a1","a2"]'), (3, "agent", "", None, None, '["u3"]')]
    calls = {tuple(r) for r in got["tool_calls"].select("step_id", "tool_use_id", "tool_name", "tool_input").collect()}
    assert calls == {(2, "c1", "Bash", '{"z":1,"a":2}'), (2, "c2", "Bash", '{"z":1,"a":2}'), (3, "zz", "Read", "{}")}
    results = {tuple(r) for r in got["tool_results"].select("step_id", "tool_use_id", "content", "is_error", "exit_code").collect()}
    assert results == {(2, "c1", "Exit code 3\nno", True, 3), (3, "zz", "orphan", None, None)}
    assert passes.dangling_results(got["tool_results"], got["tool_calls"]).count() == 0


def test_events_are_bounded(spark):
    got = convert.session_events(lines(spark, {"type": "mode", "sessionId": "s", "mode": "plan"}, {"type": "system", "subtype": "api_error", "uuid": "e", "timestamp": "t", "error": "x" * 9000}, {"type": "system", "subtype": "other"}, {"type": "attachment", "attachment": {"type": "hook_ok", "toolUseID": "c", "k": list(range(5000))}})).orderBy("seq").collect()
    assert [(r.seq, r.event_type, r.subtype, r.tool_use_id, r.payload_truncated) for r in got] == [(0, "mode", None, None, False), (1, "system", "api_error", None, True), (2, "attachment", "hook_ok", "c", True)]
    assert got[0].payload == '{"mode":"plan"}' and len(json.loads(got[1].payload)["error"]) == 2049 and got[1].payload_bytes > 9000
    assert json.loads(got[2].payload)["k"] == list(range(32))
    wide = convert.bounded({str(k): "y" * 3000 for k in range(20)})
    assert wide[2] and len(wide[0].encode()) < 9000 and "truncated_preview" in wide[0]


def test_second_dialect(spark):
    rows = lines(
        spark,
        {"type": "session_meta", "payload": {"id": "x"}},
        {"type": "response_item", "ordinal": 4, "payload": {"type": "message", "role": "user"}},
        {"type": "response_item", "payload": {"type": "function_call", "call_id": "c"}},
        {"type": "event_msg", "payload": {"id": "x", "type": "turn_aborted", "why": "w"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5, "output_tokens": 0}, "total_cost": 0}}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
    )
    edges = [(r.uuid, r.type) for r in convert.item_edges(rows).orderBy("line").collect()]
    assert edges == [("x", "session_meta"), ("response_item:4", "user"), ("response_item:L3", "function_call"), ("event_msg:L4", "event:turn_aborted"), ("event_msg:L5", "event:token_count"), ("event_msg:L6", "event:token_count")]
    [event] = convert.item_events(rows).collect()
    assert (event.uuid, event.subtype, event.payload) == ("event_msg:L4", "turn_aborted", '{"id":"x","why":"w"}')
    assert tuple(convert.item_metrics(rows).first())[1:] == (5, None, None, 0.0)


def test_blobs(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (3).to_bytes(4) + (4).to_bytes(4)
    text = base64.b64encode(png).decode()
    refs, data = convert.blobs(spark.createDataFrame([(1, "image/png", text), (2, "image/png", text), (3, "text/plain", "not base64!"), (4, "image/png", None)], "step_id long, media_type string, text string"))
    assert sorted((r.step_id, r.bytes, r.width, r.height) for r in refs.collect()) == [(1, 24, 3, 4), (2, 24, 3, 4)]
    assert [bytes(r.data) for r in data.collect()] == [png]
