"""Whole conversion of the second dialect."""

import json
import random

import pytest

from stepwell.operators import item_log, transcript

from test_convert import lines


def item(kind, **payload):
    return {"type": "response_item", "timestamp": "2025-01-01T00:00:00Z", "payload": {"type": kind, **payload}}


def event(kind, **payload):
    return {"type": "event_msg", "payload": {"type": kind, **payload}}


def said(role, *texts):
    return item("message", role=role, content=[{"type": "text", "text": t} for t in texts])


def done(i, kind="CommandExecution", turn=None, **more):
    return event("item_completed", turn_id=turn, item={"id": i, "type": kind, **more})


def script(i, turn=None):
    return item("custom_tool_call", call_id=i, name="exec", input="x()", internal_chat_message_metadata_passthrough={"turn_id": turn})


def output(i, text, kind="custom_tool_call_output"):
    return item(kind, call_id=i, output=text)


def count(**usage):
    return event("token_count", info={"last_token_usage": usage})


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_requests_become_steps(spark):
    got = item_log.convert_items(
        lines(
            spark,
            {"type": "turn_context", "payload": {"model": "m"}},
            said("developer", "a", "b"),
            count(input_tokens=9),  # nothing was put out: no request ends
            item("reasoning", summary=[{"text": "why"}, "so"]),
            item("function_call", call_id="c1", name="shell", arguments='{"z": 1, "a": [2]}'),
            said("assistant", "one"),
            count(input_tokens=5, output_tokens=0, cached_input_tokens=3, cache_write_input_tokens=2),
            output("c1", "Exit code: 3\nno", "function_call_output"),
            said("assistant", "two"),
            item("web_search_call", action={"type": "search", "query": "q"}),
            item("function_call", call_id="c9", name="never", arguments="{}"),
            said("user", "go"),
            output("zz", [{"type": "input_text", "text": "x"}, {"type": "input_image", "image_url": "http://a/b.png"}], "function_call_output"),
            output("zz", json.dumps({"output": "old", "metadata": {"exit_code": 0}}), "function_call_output"),
            "not json",
            {"type": "response_item", "payload": None},
        )
    )
    assert rows(got["steps"], "step_id", "source", "model_name", "message", "prompt_tokens", "completion_tokens", "cached_tokens", "cache_creation", "source_uuids") == [
        (1, "system", None, "ab", None, None, None, None, '["response_item:L2"]'),
        (2, "agent", "m", "one", 5, None, 3, 2, '["response_item:L5","response_item:L8","response_item:L6","response_item:L4"]'),
        (3, "agent", "m", "two", None, None, None, None, '["response_item:L9","response_item:L10"]'),
        (4, "user", None, "go", None, None, None, None, '["response_item:L12"]'),
        (5, "agent", "m", "", None, None, None, None, '["response_item:L13","response_item:L14","response_item:L9","response_item:L10"]'),
    ]
    assert rows(got["tool_calls"], "step_id", "tool_name", "tool_use_id", "tool_input") == [
        (2, "shell", "c1", '{"z":1,"a":[2]}'),
        (3, "web_search_call", "api_call_2_web_search_0", '{"action_type":"search","query":"q"}'),
        (5, "", "zz", "{}"),
        (5, "", "zz", "{}"),
    ]
    assert rows(got["tool_results"], "step_id", "tool_use_id", "content", "is_error", "exit_code") == [
        (2, "c1", "Exit code: 3\nno", True, 3),
        (3, "api_call_2_web_search_0", None, None, None),
        (5, "zz", "old", False, 0),
        (5, "zz", "x\n[image: http://a/b.png]", False, 0),
    ]


def test_scripts_and_their_calls(spark):
    got = item_log.convert_items(
        lines(
            spark,
            script("s1", "t"),
            done("n1", command=["bash", "-lc", "ls a"], exit_code=2, status="failed", aggregated_output="no", turn="t"),
            done("n2", "McpToolCall", turn="t", server="v", tool="w", arguments='{"k": 1}', status="completed", result={"content": [{"type": "text", "text": "yes"}]}),
            done("n3", exit_code=0, command=["x", "y z"], turn="other"),
            output("s1", "Script completed\n"),
            script("s2"),
            script("s3", "u"),
            done("n4", exit_code=1, command="c"),
            output("s2", "Script failed"),
            done("n5", exit_code=0, command="c", turn="u"),
            output("s3", "Script completed"),
            script("s4"),
            output("s4", [{"type": "text", "text": "Script running"}]),
            script("s5"),
            done("n1", exit_code=0),
            output("s5", [{"type": "text", "text": "Script completed"}]),
        )
    )
    flags = {r[0]: r[1:] for r in rows(got["tool_results"], "tool_use_id", "is_error", "exit_code", "content")}
    assert flags["s1"] == (True, 2, "Script completed\n") and flags["n1"] == (True, 2, "no") and flags["n2"] == (False, None, "yes")
    assert flags["s2"][:2] == (True, None) and flags["s3"][:2] == (None, None) and flags["s4"][:2] == (None, None) and flags["s5"][:2] == (False, 0)
    nested = [r for r in rows(got["tool_calls"], "tool_use_id", "tool_name", "tool_input") if r[0][0] == "n"]
    assert nested == [("n1", "exec_command", '{"cmd":"ls a"}'), ("n2", "mcp__v__w", '{"k":1}')]
    assert item_log.nested_call(json.dumps({"type": "CommandExecution", "command": ["x", "y z"]})) == ("exec_command", '{"cmd":"x \'y z\'"}', None)


def test_no_lines(spark):
    got = item_log.convert_items(lines(spark, "x").limit(0))
    assert [df.count() for df in got.values()] == [0, 0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_scripts_like_a_loop(spark, seed):
    rng = random.Random(seed)
    log, held = [], {}  # held: open scripts by call id
    names, claimed, doubtful = {}, {}, set()
    for k in range(120):
        what = rng.random()
        turn = rng.choice([None, "a", "b"])
        if what < 0.25:
            call = f"s{k}"
            log.append(script(call, turn))
            held[call] = turn
            names[k + 1] = call
        elif what < 0.5 and held:
            call = rng.choice(sorted(held))
            log.append(output(call, "Script completed"))
            del held[call]
        else:
            log.append(done(f"n{k}", exit_code=0, command="c", turn=turn))
            fit = [c for c, t in held.items() if None in (t, turn) or t == turn]
            if len(fit) == 1:
                claimed[f"n{k}"] = fit[0]
            doubtful |= set(fit) if len(fit) > 1 else set()
    want = {(c, n) for n, c in claimed.items() if c not in doubtful}
    _, made = item_log.outcomes(item_log.items(lines(spark, *log)))
    assert {(r.call_id, r.item_id) for r in made.collect()} == want


def test_items_in_one_window_like_a_loop(spark):
    rng = random.Random(4)
    windows = [(f"s{k % 3}", f"c{k}", at := rng.randrange(100), at + rng.randrange(-2, 12)) for k in range(30)]
    items = [(f"s{s}", line) for s in range(4) for line in range(0, 110, 2)]
    inside = {i: [c for s, c, a, b in windows if s == i[0] and a < i[1] < b] for i in items}
    got = transcript.nested_outcomes(spark.createDataFrame(windows, "session_id string, call_id string, opened long, closed long"), spark.createDataFrame(items, "session_id string, line long"))
    assert sorted(map(tuple, got.collect())) == sorted((*i, c[0]) for i, c in inside.items() if len(c) == 1)
