"""A small corpus on disk: readers, views, lake, streaming, sandbox."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stepwell import schemas
from stepwell.operators import passes, views
from stepwell.plans import sandbox
from stepwell.sources.corpus import Corpus, is_session_id
from stepwell.sources.lake import Lake
from stepwell.streaming import incremental


def step(i, source, message, **more):
    return {"step_id": i, "timestamp": f"2025-01-01T00:0{i}:00.5+02:00", "source": source, "message": message, **more}


STEPS = [
    step(1, "user", "<command-name>/plug:go</command-name><command-args>x</command-args>", extra={"source_uuids": ["u1"], "images": [{"sha256": "abcd", "media_type": "image/png", "bytes": 3, "width": 1, "height": 2, "extension": "png"}]}),
    step(2, "user", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}], extra={"source_uuids": ["u2"]}),
    step(3, "agent", '[not "message": [an array', model_name="claude-opus-5-20250101", metrics={"prompt_tokens": 1000, "completion_tokens": 10, "cached_tokens": 100, "extra": {"cache_write_input_tokens": 5}},
         tool_calls=[{"tool_call_id": "c1", "function_name": "TodoWrite", "arguments": {"todos": [{"content": "a", "status": "pending"}, {"content": "a", "status": "completed", "activeForm": "f"}]}},
                     {"tool_call_id": "c2", "function_name": "Task", "arguments": {"subagent_type": "explore", "z": 1, "b": 2}}],
         observation={"results": [{"source_call_id": "c1", "content": "Task #7 made", "extra": {"is_error": True, "exit_code": 2}}, {"source_call_id": "c2", "content": [{"type": "text", "text": "t"}]}]}),
    step(4, "agent", "done", extra={"is_sidechain": True, "agent_id": "g1"}),
]


@pytest.fixture
def root(tmp_path):
    for sid, meta in (("s1", True), ("s2", True), ("torn", False), ("-bad", True)):
        d = tmp_path / "sessions" / sid
        d.mkdir(parents=True)
        doc = {"schema_version": "1", "session_id": sid, "agent": {"name": "one", "version": "1", "model_name": "m", "extra": {"cwds": ["/w"], "git": {"branch": "b"}}}, "steps": STEPS, "final_metrics": {"total_cost_usd": 1.5, "extra": {"reported_cost_usd": 2.5}}, "extra": {"subagents": [{"agent_id": "g1", "parent_tool_call_id": "c2", "spawn_depth": 1}]}}
        (d / "trajectory.json").write_text(json.dumps(doc, indent=1))
        (d / "edges.jsonl").write_text("\n".join(json.dumps({"uuid": f"u{k}", "parent_uuid": None, "type": "user", "ts": "2025-01-01T00:00:00Z", "source_file": "f", "tool_use_ids": []}) for k in (1, 2)) + "\n")
        (d / "session_events.jsonl").write_text('{"seq":1,"ts":null,"event_type":"mode","payload":{"z":1,"b":[2]},"payload_bytes":9}\n\n')
        (d / "loss_report.json").write_text(json.dumps({"record_counts": {"user": 2}, "records_total": 2, "records_converted": 2, "records_dropped": 0, "gaps_observed": []}))
        if meta:
            (d / "meta.json").write_text(json.dumps({"session_id": sid, "source_mtime_ns": 1, "source_files": ["f"]}))
    return tmp_path


@pytest.fixture
def relations(spark, root):
    return Corpus(spark, str(root)).relations()


def test_only_complete_sessions_with_a_proper_id(relations):
    assert {r.session_id for r in relations["steps"].select("session_id").distinct().collect()} == {"s1", "s2"}
    assert is_session_id("a.b-c_1") and not is_session_id("a\n") and not is_session_id("") and not is_session_id("x" * 256)


def test_steps_are_typed(relations):
    rows = {r.step_id: r for r in relations["steps"].where("session_id = 's1'").collect()}
    assert rows[2].message == "one\n\ntwo"
    assert rows[3].message == '[not "message": [an array'
    assert (rows[3].prompt_tokens, rows[3].cache_creation, rows[1].prompt_tokens) == (1000, 5, None)
    assert rows[4].is_sidechain and rows[4].agent_id == "g1" and not rows[1].is_sidechain
    assert str(rows[1].ts) == "2025-01-01 00:01:00.500000"


def test_calls_keep_the_order_of_keys(relations):
    rows = {r.tool_use_id: r for r in relations["tool_calls"].where("session_id = 's1'").collect()}
    assert rows["c2"].tool_input == '{"subagent_type":"explore","z":1,"b":2}'
    results = {r.tool_use_id: r for r in relations["tool_results"].where("session_id = 's1'").collect()}
    assert (results["c1"].is_error, results["c1"].exit_code, results["c1"].interrupted, results["c2"].is_error) == (True, 2, None, None)


def test_views_have_the_declared_columns(relations):
    for name in schemas.VIEWS:
        df = views.VIEWS[name](relations)
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == schemas.columns(name), name


def test_views(relations):
    one = lambda name: [r.asDict() for r in views.VIEWS[name](relations).where("session_id = 's1'").collect()]
    assert one("sessions")[0]["cwd"] == "/w" and one("sessions")[0]["git_branch"] == "b" and one("sessions")[0]["step_count"] == 4
    assert [(r["subject"], r["status"]) for r in one("todo_state_current")] == [("a", "completed")]
    assert one("subagents")[0]["agent_type"] == "explore" and one("subagents")[0]["parent_step_id"] == 3 and one("subagents")[0]["step_count"] == 1
    assert one("images")[0]["blob_path"] == "blobs/sha256/ab/abcd.png"
    assert one("skill_usage")[0]["plugin"] == "plug" and one("skill_usage")[0]["args"] == "x"
    assert [r["author"] for r in sorted(one("user_steps"), key=lambda r: r["step_id"])] == ["harness", "human"]
    assert one("session_outcomes")[0]["kind"] == "one_shot_job"
    assert one("session_events")[0]["payload"] == '{"z":1,"b":[2]}' and one("session_events")[0]["ts"] is None


def test_lake(spark, tmp_path, relations):
    lake = Lake(spark, str(tmp_path / "lake"))
    first = lake.load(relations, "main")
    assert lake.verify(relations, "main").count() == 0
    assert lake.read("events").count() == 2  # rows without a time are there too
    steps = relations["steps"].selectExpr("session_id", *(c if c != "message" else "CASE WHEN session_id = 's1' THEN 'new' ELSE message END AS message" for c in relations["steps"].columns[1:]))
    bad = lake.verify({"steps": steps}, "main").collect()
    assert [r.session_id for r in bad] == ["s1"]
    lake.sync({"steps": steps}, "main", steps.where("session_id = 's1'"))
    assert lake.verify({"steps": steps}, "main").count() == 0
    assert {r.session_id for r in lake.changed_since("steps", first.number).collect()} == {"s1"}
    assert lake.read("steps", at=first).where("message = 'new'").count() == 0
    before = sorted(map(str, lake.read("tool_calls").collect()))
    lake.compact(keep=1)
    assert sorted(map(str, lake.read("tool_calls").collect())) == before
    assert lake.verify({"steps": steps}, "main").count() == 0
    assert {r.table for r in lake.status().collect()} == {t for t, df in relations.items() if not df.isEmpty()}


def test_sync_writes_the_parts_it_touches(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = [(f"s{k}", k, f"2025-0{1 + k % 3}-05 00:00:00") for k in range(9)]
    schema = "session_id string, step_id long, ts string"
    of = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    lake.load({"steps": of(rows)}, "main")
    lake.load({"steps": of([("x", 1, None)])}, "other")
    # s0 moves from January to no month; February and March stay where they are.
    new = of([("s0", 5, None)]).withColumn("more", F.lit("m"))
    lake.sync({"steps": new}, "main", new)
    assert {(r.corpus, r.part): r.folder for r in lake.status().collect()} == {("main", "2025-01"): "v=3", ("main", "none"): "v=3", ("main", "2025-02"): "v=1", ("main", "2025-03"): "v=1", ("other", "none"): "v=2"}
    got = sorted((r.session_id, r.step_id, r.more) for r in lake.read("steps").collect())
    assert got == sorted([(s, k, None) for s, k, _ in rows[1:]] + [("s0", 5, "m"), ("x", 1, None)])
    # A session of which nothing comes is gone, and its part with it when nothing else is there.
    lake.sync({"steps": new.limit(0)}, "main", spark.createDataFrame([("s0",), ("s1",), ("s4",), ("s7",)], "session_id string"))
    assert sorted(r.part for r in lake.status().where("corpus = 'main'").collect()) == ["2025-01", "2025-03"]
    before = sorted(map(str, lake.read("steps").collect()))
    lake.sync({"steps": of([("y", 1, None)])}, "third", of([("y", 1, None)]))
    assert "more" in lake.read("steps").columns
    lake.sync({"steps": new.limit(0)}, "third", of([("y", 1, None)]))
    lake.compact(keep=1, part_bytes=100)
    assert sorted(map(str, lake.read("steps").collect())) == before and {r.folder for r in lake.status().collect()} == {"v=7"}


def test_stream_into_the_lake(spark, tmp_path, relations):
    relations["steps"].write.parquet(str(tmp_path / "in"))
    lake = Lake(spark, str(tmp_path / "lake"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in relations["steps"].schema)
    for _ in range(2):  # the second run finds nothing new
        stream = incremental.read_events(spark, str(tmp_path / "in"), ddl)
        incremental.sync_lake(stream, lake, "steps", "main", str(tmp_path / "checkpoint")).awaitTermination()
    assert lake.verify({"steps": relations["steps"]}, "main").count() == 0


def test_sandbox(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    assert sandbox.run(spark, "SELECT id FROM numbers WHERE id > (SELECT min(id) FROM numbers);").count() == 2
    for text in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "INSERT INTO numbers VALUES (1)", "SET a=1", "SELECT 1; DROP VIEW numbers", "SELECT * FROM parquet.`/tmp`", "CACHE TABLE numbers"):
        with pytest.raises(sandbox.Refused):
            sandbox.run(spark, text)
    assert json.loads("".join(sandbox.emit(spark.sql("SELECT 1 AS a, 2 AS a")))) == [{"a": 1, "a_1": 2}]
    assert "".join(sandbox.emit(spark.sql("SELECT 1 AS a"), "csv")).split() == ["a", "1"]


def test_windows_like_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{s}", None if s % 2 else "g", p, rng.randrange(0, 120), rng.choice([None, None, "human_turn"])) for s in range(6) for p in range(rng.randrange(1, 40))]
    want = []
    for s in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == s]
        opened = chars = index = 0
        for r in mine:
            if r[2] > opened:
                why = r[4] if r[4] and chars >= 50 else "size_cap" if chars > 0 and chars + r[3] > 200 else None
                if why:
                    want.append((s, index, opened, r[2], why, chars))
                    opened, chars, index = r[2], 0, index + 1
            chars += r[3]
        want.append((s, index, opened, len(mine), "session_end", chars))
    df = spark.createDataFrame(rows, "session_id string, stream string, position long, chars long, mark string")
    got = [(r["session_id"], r["index"], r["start"], r["stop"], r["boundary"], r["chars"]) for r in passes.plan_windows(df, 200, 50).collect()]
    assert sorted(got) == sorted(want)


def test_compressed_files_stand_for_plain_ones(spark, root):
    import zstandard

    packed = zstandard.ZstdCompressor()
    plain = root / "sessions" / "s1" / "edges.jsonl"
    (plain.parent / "edges.jsonl.zst").write_bytes(packed.compress(plain.read_bytes()))
    events = root / "sessions" / "s2" / "session_events.jsonl"
    (events.parent / "session_events.jsonl.zst").write_bytes(packed.compress(events.read_bytes()))
    events.unlink()
    relations = Corpus(spark, str(root)).relations()
    assert sorted((r.session_id, r.uuid) for r in relations["edges"].collect()) == [("s1", "u1"), ("s1", "u2"), ("s2", "u1"), ("s2", "u2")]
    assert sorted(r.session_id for r in relations["events"].collect()) == ["s1", "s2"]


def test_a_string_message_that_holds_json_stays_whole(spark):
    from stepwell.operators import steps as S

    text = '[{"type":"text","text":"a"}]'
    rows = [json.dumps({"step_id": 1, "message": text, "tool_calls": [{"arguments": {"message": [1]}}]}), json.dumps({"step_id": 2, "message": [{"text": "a"}, {"x": 1}, {"text": "b"}]}), json.dumps({"step_id": 3})]
    df = spark.createDataFrame([("s", rows)], "session_id string, steps array<string>")
    assert {r.step_id: r.message for r in S.steps(df).collect()} == {1: text, 2: "a\n\nb", 3: None}


def test_sandbox_refuses_what_reaches_the_machine(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    for text in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM numbers WHERE java_method('java.lang.System', 'getProperty', 'a') = 'b'", "SELECT (SELECT max(try_reflect('java.lang.System', 'getProperty', 'a')) FROM numbers)", "WITH c AS (SELECT Reflect('java.lang.System', 'getProperty', 'a') AS x) SELECT * FROM c", "SELECT a.b.c(1)", "SELECT 1; SELECT 2", "SELECT * FROM no_such_function(1)"):
        with pytest.raises(sandbox.Refused):
            sandbox.run(spark, text)
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    assert sandbox.run(spark, "SELECT 'a; b' AS x -- a; comment").first().x == "a; b"
    assert sandbox.run(spark, "SELECT upper('x'), count(*) FROM range(3) WHERE id > 0;").count() == 1
    assert spark.conf.get("spark.sql.runSQLOnFiles") == before
    assert [sandbox.exit_code(e) for e in (sandbox.Refused("x"), RuntimeError())] == [sandbox.EXIT_REFUSED, sandbox.EXIT_RUNTIME]


def test_typed_files_stand_for_the_trajectory(spark, root):
    before = {n: sorted(map(str, df.select(sorted(df.columns)).collect())) for n, df in Corpus(spark, str(root)).relations().items() if n != "trajectories"}
    r = Corpus(spark, str(root)).relations()
    files = {"session": r["trajectories"].select("schema_version", F.lit("inner").alias("session_id"), "agent", "final_metrics", "extra"), "steps": r["steps"], "tool_calls": r["tool_calls"], "tool_results": r["tool_results"], "session_events": r["events"]}
    for sid in ("s1", "s2"):
        for name, df in files.items():
            rows = df if name == "session" else df.where(F.col("session_id") == sid)
            pq.write_table(rows.limit(1 if name == "session" else 1000).toArrow(), root / "sessions" / sid / f"{name}.parquet")
    meta = root / "sessions" / "s1" / "meta.json"
    meta.write_text(json.dumps(json.loads(meta.read_text()) | {"columnar_schema": 2}))
    (root / "sessions" / "s1" / "trajectory.json").write_text("no longer read")
    (root / "sessions" / "s2" / "steps.parquet").write_bytes(b"torn")  # another version, so it is not opened
    corpus = Corpus(spark, str(root))
    assert corpus.typed == {"s1"}
    after = corpus.relations()
    for n, want in before.items():
        assert sorted(map(str, after[n].select(sorted(after[n].columns)).collect())) == want, n
    assert {x.session_id for x in views.VIEWS["sessions"](after).where("cwd = '/w' AND step_count = 4").collect()} == {"s1", "s2"}
    (root / "sessions" / "s1" / "tool_calls.parquet").write_bytes(b"x" * 16)
    assert Corpus(spark, str(root)).typed == frozenset()
