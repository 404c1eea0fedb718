"""Stages around a model call, vector stores, and the catalog's functions in SQL."""

import json

import pytest

from stepwell.functions import macros, sql_surface
from stepwell.operators import labels, stages, views
from stepwell.plans import sandbox
from stepwell.plans.inputs import Relations
from stepwell.sources.vectors import UNSTAMPED, VectorStore, together

DATA = "/root/testdata/sf0.001"
SESSION = "session_id string, kind string, newest long, text string"


def test_ask_tells_refusals_and_failures_apart(spark):
    units = spark.createDataFrame([(str(k), f"t{k}") for k in range(20)], "unit string, text string").repartition(1)

    def call(texts):
        if "t9" in texts:
            raise RuntimeError("the provider is away")
        return [stages.REFUSED if t == "t1" else None if t == "t2" else json.dumps({"x": t}) for t in texts]

    got = {r.unit: r.status for r in stages.ask(units, call, 1).collect()}
    assert (got["1"], got["2"], got["9"], got["0"]) == ("refused", "failed", "failed", "answered") and len(got) == 20
    assert stages.ask(units.limit(0), call).count() == 0


def test_conflicts_and_perceived_name_turns_that_exist(spark):
    sessions = spark.createDataFrame([("a", "interactive", 2, "x"), ("b", "interactive", 1, "x"), ("c", "turn_audit", 3, "x"), ("d", "interactive", 4, "")], SESSION)
    edges = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("b", "u9")], "session_id string, uuid string")
    none = sessions.limit(0).select("session_id")
    pair = {"turn_a_uuid": "u1", "turn_b_uuid": "u2", "conflict_kind": "correction", "severity": "low", "confidence": 0.5}
    call = lambda texts: [json.dumps({"pairs": [pair, pair | {"severity": "made up"}, pair | {"confidence": 2}]}) for _ in texts]
    assert [(r.session_id, r.turn_b_uuid) for r in stages.conflicts(sessions, none, edges, call).collect()] == [("a", "u2")]
    error = {"turn_uuid": "u1", "signal": "correction", "severity": "minor", "confidence": 0.5}
    call = lambda texts: [json.dumps({"errors": [error, error | {"turn_uuid": "gone"}]}) for _ in texts]
    pairs = spark.createDataFrame([("a", 2), ("b", 1)], "session_id string, pairs int")
    assert [(r.session_id, r.turn_uuid) for r in stages.perceived(sessions, none, pairs, edges, call).collect()] == [("a", "u1")]
    assert [r.session_id for r in stages.admitted(sessions, none, 2).collect()] == ["c", "a"]


def test_friction_goes_through_its_tiers(spark):
    steps = spark.createDataFrame([("s", 1, "user", "u1", "any updates?", False), ("s", 2, "user", "u2", "Undo.", False), ("s", 3, "user", "u3", "go on then", False), ("s", 4, "user", "u4", "secret", False), ("s", 5, "user", "u5", "x" * 301, False)], "session_id string, step_id long, source string, uuid string, message string, has_error boolean").selectExpr("*", "CAST(NULL AS TIMESTAMP_NTZ) AS ts")
    call = lambda texts: [stages.REFUSED if t == "secret" else json.dumps({"label": "frustration", "confidence": 0.7}) for t in texts]
    got = {r.uuid: (r.label, r.source) for r in stages.label_friction(steps, steps, steps.limit(0), call).collect()}
    assert got == {"u1": ("status_ping", "regex"), "u2": ("correction", "sql"), "u3": ("frustration", "llm"), "u4": ("none", "refused")}


def test_narration_and_review(spark):
    windows = spark.createDataFrame([("s", None, 0, "w0"), ("s", "g", 1, "w1"), ("t", None, 0, "w2")], "session_id string, stream string, index long, text string")
    call = lambda texts: [None if t == "w2" else json.dumps({"intent": "i" * 5000, "actions": "a", "outcome": t}) for t in texts]
    rows = stages.narrate(windows, windows.limit(0), call).collect()
    assert sorted((r.session_id, r.stream or "", len(r.intent), r.outcome) for r in rows) == [("s", "", 2000, "w0"), ("s", "g", 2000, "w1")]
    again = stages.narrate(windows, windows.where("text <> 'w2'"), call)
    assert again.count() == 0
    steps = spark.createDataFrame([("s", "u1", "It  said\nso.")], "session_id string, uuid string, message string")
    quote = lambda u, q: {"uuid": u, "quote": q}
    findings = [{"heading": "kept", "quotes": [quote("u1", "said so")]}, {"heading": "bad", "quotes": [quote("u1", "said so"), quote("u1", "not this")]}, {"heading": "gone", "quotes": [quote("u7", "x")]}, {"heading": "none", "quotes": []}]
    call = lambda texts: [json.dumps({"findings": findings}) for _ in texts]
    kept, dropped = stages.review(windows.where("index = 0"), steps, call, windows.where("session_id = 't'"))
    assert [r.heading for r in kept.collect()] == ["kept"]
    assert {r.dropped: r.n for r in dropped.collect()} == {"not_said": 1, "unknown_step": 1, "no_quote": 1}


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/vectors")
    assert store.read().count() == 0
    rows = lambda *ids, x=1.0: spark.createDataFrame([(i, "m", 2, [x, 0.0], None, "h", False) for i in ids], "uuid string, model string, dim int, embedding array<float>, embedded_at timestamp, text_hash string, truncated boolean")
    store.replace(rows("a", "b"))
    store.replace(rows("b", "c", x=2.0))
    store.replace(rows("b", "c", x=2.0))
    assert sorted((r.uuid, r.embedding[0]) for r in store.read().collect()) == [("a", 1.0), ("b", 2.0), ("c", 2.0)]
    with pytest.raises(ValueError):
        store.replace(rows("z").withColumn("dim", views.F.lit(3)))
    with pytest.raises(ValueError):
        store.prune(rows("a").limit(0))
    store.prune(rows("a", "b"))
    store.compact()
    assert store.versions() and len(store.versions()) == 1 and store.read().count() == 2
    (tmp_path / "vectors" / "v=99").mkdir()  # a write that never finished
    assert store.read().count() == 2
    old = VectorStore(spark, f"file://{tmp_path}/old")
    old._write(rows("q").drop("text_hash", "truncated"))
    assert old.read().first().text_hash == UNSTAMPED
    assert together([store.read(), old.read()]).count() == 3
    with pytest.raises(ValueError):
        together([store.read(), old.read().withColumn("model", views.F.lit("other"))])
    seconds, n = macros.probe_time(store.read())
    assert seconds > 0 and n == 2


def test_functions_in_sql(spark):
    r = Relations(spark, DATA)
    for name, view in views.VIEWS.items():
        if name != "message_embeddings":
            view(r).createOrReplaceTempView(name)
    for name, view in labels.LABEL_VIEWS.items():
        view(r).createOrReplaceTempView(name)
    VectorStore(spark, "file:///nowhere").read().createOrReplaceTempView("message_embeddings")
    assert set(sql_surface.register(spark)) == set(sql_surface.FUNCTIONS)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    run = lambda text: sandbox.run(spark, text)
    assert rows(run("SELECT * FROM tool_rank(100000)")) == rows(macros.tool_rank(r["tool_calls"], 100000))
    assert rows(run("SELECT * FROM skill_rank(100000)")) == rows(macros.skill_rank(views.skill_usage(r), 100000))
    assert rows(run("SELECT * FROM friction_counts(NULL)")) == rows(macros.friction_counts(r["user_friction"], None))
    assert rows(run("SELECT * FROM friction_rate(NULL)")) == rows(macros.friction_rate(r["user_friction"], views.human_turns(r), None))
    assert rows(run("SELECT * FROM perceived_counts(NULL)")) == rows(macros.perceived_counts(r["perceived_errors"], views.messages(r), None))
    assert rows(run("SELECT * FROM cost_estimate('0')")) == rows(macros.cost_estimate(r["steps"], "0"))
    assert run("SELECT * FROM friction_examples('confusion', 3)").count() == 3 and run("SELECT * FROM semantic_search(array(1D), 3)").count() == 0
    assert rows(run("SELECT DISTINCT step_author(source, message) FROM steps WHERE source = 'user' AND NOT is_compact_summary")) == rows(views.user_steps(r).where("NOT is_compact_summary").select("author").distinct())
    assert run("SELECT model_used('0'), todo_velocity('3'), subagent_fanout('3'), ago('7 0:0:0') < current_timestamp()").first()[3]
