"""Session folders, blobs, digests."""

import hashlib
import json

import pytest

from stepwell.sources import publish
from stepwell.sources.corpus import Corpus


def test_sessions_are_published_whole(spark, tmp_path):
    doc = json.dumps({"session_id": "s1", "agent": {"name": "a"}, "steps": [{"step_id": 1, "source": "user", "message": "hi"}]})
    kind = "session_id string, artifacts map<string, string>"
    rows = [("s1", {"meta.json": "{}", "trajectory.json": doc, "edges.jsonl": ""}), ("-bad", {"meta.json": "{}"}), ("s2", {"trajectory.json": doc}), (None, {"meta.json": "{}"}), ("s3", None)]
    assert publish.publish(spark.createDataFrame(rows, kind), str(tmp_path)) == 1
    assert [(r.session_id, r.message) for r in Corpus(spark, str(tmp_path)).steps().collect()] == [("s1", "hi")]
    again = [("s1", {"meta.json": '{"a": 1}', "trajectory.json": doc.replace("hi", "ho")})]
    assert publish.publish(spark.createDataFrame(again, kind), f"file://{tmp_path}") == 1
    assert sorted(p.name for p in (tmp_path / "sessions" / "s1").iterdir() if not p.name.endswith(".crc")) == ["meta.json", "trajectory.json"]
    assert [r.message for r in Corpus(spark, str(tmp_path)).steps().collect()] == ["ho"]
    with pytest.raises(Exception, match="two sessions are named s1"):
        publish.publish(spark.createDataFrame(again * 2, kind), str(tmp_path))
    assert publish.publish(spark.createDataFrame([], kind), str(tmp_path)) == 0


def test_blobs_are_stored_once(spark, tmp_path):
    name = hashlib.sha256(b"abc").hexdigest()
    of = lambda *rows: spark.createDataFrame(list(rows), "sha256 string, data binary")
    assert publish.store_blobs(of((name, b"abc"), (None, None)), str(tmp_path)) == 1
    path = tmp_path / "blobs" / "sha256" / name[:2] / name
    assert path.read_bytes() == b"abc" and publish.store_blobs(of((name, b"abc")), str(tmp_path)) == 0
    path.write_bytes(b"a")
    assert publish.store_blobs(of((name, b"abc")), str(tmp_path)) == 1 and path.read_bytes() == b"abc"
    with pytest.raises(Exception, match="not what its name says"):
        publish.store_blobs(of((name, b"x")), str(tmp_path))


def test_changed_files(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_text(name)
    before = publish.digests(spark, f"{tmp_path}/*.jsonl").collect()
    (tmp_path / "a.jsonl").write_text("x")
    (tmp_path / "b.jsonl").unlink()
    (tmp_path / "d.jsonl").write_text("d")
    then = spark.createDataFrame(before, "path string, bytes long, sha256 string")
    got = publish.changed(then, publish.digests(spark, f"{tmp_path}/*.jsonl")).collect()
    assert sorted((r.path[-7:], r.why) for r in got) == [("a.jsonl", "changed"), ("b.jsonl", "gone"), ("d.jsonl", "new")]


def test_slug(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    assert publish.slug("~/.claude") == "default" and publish.slug(str(tmp_path / ".codex/sessions/../sessions")) == "codex"
    place = tmp_path / ("My Corpus!" + "x" * 40)
    assert publish.slug(str(place)) == "my-corpus-" + "x" * 22 + "-" + hashlib.sha256(str(place).encode()).hexdigest()[:8]
