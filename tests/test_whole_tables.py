"""Queries of passes over whole tables, held against loops."""

import os
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from stepwell.session import table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def test_every_turn_is_packed(spark):
    turns = defaultdict(list)
    for r in table(spark, DATA, "conversations").select("conv_id", "turn", "text").collect():
        turns[str(r.conv_id)].append((r.turn, len(r.text or "")))
    want = []
    for session, rows in turns.items():
        call, held = 0, []
        for turn, chars in sorted(rows):
            size = sum(c for _, c in held)
            if held and size > 0 and size + chars > 1000:
                want.append((session, call, held[0][0], turn, size))
                call, held = call + 1, []
            held.append((turn, chars))
        want.append((session, call, held[0][0], held[-1][0] + 1, sum(c for _, c in held)))
    got = sorted(map(tuple, entry.queries()["packed_conversations"](spark, DATA).collect()))
    assert got == sorted(want) and len(got) > len(turns)


def test_every_document_can_be_pending(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").select("doc_id", "text").collect()}
    want = []
    for n in sorted(texts):
        if n % 10 == 9 and n - 1 in texts:
            continue
        if n % 10 not in (0, 2):
            want.append((str(n), hashlib.sha256(texts[n].encode()).hexdigest(), n % 10 == 1))
    got = [tuple(r) for r in entry.queries()["pending_document_texts"](spark, DATA).select("uuid", "text_hash", "replaces_existing").collect()]
    assert sorted(got) == sorted(want) and max(int(r[0]) for r in got) >= 700
