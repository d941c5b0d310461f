import datetime as d
import json

import pytest

from marginalia.operators import answers

EVENTS = "ask_id long, seq int, event string, data string, sent_at timestamp_ntz, received_at timestamp_ntz"


@pytest.fixture(scope="module")
def events(spark):
    at = d.datetime(2024, 1, 1)
    meta = lambda *ns: json.dumps({"question": "q?", "sources": [{"n": n, "note_id": n * 10, "title": f"T{n}"} for n in ns], "confidence": "ok"})
    delta = lambda t: json.dumps({"text": t})
    rows = [(1, 0, "meta", meta(1, 2), at, at), (1, 2, "delta", delta("b [2] [9]"), at, at), (1, 1, "delta", delta("a [1]"), at, at + d.timedelta(hours=1)), (1, 3, "done", '{"answered": true, "cited": [1, 2]}', at, at)]
    rows += [(1, 1, "delta", delta("a [1]"), at, at + d.timedelta(hours=1)), (2, 0, "meta", meta(1), at, at), (2, 1, "delta", None, at, at), (2, 2, "done", '{"answered": true, "cited": [3]}', at, at)]
    rows += [(3, 0, "error", '{"message": "empty"}', at, at), (4, 0, "delta", delta("[99999999999] x"), at, at), (4, 1, "meta", "not json", at, at), (5, None, None, None, None, None)]
    return spark.createDataFrame(rows, EVENTS)


def test_assembled(events):
    rows = {r["ask_id"]: r for r in answers.assembled(events).collect()}
    assert rows[1]["answer"] == "a [1]b [2] [9]" and rows[1]["late"] == 1 and len(rows[1]["sources"]) == 2
    assert rows[2]["answer"] == "" and rows[3]["failed"] and rows[4]["sources"] is None and rows[5]["answer"] == ""


def test_citations(events):
    rows = {r["ask_id"]: r for r in answers.checked_citations(answers.assembled(events)).collect()}
    assert (rows[1]["cited"], rows[1]["invalid"], rows[1]["answered"], rows[1]["claim_holds"]) == ([1, 2], [9], True, True)
    assert (rows[2]["cited"], rows[2]["answered"], rows[2]["claim_holds"]) == ([], False, False)
    assert rows[4]["cited"] == [] and rows[4]["invalid"] == []


def test_cited_notes(spark, events):
    notes = spark.createDataFrame([(10, "T1"), (20, "other")], "note_id long, page_title string")
    rows = answers.cited_notes(answers.checked_citations(answers.assembled(events)), notes).collect()
    assert {(r["ask_id"], r["n"], r["known"]) for r in rows} == {(1, 1, True), (1, 2, False)}


def test_protocol(events):
    assert {r["ask_id"]: r["events"] for r in answers.protocol_breaks(events).collect()} == {4: "tm", 5: "?"}


def test_contexts(spark):
    hits = spark.createDataFrame([("q", i, f"T{i}", i if i else -1, 0.019, "S" if i == 1 else None) for i in range(12)], "term string, rank int, title string, chunk_id long, score double, summary string")
    chunks = spark.createDataFrame([(i, f"# T{i}\n\nbody {i}") for i in range(12)], "chunk_id long, text string")
    row = answers.contexts(hits, chunks, 99).first()
    assert row["sources"] == 8 and row["confidence"] == "low" and row["context"].startswith("[1] T0\n\n[2] T1\nSummary: S\nExcerpt: body 1")
    assert answers.contexts(hits, chunks, 0).first()["sources"] == 1


def test_questions(spark):
    rows = spark.createDataFrame([("a?",), ("   ",), (None,), ("x" * 4001,)], "question string")
    assert [r["error"] for r in answers.valid_questions(rows).collect()] == [None, "empty", "empty", "too long"]


def test_linked_citations(spark):
    rows = spark.createDataFrame([("a <b> [1][7] [x]", [1, 2]), ("[2]", None), (None, [1])], "a string, s array<int>")
    from pyspark.sql import functions as F

    got = [r[0] for r in rows.select(answers.linked_citations(F.col("a"), F.col("s"))).collect()]
    assert got == ['a &lt;b&gt; <a href="#source-1">[1]</a>[7] [x]', "[2]", None]


def test_highlights(spark):
    hits = spark.createDataFrame([("q", 1, 10, "T"), ("q" * 4001, 1, 10, "T"), ("fail", 2, 20, "U"), ("q", 3, -1, "V")], "term string, note_id long, chunk_id long, title string")
    chunks = spark.createDataFrame([(10, "# T\n\nbody"), (20, "# U\n\nfirst\nsecond")], "chunk_id long, text string")
    pages = spark.createDataFrame([(1, "the page")], "note_id long, content string")
    chat = lambda prompts: [None if "fail" in p else " " + p[-8:] for p in prompts]
    got = {(r["term"][:5], r["note_id"]): r["highlight"] for r in answers.highlights(hits, chunks, pages, chat).collect()}
    assert got == {("q", 1): "the page", ("qqqqq", 1): "", ("fail", 2): "first"}
