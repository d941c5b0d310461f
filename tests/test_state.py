import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.operators import state

NOTES = "note_id long, rel_path string, page_title string, mtime long, content_hash binary, chunker_version int, summary string, summary_status int, summary_attempts int, summary_embedding array<float>"
SCANS = "rel_path string, mtime long, content string, scanned_at timestamp_ntz"


def sha(s):
    return hashlib.sha256(s.encode()).digest()


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        (1, "same.md", "same", 10, sha("a"), 6, "s", 4, 1, [1.0]), (2, "touch.md", "t", 10, sha("b"), 6, "s", 4, 0, [1.0]), (3, "new text.md", "n", 10, sha("c"), 6, "s", 4, 0, None),
        (4, "old chunker.md", "o", 10, sha("d"), 5, None, 3, 2, None), (5, "gone.md", "g", 10, sha("e"), 6, None, 0, 0, None), (6, "unreadable.md", "u", 10, None, None, "", 1, 3, None),
    ]
    return spark.createDataFrame(rows, NOTES).cache()


@pytest.fixture(scope="module")
def scans(spark):
    import datetime as d

    at = d.datetime(2024, 1, 1)
    rows = [("same.md", 10, "a", at), ("touch.md", 11, "b", at), ("new text.md", 12, "cc", at), ("new text.md", 9, "older, scanned late", at + d.timedelta(days=9))]
    rows += [("old chunker.md", 10, "d", at), ("unreadable.md", 13, None, at), ("fresh%20one.md", 14, "f", at), ("same.md", 10, "a", at), (None, 1, "x", at)]
    return spark.createDataFrame(rows, SCANS)


def test_scan_changes(notes, scans):
    got = {r["rel_path"]: r["change"] for r in state.scan_changes(notes, scans).collect()}
    assert got == {"same.md": "unchanged", "touch.md": "touch", "new text.md": "reindex", "old chunker.md": "reindex", "gone.md": "missing", "unreadable.md": "missing", "fresh%20one.md": "new"}


def test_upsert_and_rescan(notes, scans):
    after = state.upserted(notes, state.scan_changes(notes, scans))
    rows = {r["rel_path"]: r for r in after.collect()}
    assert rows["touch.md"]["mtime"] == 11 and rows["touch.md"]["summary"] == "s"
    assert (rows["new text.md"]["summary"], rows["new text.md"]["summary_status"], rows["new text.md"]["summary_embedding"]) == (None, 1, None)
    assert rows["fresh%20one.md"]["note_id"] == 7 and rows["fresh%20one.md"]["page_title"] == "fresh one"
    assert rows["old chunker.md"]["chunker_version"] == 6 and rows["gone.md"]["note_id"] == 5
    again = {r["change"] for r in state.scan_changes(after, scans).collect()}
    assert again == {"unchanged", "missing"}


def test_removal_cascades(spark, notes):
    chunks = spark.createDataFrame([(1, 5), (2, 1), (3, 5)], "chunk_id long, note_id long")
    assert [r["chunk_id"] for r in state.removed(chunks, notes.filter("rel_path = 'gone.md'"), "note_id").collect()] == [2]


def test_replaced_chunks(spark):
    chunks = spark.createDataFrame([(1, 1, 0, "a", [1.0]), (2, 2, 0, "b", [1.0])], "chunk_id long, note_id long, ord int, text string, embedding array<float>")
    fresh = spark.createDataFrame([(2, 0, "x"), (2, 1, "y")], "note_id long, ord int, text string")
    rows = state.replaced_chunks(chunks, fresh.select("note_id").distinct(), fresh).collect()
    assert sorted((r["note_id"], r["ord"], r["text"]) for r in rows) == [(1, 0, "a"), (2, 0, "x"), (2, 1, "y")]
    assert len({r["chunk_id"] for r in rows}) == 3


def status(notes, changes, column="summary_status"):
    return {r["note_id"]: r[column] for r in notes.withColumns(changes).collect()}


def test_summary_states(notes):
    assert status(notes, state.promoted()) == {1: 4, 2: 4, 3: 4, 4: 3, 5: 2, 6: 2}
    assert status(notes, state.recovered())[4] == 1
    assert status(notes, state.only_where(F.col("note_id") == 4, state.failed_once())) == {1: 4, 2: 4, 3: 4, 4: 5, 5: 0, 6: 1}
    assert status(notes, state.only_where(F.col("note_id") == 5, state.failed_once()))[5] == 0
    assert status(notes, state.only_where(state.lacks_vector(), state.started_over())) == {1: 4, 2: 4, 3: 1, 4: 3, 5: 0, 6: 1}
    assert status(notes, state.saved(F.lit(""), F.lit(None).cast("array<float>")), "summary") == dict.fromkeys(range(1, 7))
    assert status(notes, state.unsummarizable())[6] == 4


def test_candidates_and_counts(notes):
    assert [r["note_id"] for r in state.candidates(notes.withColumns(state.promoted()), 5).collect()] == [5]
    assert [r["note_id"] for r in state.candidates(notes, 5).collect()] == [5]
    assert state.counts(notes).first().asDict() == {"total": 6, "ok": 3, "failed": 0, "pending": 3}
    assert state.counts(notes.limit(0)).first().asDict() == {"total": 0, "ok": 0, "failed": 0, "pending": 0}
