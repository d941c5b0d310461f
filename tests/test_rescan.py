import datetime as d

from pyspark.sql import functions as F

from marginalia.operators import answers, rescan, state
from marginalia.sources import snapshots

NOTES = "note_id long, rel_path string, page_title string, mtime long, content_hash binary, chunker_version int, summary string, summary_status int, summary_attempts int, summary_embedding array<float>"
AT = d.datetime(2024, 1, 1)


def tables(spark):
    note = lambda i, path, mtime: (i, path, path[:-3], mtime, None, state.CHUNKER, "s", state.OK, 0, [1.0])
    notes = spark.createDataFrame([note(1, "same.md", 5), note(2, "gone.md", 5), note(3, "changed.md", 5), note(4, "unreadable.md", 5)], NOTES)
    chunks = spark.createDataFrame([(10 * i + k, i, k, f"old {i} {k}", [1.0]) for i in range(1, 5) for k in range(2)], "chunk_id long, note_id long, ord int, text string, embedding array<float>")
    scans = [("same.md", 5, "whatever", AT), ("changed.md", 6, "Now it reads like this.", AT), ("new.md", 1, "# A heading\n\nA new note.", AT), ("unreadable.md", None, None, AT)]
    return notes, chunks, spark.createDataFrame(scans, "rel_path string, mtime long, content string, scanned_at timestamp_ntz")


def test_rescan(spark, tmp_path):
    notes, chunks, scans = tables(spark)
    after = rescan.rescan(notes, chunks, scans, F.lit(False))
    assert {(r["rel_path"], r["summary_status"]) for r in after.notes.collect()} == {("same.md", state.OK), ("changed.md", state.QUEUED_LOW), ("new.md", state.QUEUED_LOW), ("unreadable.md", state.OK)}
    ids = {r["rel_path"]: r["note_id"] for r in after.notes.collect()}
    texts = {(r["note_id"], r["ord"]): r["text"] for r in after.chunks.collect()}
    assert texts == {
        (1, 0): "old 1 0", (1, 1): "old 1 1", (4, 0): "old 4 0", (4, 1): "old 4 1",
        (3, 0): "# changed\n\nNow it reads like this.", (ids["new.md"], 0): "# new\n\n# A heading\n\nA new note.",
    }
    numbers = [r["chunk_id"] for r in after.chunks.collect()]
    assert len(set(numbers)) == len(numbers) and max(numbers) <= 41 + 2
    assert [r["rel_path"] for r in after.errors.collect()] == ["unreadable.md"]
    assert rescan.publish(after, f"file://{tmp_path}/n", f"file://{tmp_path}/c") == (1, 1)
    assert snapshots.current(spark, f"file://{tmp_path}/c").count() == 6


def test_rescan_of_empty_tables(spark):
    notes, chunks, scans = tables(spark)
    after = rescan.rescan(notes.limit(0), chunks.limit(0), scans.limit(0), F.lit(False))
    assert after.notes.count() == after.chunks.count() == after.errors.count() == 0


def test_new_chunk_ids_go_on_from_the_largest(spark):
    _, chunks, _ = tables(spark)
    fresh = spark.createDataFrame([(1 << 60, k, "x") for k in range(5)], "note_id long, ord int, text string")
    got = state.replaced_chunks(chunks, fresh.select("note_id").distinct(), fresh).filter("text = 'x'").collect()
    assert sorted(r["chunk_id"] for r in got) == [42, 43, 44, 45, 46]


def test_asking(spark):
    rows = [("what?", 2, "[1] A\n\n[2] B", "high"), ("weak", 1, "[1] A", "low"), (" ", 1, "[1] A", "high"), ("fails", 1, "[1] A", "high"), ("nothing", 0, None, "low"), ("x" * 5000, 1, "[1] A", "high")]
    contexts = spark.createDataFrame(rows, "term string, sources int, context string, confidence string")

    def chat(prompts):
        return [None if "fails" in p else "<think>no</think>It is [2], [7]\nand [1]." if p.startswith(answers.ANSWER_RULES) else "Perhaps [1]." for p in prompts]

    told = answers.asked(contexts, chat)
    got = {r["term"][:7]: (r["error"], r["cited"], r["invalid"], r["answered"]) for r in told.collect()}
    assert got["what?"] == (None, [1, 2], [7], True) and got["weak"] == (None, [1], [], True) and got["nothing"] == (None, [], [1], False)
    assert got[" "][0] == "empty" and got["fails"][0] == "no answer" and got["xxxxxxx"][0] == "too long"
    events = answers.answer_events(told)
    kinds = {}
    for r in events.orderBy("term", "seq").collect():
        kinds.setdefault(r["term"][:7], []).append(r["event"])
    assert kinds["what?"] == ["meta", "delta", "delta", "done"] and kinds["fails"] == kinds[" "] == ["error"]
    recorded = events.select(F.xxhash64("term").alias("ask_id"), "seq", "event", "data", F.lit(AT).alias("sent_at"), F.lit(AT).alias("received_at"))
    assert answers.protocol_breaks(recorded).count() == 0
    assert {r["answer"] for r in answers.assembled(recorded).filter("not failed").collect()} == {"It is [2], [7]\nand [1].", "Perhaps [1]."}
