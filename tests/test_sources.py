import datetime as d
import struct

import pytest
from pyspark.sql import functions as F

from marginalia.functions import vector
from marginalia.functions.embedding import embedded, hashed_words, http_embedder
from marginalia.operators import state, summarize
from marginalia.sources import snapshots, vault
from marginalia.streaming import feeds


@pytest.fixture()
def folder(tmp_path):
    for path in ("a.md", ".hid.md", "_under.md", "sub/b.md", ".git/c.md", "trash/d.md", "sub/trash/e.md", "pages/p.md", "pages/.x/q.md", "journals/2024_01_01.md", "n.txt", ".md", "UP.MD"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(path, encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    return tmp_path


def test_vault_source(spark, folder):
    vault.register(spark)
    rows = {r["rel_path"]: r for r in spark.read.format("vault").option("path", str(folder)).load().collect()}
    assert set(rows) == {"a.md", ".hid.md", "_under.md", "sub/b.md", "pages/p.md", "journals/2024_01_01.md", "bad.md"}
    assert rows["a.md"]["content"] == "a.md" and rows["a.md"]["mtime"] > 0 and rows["bad.md"]["content"] is None and rows["bad.md"]["error"]
    outline = spark.read.format("vault").option("path", str(folder)).option("dialect", "outline").load()
    assert {r["rel_path"] for r in outline.collect()} == {"pages/p.md", "pages/.x/q.md", "journals/2024_01_01.md"}


def test_vault_of_nothing(spark, tmp_path):
    vault.register(spark)
    assert spark.read.format("vault").option("path", str(tmp_path)).load().count() == 0


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert snapshots.current(spark, root) is None
    assert [snapshots.publish(spark.range(n), root) for n in (1, 2)] == [1, 2]
    (tmp_path / "table" / "v00000003").mkdir()  # a writer that was lost
    assert snapshots.current(spark, root).count() == 2


def test_scan_stream_keeps_the_newest(spark, tmp_path):
    schema = "rel_path string, mtime long, content string, scanned_at timestamp_ntz"
    feed, root = f"{tmp_path}/feed", f"{tmp_path}/state"
    at = d.datetime(2024, 1, 1)
    spark.createDataFrame([("a", 2, "new", at), ("b", 1, "b", at)], schema).coalesce(1).write.parquet(feed)
    feeds.follow_scans(feeds.feed(spark, feed, 1), root, f"{tmp_path}/c")
    spark.createDataFrame([("a", 1, "old, late", at), ("c", 1, None, at), ("c", 0, "c", at)], schema).coalesce(1).write.mode("append").parquet(feed)
    feeds.follow_scans(feeds.feed(spark, feed, 1), root, f"{tmp_path}/c")
    assert {(r["rel_path"], r["mtime"], r["content"]) for r in snapshots.current(spark, root).collect()} == {("a", 2, "new"), ("b", 1, "b"), ("c", 0, "c")}


def test_scan_stream_of_many_files_equals_the_latest_scan(spark, tmp_path):
    """Equal mtimes in different batches: the later scan wins, whatever its content and the order of the files."""
    schema = "rel_path string, mtime long, content string, scanned_at timestamp_ntz"
    day = lambda n: d.datetime(2024, 1, n)
    feed, root = f"{tmp_path}/feed", f"{tmp_path}/state"
    for rows in ([("a", 1, "zzz old scan", day(1))], [("a", 1, "aaa newer scan", day(3)), ("b", 1, "x", day(2))], [("a", 1, "mmm between", day(2)), ("b", 2, "w", day(1))], [("c", 1, "y", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    feeds.follow_scans(feeds.feed(spark, feed, 1), root, f"{tmp_path}/c")
    expected = state.latest_scan(spark.read.parquet(feed)).collect()
    assert {(r["rel_path"], r["mtime"], r["content"]) for r in snapshots.current(spark, root).collect()} == set(map(tuple, expected))
    assert ("a", 1, "aaa newer scan") in set(map(tuple, expected))
    assert len(snapshots.versions(spark, root)) == snapshots.KEPT


def test_vectors(spark):
    rows = [(struct.pack("<3f", 1, 2, 3),), (b"12",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary").select(vector.decoded(F.col("b"), 3)).collect()] == [[1.0, 2.0, 3.0], None, None]
    pair = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0])], "a array<float>, b array<float>")
    assert pair.select(vector.dot(F.col("a"), F.col("b"))).first()[0] == 11.0
    odd = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,), ([1.0, None],), ([float("nan"), 1.0],)], "a array<float>")
    assert [r[0] for r in odd.select(vector.is_usable(F.col("a"), 2)).collect()] == [True, False, False, False, False]


def test_embedding(spark):
    got = [r[0] for r in spark.createDataFrame([("a b",), ("",), (None,)], "x string").select(embedded(F.col("x"), hashed_words(8))).collect()]
    assert sum(v * v for v in got[0]) == pytest.approx(1) and got[1] == got[2] == [0.0] * 8


def test_summaries(spark):
    pages = [(1, "T", "Enough prose to be worth a summary.", False), (2, "T", "short", False), (3, "T", None, False), (4, "T", "Enough prose, but the model says nothing.", False), (5, "T", "Enough prose, but the model fails.", False)]
    chat = lambda prompts: [None if "fails" in p else "(empty)" if "nothing" in p else "<think>hm</think> Good. " for p in prompts]
    got = {r["note_id"]: (r["outcome"], r["summary"], r["vector"] is not None) for r in summarize.summarized(spark.createDataFrame(pages, "note_id long, title string, content string, outline boolean"), chat, hashed_words(4)).collect()}
    assert got == {1: ("ok", "Good.", True), 2: ("skipped", None, False), 3: ("skipped", None, False), 4: ("failed", None, False), 5: ("failed", None, False)}


def test_streamed_answers(spark):
    body = ': x\n\ndata: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: oops\ndata: {"choices":[]}\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"c"}}]}'
    assert spark.createDataFrame([(body,)], "b string").select(summarize.stream_text(F.col("b"))).first()[0] == "ab"


def test_http_embedder():
    import http.server
    import json
    import threading

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            rows = [{"index": i, "embedding": [len(t), 1.0]} for i, t in enumerate(asked)]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": rows[::-1] if "short" not in asked else rows[:1]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    embed = http_embedder(f"http://127.0.0.1:{server.server_port}/v1/embeddings", "m")
    assert embed(["a", "bbb"]).tolist() == [[1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(ValueError):
        embed(["short", "x"])
    server.shutdown()
