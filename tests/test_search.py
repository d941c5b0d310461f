import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.embedding import hashed_words
from marginalia.operators import search

QUERIES = "term string, query_vec array<float>, min_score double, top_n int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    vec = lambda: [float(x) for x in rng.standard_normal(8) / 3]
    words = ["kettle", "boat", "river", "letter", "garden"]
    chunks = [(i, i % 40, i // 40, f"# T{i % 40}\n\n- " + " ".join(words[(i * k + k) % 5] for k in range(1, 8)), vec()) for i in range(200)]
    chunks += [(900, 3, 9, "Boat BOAT boat", None), (901, 4, 9, None, [float("nan")] * 8), (902, 5, 9, "", [0.5] * 7)]
    notes = [(i, f"T{i}", f"p/T{i}.md", "Sum\nmary" if i % 3 else None, 4 + i % 2, vec() if i % 4 else None) for i in range(45)]
    queries = [("boat", vec(), 0.1, 5), ("kettle river", vec(), -1.0, 200), (" ", vec(), 0.0, 3), ("x", None, 0.0, 3)]
    return (
        spark.createDataFrame(notes, "note_id long, page_title string, rel_path string, summary string, summary_status int, summary_embedding array<float>").cache(),
        spark.createDataFrame(chunks, "chunk_id long, note_id long, ord int, text string, embedding array<float>").cache(),
        spark.createDataFrame(queries, QUERIES),
    )


def test_dense_ranks_equal_brute_force(tables):
    _, chunks, queries = tables
    got = search.dense_ranks(chunks.selectExpr("chunk_id", "embedding AS vector"), queries, "chunk_id", 17).collect()
    rows = [(r["chunk_id"], np.array(r["embedding"], float)) for r in chunks.collect() if r["embedding"] and len(r["embedding"]) == 8 and np.isfinite(r["embedding"]).all()]
    for q in queries.collect()[:3]:
        expected = sorted(((round(float(np.array(q["query_vec"]) @ v), 6), i) for i, v in rows), key=lambda x: (-x[0], x[1]))[:17]
        own = sorted((r for r in got if r["term"] == q["term"]), key=lambda r: r["rank"])
        assert [(r["score"], r["chunk_id"]) for r in own] == expected and [r["rank"] for r in own] == list(range(17))


def test_lexical_ranks(tables):
    _, chunks, queries = tables
    got = search.lexical_ranks(chunks, queries).collect()
    assert {r["term"] for r in got} == {"boat", "kettle river"}
    top = next(r for r in got if r["term"] == "boat" and r["rank"] == 0)
    assert top["chunk_id"] == 900 and top["score"] == round(math.log(4) / math.log(15), 6)


def test_fusion_ranks_from_zero(spark):
    a = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "term string, id long, rank int")
    b = spark.createDataFrame([("q", 2, 0)], "term string, id long, rank int")
    assert {r["id"]: r["score"] for r in search.fused([a, b], "id").collect()} == {1: round(1 / 60, 9), 2: round(1 / 61 + 1 / 60, 9)}


def test_hybrid_search_does_not_depend_on_order(tables):
    notes, chunks, queries = tables
    plain = sorted(map(tuple, search.hybrid_search(notes, chunks, queries).collect()))
    mixed = sorted(map(tuple, search.hybrid_search(notes.repartition(7), chunks.orderBy("text").repartition(5), queries).collect()))
    assert plain == mixed and plain
    assert all(sum(r[0] == q["term"] for r in plain) <= q["top_n"] for q in queries.collect())


def test_summary_only_hits_and_excerpts(spark, tables):
    notes, chunks, queries = tables
    hits = search.hybrid_search(notes, chunks.filter("chunk_id < 0"), queries)
    shown = search.anchored(hits, chunks).collect()
    assert shown and {r["chunk_id"] for r in shown} == {-1} and {r["excerpt"] for r in shown} <= {"Sum", ""}


def test_snippets(tables):
    notes, chunks, queries = tables
    hits = search.hybrid_search(notes, chunks, queries)
    got = search.snippets(hits, chunks, hashed_words(32)).collect()
    assert len(got) == hits.count() and all(r["snippet"].startswith("- ") or not 0 <= r["chunk_id"] < 900 for r in got)
    assert all(r["snippet"] == ("Sum" if r["summary"] else "") for r in got if r["chunk_id"] < 0)


def test_texts_of_all_chunks_aren_t_shuffled(tables):
    from marginalia.tables import settle

    notes, chunks, queries = tables
    read = search.with_texts(settle(search.hybrid_search(notes, chunks, queries)), chunks)
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("text#")
    assert "BroadcastHashJoin" in plan[:scan] or "BroadcastHashJoin" in plan
    assert read.filter("chunk_id = 901").count() == hits_of(notes, chunks, queries, 901)


def hits_of(notes, chunks, queries, chunk):
    return search.hybrid_search(notes, chunks, queries).filter(F.col("chunk_id") == chunk).count()


def test_queries_of_another_width_take_nothing_away(spark, tables):
    _, chunks, queries = tables
    vectors = chunks.selectExpr("chunk_id", "embedding AS vector")
    plain = set(map(tuple, search.dense_ranks(vectors, queries, "chunk_id").collect()))
    odd = spark.createDataFrame([("narrow", [1.0] * 7, 0.0, 3), ("wide", [1.0] * 9, 0.0, 3)], QUERIES)
    got = set(map(tuple, search.dense_ranks(vectors, odd.union(queries), "chunk_id").collect()))
    assert plain <= got and {r[0] for r in got - plain} == {"narrow"}


def test_many_queries_in_blocks(tables, monkeypatch):
    _, chunks, queries = tables
    vectors = chunks.selectExpr("chunk_id", "embedding AS vector")
    plain = sorted(map(tuple, search.dense_ranks(vectors, queries, "chunk_id", 9).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, search.dense_ranks(vectors, queries, "chunk_id", 9).collect())) == plain


def test_empty_tables(tables):
    notes, chunks, queries = tables
    assert search.hybrid_search(notes.limit(0), chunks.limit(0), queries).count() == 0
    assert search.hybrid_search(notes, chunks, queries.limit(0)).count() == 0


def test_too_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_QUERIES", 1)
    with pytest.raises(ValueError):
        search.checked_queries(spark.createDataFrame([("a", [1.0], 0.0, 1)] * 2, QUERIES))


def test_tasks_keep_only_the_best(spark):
    scored = spark.createDataFrame([("a", i, float(i % 7)) for i in range(50)], "term string, id long, score double")
    best = search.best_rows(scored, "id", 3)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["rank"]) for r in best.orderBy("rank").collect()] == [(6, 0), (13, 1), (20, 2)]
