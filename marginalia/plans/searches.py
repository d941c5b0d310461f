"""Queries of the search operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import uri
from marginalia.functions.embedding import hashed_words
from marginalia.functions.vector import is_usable
from marginalia.operators import search
from marginalia.plans.scalars import TITLE_SQL, sql_encoded  # noqa: F401
from marginalia.tables import settle, table

WIDTH = 64


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, folder, name) for name in ("notes", "chunks", "query_terms"))


def usable_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").filter(is_usable(F.col("embedding"), WIDTH)).select("chunk_id", "note_id")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    _, chunks, queries = tables(spark, folder)
    return search.dense_ranks(chunks.select("chunk_id", F.col("embedding").alias("vector")), queries, "chunk_id").select("term", "chunk_id", "score", "rank")


def dense_topk_gated(spark: SparkSession, folder: str) -> DataFrame:
    _, chunks, queries = tables(spark, folder)
    return search.gated(search.dense_ranks(chunks.select("chunk_id", F.col("embedding").alias("vector")), queries, "chunk_id"), queries).select("term", "chunk_id", "score", "rank")


def summary_ranks(spark: SparkSession, folder: str) -> DataFrame:
    notes, _, queries = tables(spark, folder)
    return search.gated(search.dense_ranks(notes.select("note_id", F.col("summary_embedding").alias("vector")), queries, "note_id"), queries).select("term", "note_id", "score", "rank")


def lexical_topk(spark: SparkSession, folder: str) -> DataFrame:
    _, chunks, queries = tables(spark, folder)
    return search.lexical_ranks(chunks, queries).select("term", "chunk_id", "score", "rank")


def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    notes, chunks, queries = tables(spark, folder)
    lists = search.rank_all(notes, chunks, queries)
    return search.fused([lists.dense, lists.lexical], "chunk_id").select("term", "chunk_id", "score")


def note_best_chunk(spark: SparkSession, folder: str) -> DataFrame:
    _, chunks, _ = tables(spark, folder)
    return search.best_chunks(rank_fusion(spark, folder), chunks)


def note_fusion(spark: SparkSession, folder: str) -> DataFrame:
    notes, chunks, queries = tables(spark, folder)
    lists = search.rank_all(notes, chunks, queries)
    return search.note_scores(search.best_chunks(search.fused([lists.dense, lists.lexical], "chunk_id"), chunks), lists.summary)


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    notes, chunks, queries = tables(spark, folder)
    hits = search.hybrid_search(notes, chunks, queries)
    return hits.withColumn("link", uri.prose_link(F.lit("My Vault"), F.col("rel_path"))).drop("rel_path")


def search_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    notes, chunks, queries = tables(spark, folder)
    return search.anchored(settle(search.hybrid_search(notes, chunks, queries)), chunks).select("term", "rank", "note_id", "chunk_id", "excerpt")


def search_snippets(spark: SparkSession, folder: str) -> DataFrame:
    notes, chunks, queries = tables(spark, folder)
    found = search.snippets(settle(search.hybrid_search(notes, chunks, queries)), chunks, hashed_words(WIDTH))
    return found.select("term", "rank", "note_id", "chunk_id", "unit", "unit_score", "snippet")


def ranking_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Of each query, the notes whose title holds the term: how many there are, the best rank of one, and whether it is within top_n."""
    notes, _, queries = tables(spark, folder)
    expected = notes.select(F.lower("page_title").alias("low"), "note_id").join(search.small(queries.select("term", "top_n")), F.contains("low", F.lower("term")))
    hits = hybrid_search(spark, folder).select("term", "note_id", "rank")
    graded = expected.join(hits, ["term", "note_id"], "left").groupBy("term").agg(F.count("*").alias("expected"), F.min("rank").alias("best_rank"))
    grade = F.when(F.col("best_rank") == 0, "pass").when(F.col("best_rank").isNotNull(), "warn").otherwise("fail")
    return graded.withColumn("grade", grade)


def eval_tally(spark: SparkSession, folder: str) -> DataFrame:
    """How many queries passed, were found late, or failed."""
    grades = ranking_eval(spark, folder)
    return grades.agg(*(F.count_if(F.col("grade") == g).alias(g) for g in ("pass", "warn", "fail")))


USABLE = "len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
SQL = {
    "usable_vectors": f"SELECT chunk_id, note_id FROM chunks WHERE {USABLE.format(v='embedding')}",
}


def ranked_sql(rows: str, id_name: str) -> str:
    return f"SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY score DESC, {id_name}) - 1)::INTEGER AS rank FROM ({rows})) WHERE rank < {search.DEPTH}"


def dense_sql(source: str, id_name: str, v: str) -> str:
    score = f"round(list_dot_product({v}::DOUBLE[], query_vec::DOUBLE[]), {search.DIGITS})"
    return ranked_sql(f"SELECT term, {id_name}, {score} AS score FROM (SELECT * FROM {source} WHERE {USABLE.format(v=v)}), query_terms", id_name)


def gated_sql(ranked: str) -> str:
    return f"SELECT r.* FROM ({ranked}) r JOIN query_terms q USING (term) WHERE r.score >= q.min_score"


DENSE = dense_sql("chunks", "chunk_id", "embedding")
SUMMARY = gated_sql(dense_sql("notes", "note_id", "summary_embedding"))
LEXICAL = ranked_sql(
    "SELECT term, chunk_id, round(ln(1 + (length(low) - length(replace(low, phrase, ''))) / length(phrase)) / ln(1 + chars), 6) AS score "
    "FROM (SELECT chunk_id, lower(text) AS low, length(text) AS chars FROM chunks), (SELECT term, lower(term) AS phrase FROM query_terms WHERE length(trim(term)) >= 2) WHERE contains(low, phrase)",
    "chunk_id",
)
FUSION = (
    f"SELECT term, chunk_id, round(coalesce(1 / (60.0::DOUBLE + d.rank), 0) + coalesce(1 / (60.0::DOUBLE + l.rank), 0), 9) AS score "
    f"FROM ({gated_sql(DENSE)}) d FULL JOIN ({LEXICAL}) l USING (term, chunk_id)"
)
BEST = (
    f"SELECT term, note_id, chunk_id, score FROM (SELECT f.*, note_id, row_number() OVER (PARTITION BY term, note_id ORDER BY score DESC, chunk_id) AS n "
    f"FROM ({FUSION}) f JOIN chunks USING (chunk_id)) WHERE n = 1"
)
NOTES = (
    f"SELECT term, note_id, coalesce(chunk_id, -1) AS chunk_id, round(coalesce(b.score, 0) + coalesce(1 / (60.0::DOUBLE + s.rank), 0), 9) AS score "
    f"FROM ({BEST}) b FULL JOIN ({SUMMARY}) s USING (term, note_id)"
)
LABEL = "CASE summary_status WHEN 4 THEN 'ok' WHEN 5 THEN 'failed' ELSE 'pending' END"
LINKED = f"replace('obsidian://open?vault=My+Vault&file=' || {sql_encoded('url_decode(regexp_replace(rel_path, ' + chr(39) + chr(92) + '.md' + chr(92) + 'z' + chr(39) + ', ' + chr(39) * 2 + '))')}, '+', '%20')"
HYBRID = (
    f"SELECT term, rank, note_id, page_title AS title, chunk_id, score, summary, {LABEL} AS summary_status, {LINKED} AS link "
    f"FROM (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY score DESC, note_id) - 1)::INTEGER AS rank FROM ({NOTES})) "
    f"JOIN (SELECT term, top_n FROM query_terms) USING (term) JOIN (SELECT note_id, page_title, rel_path, summary, summary_status FROM notes) USING (note_id) WHERE rank < top_n"
)
GRADES = (
    f"SELECT *, CASE WHEN best_rank = 0 THEN 'pass' WHEN best_rank IS NOT NULL THEN 'warn' ELSE 'fail' END AS grade FROM "
    f"(SELECT term, count(*) AS expected, min(rank) AS best_rank FROM (SELECT q.term, n.note_id FROM notes n, query_terms q WHERE contains(lower(page_title), lower(q.term))) "
    f"LEFT JOIN (SELECT term, note_id, rank FROM ({HYBRID})) USING (term, note_id) GROUP BY term)"
)
SQL |= {
    "dense_topk": DENSE,
    "dense_topk_gated": gated_sql(DENSE),
    "summary_ranks": SUMMARY,
    "lexical_topk": LEXICAL,
    "rank_fusion": FUSION,
    "note_best_chunk": BEST,
    "note_fusion": NOTES,
    "hybrid_search": HYBRID,
    "ranking_eval": GRADES,
    "eval_tally": f"SELECT count(*) FILTER (grade = 'pass') AS pass, count(*) FILTER (grade = 'warn') AS warn, count(*) FILTER (grade = 'fail') AS fail FROM ({GRADES})",
}

QUERIES = {
    f.__name__: f
    for f in (
        usable_vectors, dense_topk, dense_topk_gated, summary_ranks, lexical_topk, rank_fusion, note_best_chunk, note_fusion,
        hybrid_search, search_excerpts, search_snippets, ranking_eval, eval_tally,
    )
}
