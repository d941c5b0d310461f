"""Hybrid search for a small set of queries over all chunks: dense, lexical and summary rankings, fused.

The queries are a stated set (a few dozen rows) that every task holds; the chunks are scanned once, in blocks, and each
block keeps only a query's best. Ranks begin at 0; equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text, vector
from marginalia.functions.embedding import Embedder, embedded

#: Constant of the rank fusion, rows of a ranked list, results of a search, digits that scores are compared by.
FUSION_K, DEPTH, RESULTS, DIGITS = 60.0, 200, 10, 6
#: Queries held by every task at most, and those that are multiplied with a block of rows at once.
MOST_QUERIES, QUERY_BLOCK = 10_000, 256
#: Ids of hits that every task holds at most when their texts are fetched; more are joined by a shuffle.
HELD_HITS = 500_000


def checked_queries(queries: DataFrame) -> list:
    """The rows of ``queries`` (term, query_vec, min_score, top_n); it is an error if they aren't a small set."""
    rows = queries.limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once")
    return rows


def small(queries: DataFrame) -> DataFrame:
    """``queries`` for a broadcast; it is an error if they aren't a small set."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once")
    return F.broadcast(queries)


def held(queries: DataFrame) -> DataFrame:
    """``queries`` read once and for all, as every list of a search needs them."""
    return queries.sparkSession.createDataFrame(checked_queries(queries), queries.schema)


def best_rows(scored: DataFrame, id_name: str, depth: int) -> DataFrame:
    """``scored`` (term, id, score) with ``rank`` from 0, the best ``depth`` of each term."""
    order = Window.partitionBy("term").orderBy(F.desc("score"), id_name)
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)  # a filter on rank - 1 would not limit tasks
    return best.withColumn("rank", F.col("rank") - 1)


def dense_ranks(vectors: DataFrame, queries: DataFrame, id_name: str, depth: int = DEPTH) -> DataFrame:
    """Best ``depth`` of ``vectors`` (id_name, vector) for each query by dot product: term, id, score, rank.

    A query meets the vectors of its own width. Vectors and queries with null or not finite elements, or none, take no part.
    Scores are rounded before they are compared.
    """
    asked: dict[int, list[tuple[str, np.ndarray]]] = {}
    for r in checked_queries(queries):
        if r["term"] is not None and r["query_vec"] and all(x is not None and np.isfinite(x) for x in r["query_vec"]):
            asked.setdefault(len(r["query_vec"]), []).append((r["term"], np.asarray(r["query_vec"], dtype=np.float64)))
    schema = f"term string, {id_name} long, score double"
    found = vectors.sparkSession.createDataFrame([], schema)
    for width, own in sorted(asked.items()):  # one width as a rule
        usable = vectors.filter(vector.is_usable(F.col("vector"), width)).select(F.col(id_name).cast("long"), "vector")
        found = found.union(usable.mapInArrow(block_scan([t for t, _ in own], np.array([v for _, v in own]), id_name, depth), schema))
    return best_rows(found, id_name, depth)


def block_scan(terms: list[str], matrix: np.ndarray, id_name: str, depth: int):
    """A function over Arrow batches (id, vector) that keeps the best ``depth`` rows of each query (row of ``matrix``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = range(0, len(terms), QUERY_BLOCK)
        kept = {a: (np.zeros((len(matrix[a : a + QUERY_BLOCK]), 0), np.int64), np.zeros((len(matrix[a : a + QUERY_BLOCK]), 0))) for a in starts}
        for batch in batches:
            block = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, matrix.shape[1])
            for a in starts:
                best_ids, best = kept[a]
                ids = np.concatenate([best_ids, np.tile(batch.column(0).to_numpy(), (len(best), 1))], axis=1)
                scores = np.concatenate([best, np.round(matrix[a : a + QUERY_BLOCK] @ block.T, DIGITS)], axis=1)
                order = np.lexsort((ids, -scores), axis=1)[:, :depth]
                kept[a] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        for a, (best_ids, best) in kept.items():
            if best.size:
                names = [t for t in terms[a : a + QUERY_BLOCK] for _ in range(best.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(best_ids.ravel()), pa.array(best.ravel())], names=["term", id_name, "score"])

    return scan


def gated(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of ``ranked`` that reach their query's least score; ranks stay, as the list is sorted by score."""
    least = small(queries.select("term", "min_score"))
    return ranked.join(least, "term").filter(F.col("score") >= F.col("min_score")).drop("min_score")


def lexical_score(low: Column, chars: Column, term: Column) -> Column:
    """ln(1 + occurrences) / ln(1 + chars) of a lower-case phrase in a lower-case text."""
    times = (F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)
    return F.round(F.log(1 + times) / F.log(1 + chars), DIGITS)


def lexical_ranks(chunks: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Best ``depth`` of ``chunks`` (chunk_id, text) that contain a query's whole phrase, in any case: term, chunk_id, score, rank.

    Queries that are no search (blank, or one character without meaning) find nothing.
    """
    asked = queries.filter(text.is_searchable(F.col("term"))).select("term", F.lower("term").alias("phrase"))
    low = chunks.filter("text is not null").select("chunk_id", F.lower("text").alias("low"), F.length("text").alias("chars"))
    found = low.join(small(asked), F.contains("low", "phrase"))  # a stated set of queries against all rows, a block at a time
    scored = found.select("term", "chunk_id", lexical_score(F.col("low"), F.col("chars"), F.col("phrase")).alias("score"))
    return best_rows(scored, "chunk_id", depth)


def contribution(rank: Column) -> Column:
    return 1 / (FUSION_K + rank)


def fused(rankings: list[DataFrame], id_name: str) -> DataFrame:
    """Reciprocal rank fusion of lists (term, id, rank): a row that a list lacks gets nothing from it."""
    parts = [r.select("term", id_name, contribution(F.col("rank")).alias("part"), F.lit(i).alias("list")) for i, r in enumerate(rankings)]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    sums = [F.coalesce(F.sum(F.when(F.col("list") == i, F.col("part"))), F.lit(0.0)) for i in range(len(rankings))]
    total = sums[0]
    for s in sums[1:]:
        total = total + s
    return union.groupBy("term", id_name).agg(F.round(total, 9).alias("score"))


@dataclass(frozen=True)
class Rankings:
    """Ranked lists of one search."""

    dense: DataFrame
    lexical: DataFrame
    summary: DataFrame


def rank_all(notes: DataFrame, chunks: DataFrame, queries: DataFrame, depth: int = DEPTH) -> Rankings:
    """Dense, lexical and summary lists; the least score gates the first and the last."""
    dense = gated(dense_ranks(chunks.select("chunk_id", F.col("embedding").alias("vector")), queries, "chunk_id", depth), queries)
    summary = gated(dense_ranks(notes.select("note_id", F.col("summary_embedding").alias("vector")), queries, "note_id", depth), queries)
    return Rankings(dense, lexical_ranks(chunks.select("chunk_id", "text"), queries, depth), summary)


def best_chunks(chunk_scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each term and note the chunk with the highest fused score: term, note_id, chunk_id, score. Chunks without row are left out."""
    own = chunks.select("chunk_id", "note_id")
    order = Window.partitionBy("term", "note_id").orderBy(F.desc("score"), "chunk_id")
    return chunk_scores.join(own, "chunk_id").withColumn("n", F.row_number().over(order)).filter("n = 1").select("term", "note_id", "chunk_id", "score")


def note_scores(best: DataFrame, summary: DataFrame) -> DataFrame:
    """Best chunk's score plus the summary's, for notes of either list: term, note_id, chunk_id (-1 without chunk), score."""
    own = summary.select("term", "note_id", contribution(F.col("rank")).alias("part"))
    both = best.join(own, ["term", "note_id"], "full_outer")
    score = F.coalesce(F.col("score"), F.lit(0.0)) + F.coalesce(F.col("part"), F.lit(0.0))
    return both.select("term", "note_id", F.coalesce("chunk_id", F.lit(-1)).cast("long").alias("chunk_id"), F.round(score, 9).alias("score"))


def hybrid_search(notes: DataFrame, chunks: DataFrame, queries: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Best notes of each query, at most its ``top_n`` (or 10): term, rank, note_id, title, rel_path, chunk_id, score, summary, summary_status.

    Notes that only a summary found have chunk -1. Empty tables give no row.
    """
    queries = held(queries)
    lists = rank_all(notes, chunks, queries, depth)
    scored = note_scores(best_chunks(fused([lists.dense, lists.lexical], "chunk_id"), chunks), lists.summary)
    order = Window.partitionBy("term").orderBy(F.desc("score"), "note_id")
    wanted = small(queries.select("term", F.coalesce("top_n", F.lit(RESULTS)).alias("top_n")))
    best = scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < MOST_RESULTS).join(wanted, "term").filter("rank < top_n")
    label = F.when(F.col("summary_status") == 4, "ok").when(F.col("summary_status") == 5, "failed").otherwise("pending")
    details = notes.select("note_id", F.col("page_title").alias("title"), "rel_path", "summary", label.alias("summary_status"))
    return best.join(details, "note_id").select("term", "rank", "note_id", "title", "rel_path", "chunk_id", "score", "summary", "summary_status")


#: Results of a query at most: both lists together can't name more notes.
MOST_RESULTS = 3 * DEPTH


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the ``text`` of their chunk, null without one. Only the texts of hits are moved: the chunks are read against the
    hits' ids, held by every task while there are at most HELD_HITS. ``hits`` are read twice, so they should be settled."""
    ids = hits.select("chunk_id").filter("chunk_id >= 0").distinct()
    few = ids.limit(HELD_HITS + 1).count() <= HELD_HITS
    texts = chunks.select("chunk_id", "text").join(F.broadcast(ids) if few else ids, "chunk_id")
    return hits.join(texts, "chunk_id", "left")


def anchored(hits: DataFrame, chunks: DataFrame, excerpt: int = 500) -> DataFrame:
    """``hits`` with the excerpt they are shown with: the chunk without its title, or the summary's first line."""
    body = text.shortened(text.trimmed(text.without_title(F.col("text"), F.col("title"))), excerpt)
    return with_texts(hits, chunks).withColumn("excerpt", F.coalesce(body, first_line(F.col("summary")))).drop("text")


def first_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(text.lines(c), F.lit(1)), F.lit(""))


def snippets(hits: DataFrame, chunks: DataFrame, embed: Embedder, excerpt: int = 500) -> DataFrame:
    """``hits`` with ``unit``, ``unit_score`` and ``snippet``: the unit of the hit's chunk that is most like the query, or the chunk's first
    line of content where it has no unit, or the first line of the summary where there is no chunk.

    Units are top bullets, or the sections of a chunk without bullets, or its whole body; stubs, blanks and bare headings
    are left out. The first of equal units wins. ``embed`` turns units and terms into vectors. ``hits``: a row for each term and note.
    """
    read = with_texts(hits, chunks)
    found = read.filter("text is not null")
    body = text.without_title(F.col("text"), F.col("title"))

    def parts(body: Column) -> Column:
        bullets = F.transform(F.filter(text.top_units(body), lambda u: ~text.is_stub(u)), lambda u: F.array_join(u, "\n"))
        return text.let(bullets, lambda b: F.when(F.size(b) > 0, b).otherwise(F.split(body, r"(?m)(?=^\s*#+[ \t])", -1)))

    units = F.filter(text.let(body, parts), lambda u: (text.trimmed(u) != "") & ~text.is_heading_only(u))
    every = found.select("term", "title", "note_id", F.posexplode(units).alias("unit", "display"))
    shown = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), "display")
    scored = every.withColumn("score", F.round(vector.dot(embedded(shown, embed), embedded(F.col("term"), embed)), DIGITS))
    best = scored.groupBy("term", "note_id").agg(F.min_by(F.struct("unit", "score", "display"), F.struct(-F.col("score"), "unit")).alias("best"))
    of_chunk = F.coalesce("best.display", text.first_content_line(F.col("text"), F.col("title")))
    shown = F.when(F.col("text").isNotNull(), of_chunk).otherwise(first_line(F.col("summary")))
    joined = read.join(best, ["term", "note_id"], "left").withColumn("snippet", text.shortened(shown, excerpt))
    return joined.select(*hits.columns, F.col("best.unit").alias("unit"), F.col("best.score").alias("unit_score"), "snippet")
