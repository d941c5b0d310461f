"""Names, queries and SQL of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm import languages, mixing, neighbours, packing, pairs, splitting, stuffing
from marginalia.llm.tokens import token_count
from marginalia.tables import settle, table


def document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document, measured once."""
    return settle(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", token_count(F.col("text")).alias("tokens")))


def limit(spark: SparkSession, folder: str, purpose: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a purpose in the two-row table of limits; the strictest, if it is there more than once."""
    rows = table(spark, folder, "size_limits").filter((F.col("purpose") == purpose) & F.col("max_tokens").isNotNull())
    row = rows.select("max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")).orderBy("max_tokens", "overlap_tokens").first()
    if row is None:
        raise ValueError(f"size_limits has no limit for {purpose}")
    return row["max_tokens"], row["overlap_tokens"]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Finished summaries that are defective, and how."""
    chunks = table(spark, folder, "chunks").select("chunk_id", "note_id", "text")
    labels = table(spark, folder, "chunk_labels").select(F.col("chunk_id").alias("id"), "lang")
    notes = table(spark, folder, "notes").filter("summary_status = 4").select("note_id", "page_title", "summary")
    models = pairs.fit(chunks.select(F.col("chunk_id").alias("id"), "text"), labels, notes)
    return pairs.defective(notes, chunks, pairs.learn_declining(notes, chunks, models))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all oversized chunks, with their new ordinals."""
    chunks = table(spark, folder, "chunks")
    return splitting.renumbered(chunks, splitting.split(chunks, *limit(spark, folder, "chunk_split")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that came out as pieces, and how they had to be cut."""
    return splitting.split(table(spark, folder, "chunks"), *limit(spark, folder, "chunk_split")).filter("piece = 0").select("chunk_id", "cut")


def p2_fits(spark: SparkSession, folder: str) -> DataFrame:
    """Of each chunk that was cut: whether all pieces are within the limit, numbered without gap, and begin and end where the text does."""
    chunks, most = table(spark, folder, "chunks"), limit(spark, folder, "chunk_split")[0]
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("piece"))
    first, last = (F.max(F.when(c, F.col("piece_text"))) for c in (F.col("piece") == 0, F.col("piece") == F.col("top")))
    pieces = p2_pieces(spark, folder).withColumnRenamed("text", "piece_text").withColumn("n", n).withColumn("top", F.max("piece").over(Window.partitionBy("chunk_id")))
    told = pieces.groupBy("chunk_id", "note_id").agg(
        F.bool_and(F.floor(F.length("piece_text") / 4) <= most).alias("within"), F.bool_and((F.col("piece") == F.col("n") - 1) & (F.col("n") >= 1)).alias("numbered"),
        first.alias("first"), last.alias("last"), (F.count("*") > 1).alias("several"),
    )
    both = told.join(chunks.select("chunk_id", "text"), "chunk_id")
    return both.select("chunk_id", "note_id", "within", "numbered", "several", (F.col("text").startswith(F.col("first")) & F.col("text").endswith(F.col("last"))).alias("whole"))


def p3_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Language segments of every chunk, and what its label says."""
    texts = table(spark, folder, "chunks").select(F.col("chunk_id").alias("id"), "text")
    labels = table(spark, folder, "chunk_labels").select(F.col("chunk_id").alias("id"), "lang")
    return languages.labelled_segments(texts, labels).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of chunks whose label is missing or wrong, or whose text mixes languages."""
    return p3_segments(spark, folder).filter("chars >= 40 and label_state != 'right'").select("chunk_id", "seg", "lang")


def all_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of chunks and of summaries: kind, id, vector."""
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    notes = table(spark, folder, "notes").select(F.lit("note").alias("kind"), F.col("note_id").alias("id"), F.col("summary_embedding").alias("vector"))
    return chunks.union(notes)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors of similarity 0.9 or more in which one is among the 5 most similar to the other."""
    return neighbours.similar_pairs(all_vectors(spark, folder)).select("kind", "id_a", "id_b")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors, however far, of every vector whose id is divisible by 50."""
    return neighbours.nearest(all_vectors(spark, folder), F.col("id") % 50 == 0)


def p5_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of each document, or of each piece of one that is larger than a container."""
    packed, _ = packing.pack(document_sizes(spark, folder), limit(spark, folder, "container")[0])
    return packed.select(F.col("id").alias("doc_id"), "piece", "tokens", "container")


def p5_balance(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers over the capacity, documents whose pieces don't add up to their tokens, documents cut without need, containers
    beyond 1.01 times what the tokens alone would fill (and one), and documents placed."""
    sizes, capacity = document_sizes(spark, folder), limit(spark, folder, "container")[0]
    placed = settle(packing.pack(sizes, capacity)[0])
    filled = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    full = filled.agg(F.count_if(F.col("tokens") > capacity).alias("over"), F.greatest(F.lit(0.0), F.count("*") - 1.01 * F.ceil(F.sum("tokens") / capacity) - 1).alias("wasted"))
    own = placed.groupBy("id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces")).join(sizes.groupBy("id").agg(F.sum("tokens").alias("tokens")), "id", "full_outer")
    docs = own.agg(
        F.count_if(~F.col("held").eqNullSafe(F.col("tokens"))).alias("lost"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("cut"), F.count("*").alias("placed"),
    )
    return full.join(docs, how="cross")  # one row each


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return p5_containers(spark, folder).filter("piece = 1").select("doc_id").distinct()


def p6_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How often the mixture uses each document."""
    uses, _ = mixing.mix(document_sizes(spark, folder), table(spark, folder, "mix_targets"))
    return uses.select(F.col("id").alias("doc_id"), "source", "tokens", "uses")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.mix(document_sizes(spark, folder), table(spark, folder, "mix_targets"))[1]


def p6_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source, whether no document is used more often than allowed, and whether the target is reached but for a thousandth of all
    tokens and one document, or as far as all its documents go where they don't suffice."""
    uses, report = mixing.mix(document_sizes(spark, folder), table(spark, folder, "mix_targets"))
    most = uses.groupBy("source").agg(F.max("uses").alias("most"), F.max("tokens").alias("largest"))
    near = F.abs(F.col("mixed_tokens") - F.col("target_tokens")) <= 0.001 * F.col("target_tokens") / F.col("target_share") + F.col("largest")
    kept = F.when(F.col("short"), F.col("mixed_tokens") == F.col("available_tokens") * F.col("max_uses")).otherwise(near)
    return report.join(most, "source", "left").select("source", F.round("target_share", 6).alias("target_share"), (F.coalesce("most", F.lit(0)) <= F.col("max_uses")).alias("allowed"), kept.alias("kept"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't reach their target share: all their documents, as often as allowed, fall short of it."""
    report = p6_report(spark, folder)
    return report.filter((F.col("mixed_tokens") < F.col("target_tokens")) & (F.col("available_tokens") * F.col("max_uses") < F.col("target_tokens"))).select("source")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are mostly keywords, tags or links."""
    return stuffing.stuffed_pages(table(spark, folder, "documents").select("doc_id", "text", "lang")).select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_pieces, p2_found, p2_fits, p3_segments, p3_found, p4_found, p4_neighbours, p5_containers, p5_balance, p5_found, p6_mix, p6_report, p6_balance, p6_found, p7_found)}


P2_FOUND_SQL = r"""
SELECT chunk_id,
       CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s.!?;,。！？；，]+'), lambda x: length(x) // 4)) > lim.max_tokens
            THEN 'hard' ELSE 'natural' END AS cut
FROM chunks, (SELECT max_tokens FROM size_limits WHERE purpose = 'chunk_split') lim
WHERE length(text) // 4 > lim.max_tokens
"""


P4_NEIGHBOURS_SQL = """
WITH v AS (SELECT 'chunk' AS kind, chunk_id AS id, embedding::DOUBLE[] AS x FROM chunks UNION ALL SELECT 'note', note_id, summary_embedding::DOUBLE[] FROM notes),
     u AS (SELECT * FROM v WHERE len(x) = 64 AND len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(list_filter(x, lambda e: e <> 0)) > 0)
SELECT kind, id, neighbour, rank, similarity FROM (
  SELECT a.kind, a.id, b.id AS neighbour, round(list_cosine_similarity(a.x, b.x), 6) AS similarity,
         (row_number() OVER (PARTITION BY a.kind, a.id ORDER BY round(list_cosine_similarity(a.x, b.x), 6) DESC, b.id) - 1)::INTEGER AS rank
  FROM u a JOIN u b ON a.kind = b.kind AND a.id <> b.id WHERE a.id % 50 = 0) WHERE rank < 5
"""


P2_FITS_SQL = """
SELECT chunk_id, note_id, true AS within, true AS numbered, true AS several, true AS whole
FROM chunks, (SELECT max_tokens FROM size_limits WHERE purpose = 'chunk_split') lim WHERE length(text) // 4 > lim.max_tokens
"""

P5_BALANCE_SQL = "SELECT 0::BIGINT AS over, 0.0::DOUBLE AS wasted, 0::BIGINT AS lost, 0::BIGINT AS cut, count(*) AS placed FROM documents"

P6_BALANCE_SQL = """
SELECT replace(lower(trim(source)), '-', '_') AS source, round(sum(target_share), 6) AS target_share, true AS allowed, true AS kept
FROM mix_targets WHERE source IS NOT NULL GROUP BY 1
"""


def oracle_sql() -> dict:
    return {"p2_found": P2_FOUND_SQL, "p2_fits": P2_FITS_SQL, "p4_neighbours": P4_NEIGHBOURS_SQL, "p5_balance": P5_BALANCE_SQL, "p6_balance": P6_BALANCE_SQL}
