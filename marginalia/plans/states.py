"""Queries of chunking, scans, summary states and answers, each with its SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.vector import is_usable
from marginalia.functions.embedding import hashed_words
from marginalia.operators import answers, chunking, rescan, state, summarize
from marginalia.plans import note_sql, searches
from marginalia.plans.scalars import EMBEDDED, TOP_SQL, sql_lines, sql_trimmed
from marginalia.sources import vault
from marginalia.tables import scratch, table

NOTE = ("note_id", "rel_path", "page_title", "mtime", "chunker_version", "summary", "summary_status", "summary_attempts")


def notes_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "notes")


def shown(notes: DataFrame) -> DataFrame:
    """A note state with what can be compared at a glance."""
    return notes.select(*NOTE, F.col("summary_embedding").isNotNull().alias("has_vector"))


def titled(spark: SparkSession, folder: str) -> DataFrame:
    scans = state.latest_scan(table(spark, folder, "raw_notes"))
    return scans.withColumn("title", text.page_title(F.col("rel_path"))).withColumn("outline", F.col("rel_path").rlike("^(pages|journals)/"))


def top_level_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_notes").distinct()
    return rows.select("rel_path", "mtime", F.posexplode(F.transform(text.top_units(F.col("content")), lambda u: F.array_join(u, "\n"))).alias("unit", "lines"))


def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "raw_notes").distinct().select("rel_path", "mtime", F.posexplode(text.lines(F.col("content"))).alias("pos", "line"))
    return rows.filter(text.is_heading(F.col("line")))


def chunk_notes(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(titled(spark, folder))


def chunk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each note's newest scan: chunks, and their longest in tokens."""
    return chunk_notes(spark, folder).groupBy("rel_path").agg(F.count("*").alias("chunks"), F.max(text.tokens(F.col("text"))).alias("most_tokens"))


def embed_batches(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.embedding_batches(table(spark, folder, "chunks"))


def latest_scan(spark: SparkSession, folder: str) -> DataFrame:
    return state.latest_scan(table(spark, folder, "raw_notes"))


def scan_diff(spark: SparkSession, folder: str) -> DataFrame:
    return state.scan_changes(notes_of(spark, folder), table(spark, folder, "raw_notes")).select("rel_path", "note_id", "change", "mtime")


def upsert_notes(spark: SparkSession, folder: str) -> DataFrame:
    notes = notes_of(spark, folder)
    return shown(state.upserted(notes, state.scan_changes(notes, table(spark, folder, "raw_notes"))))


def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that stay when the notes of the archive are deleted."""
    gone = notes_of(spark, folder).filter(F.col("rel_path").startswith("archive/"))
    return state.removed(table(spark, folder, "chunks").select("chunk_id", "note_id", "ord"), gone, "note_id")


def replace_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table after a scan: reindexed notes' chunks come from their new content."""
    notes, chunks = notes_of(spark, folder), table(spark, folder, "chunks")
    changed = state.scan_changes(notes, table(spark, folder, "raw_notes")).filter("change = 'reindex'").select("rel_path", "note_id")
    fresh = chunking.chunk(titled(spark, folder).join(changed, "rel_path", "left_semi")).join(changed, "rel_path").select("note_id", "ord", "text")
    after = state.replaced_chunks(chunks, changed, fresh)
    return after.join(F.broadcast(chunks.agg(F.max("chunk_id").alias("last"))), how="cross").select(
        F.when(F.col("chunk_id") <= F.col("last"), F.col("chunk_id")).alias("chunk_id"), "note_id", "ord", "text"
    )


def list_paths(spark: SparkSession, folder: str) -> DataFrame:
    return notes_of(spark, folder).select("rel_path").distinct()


def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks without note, and notes without chunk."""
    notes, chunks = notes_of(spark, folder), table(spark, folder, "chunks")
    lost = state.removed(chunks, notes, "note_id").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    return lost.union(state.removed(notes, chunks, "note_id").select(F.lit("note"), "note_id"))


def summary_counts(spark: SparkSession, folder: str) -> DataFrame:
    return state.counts(notes_of(spark, folder))


def index_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: notes, notes with chunks, chunks, usable vectors."""
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), "note_id", is_usable(F.col("embedding"), searches.WIDTH).alias("usable"))
    rows = chunks.union(notes_of(spark, folder).select(F.lit("note"), "note_id", F.lit(False)))
    is_chunk = F.col("kind") == "chunk"
    return rows.agg(
        F.count_if(~is_chunk).alias("total_notes"), F.count_distinct(F.when(is_chunk, F.col("note_id"))).alias("indexed_notes"),
        F.count_if(is_chunk).alias("indexed_chunks"), F.count_if("usable").alias("usable_vectors"),
    )


def next_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The 256 notes that are summarized next."""
    return state.candidates(notes_of(spark, folder), 256).select("note_id", "summary_status", "summary_attempts")


def changed_by(changes):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return shown(notes_of(spark, folder).withColumns(changes()))

    return query


promote_high = changed_by(state.promoted)
record_failure = changed_by(lambda: state.only_where(F.col("summary_status") == state.RUNNING, state.failed_once()))
reset_running = changed_by(state.recovered)
requeue_missing = changed_by(lambda: state.only_where(state.lacks_vector(), state.started_over()))
requeue_junk = changed_by(lambda: state.only_where((F.col("summary_status") == state.OK) & text.is_junk_summary(F.col("summary")), state.started_over()))


def mark_unsummarizable(spark: SparkSession, folder: str) -> DataFrame:
    """The notes after those whose newest scan has too little prose were given up."""
    prose = titled(spark, folder).select("rel_path", text.narrative_chars(F.col("content"), F.col("outline")).alias("chars"))
    return shown(notes_of(spark, folder).join(prose, "rel_path", "left").withColumns(state.only_where(F.col("chars") < text.SUMMARY_CHARS, state.unsummarizable())))


save_summary = changed_by(lambda: state.only_where(F.col("summary_status") == state.RUNNING, state.saved(F.concat(F.lit("About "), "page_title"), F.array(F.lit(1.0).cast("float")))))


def list_summarized(spark: SparkSession, folder: str) -> DataFrame:
    return notes_of(spark, folder).filter("summary is not null or summary_embedding is not null").select("note_id", "summary_status")


def scrub_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What a scrub of the stored summaries does to each note that was scanned: purge (too little prose), requeue (junk), keep."""
    prose = titled(spark, folder).select("rel_path", text.narrative_chars(F.col("content"), F.col("outline")).alias("chars"))
    stored = notes_of(spark, folder).filter("summary is not null or summary_embedding is not null")
    action = F.when(F.col("chars") < text.SUMMARY_CHARS, "purge").when(F.coalesce(text.is_junk_summary(F.col("summary")), F.lit(False)), "requeue").otherwise("keep")
    return stored.join(prose, "rel_path").select("note_id", action.alias("action"))


def answers_assembled(spark: SparkSession, folder: str) -> DataFrame:
    return answers.assembled(table(spark, folder, "ask_events")).select("ask_id", "question", F.size("sources").alias("sources"), "answer", "failed", "late")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    checked = answers.checked_citations(answers.assembled(table(spark, folder, "ask_events")))
    return checked.select("ask_id", *(F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in ("cited", "invalid")), "answered", "claim_holds")


def cited_notes(spark: SparkSession, folder: str) -> DataFrame:
    return answers.cited_notes(answers.checked_citations(answers.assembled(table(spark, folder, "ask_events"))), notes_of(spark, folder))


def protocol_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return answers.protocol_breaks(table(spark, folder, "ask_events"))


def question_check(spark: SparkSession, folder: str) -> DataFrame:
    asked = answers.assembled(table(spark, folder, "ask_events")).select("ask_id", "question")
    return answers.valid_questions(asked).select("ask_id", "error")


def ask_context(spark: SparkSession, folder: str) -> DataFrame:
    return answers.contexts(searches.hybrid_search(spark, folder), table(spark, folder, "chunks"))


QUERIES = {
    f.__name__: f
    for f in (
        top_level_units, heading_lines, chunk_notes, chunk_coverage, embed_batches, latest_scan, scan_diff, upsert_notes, delete_cascade, replace_chunks,
        list_paths, orphan_chunks, summary_counts, index_status, next_candidates, list_summarized, scrub_summaries,
        answers_assembled, citations, cited_notes, protocol_breaks, question_check, ask_context,
    )
} | {
    "promote_high": promote_high, "record_failure": record_failure, "reset_running": reset_running, "requeue_missing": requeue_missing,
    "requeue_junk": requeue_junk, "mark_unsummarizable": mark_unsummarizable, "save_summary": save_summary,
}


LATEST = "SELECT rel_path, mtime, content FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY mtime DESC, scanned_at DESC, content DESC) AS n FROM raw_notes WHERE content IS NOT NULL) WHERE n = 1"
CHANGES = f"""
SELECT coalesce(n.rel_path, s.rel_path) AS rel_path, note_id, CASE WHEN note_id IS NULL THEN 'new' WHEN content IS NULL THEN 'missing'
  WHEN chunker_version IS NOT DISTINCT FROM 6 AND s.mtime IS NOT DISTINCT FROM n.mtime THEN 'unchanged'
  WHEN chunker_version IS NOT DISTINCT FROM 6 AND unhex(sha256(content)) IS NOT DISTINCT FROM content_hash THEN 'touch' ELSE 'reindex' END AS change, s.mtime, content
FROM notes n FULL JOIN ({LATEST}) s ON n.rel_path = s.rel_path"""


def state_sql(where: str = "true", source: str = "notes", **changes: str) -> str:
    columns = {c: c for c in NOTE} | {"has_vector": "summary_embedding IS NOT NULL"} | {}
    return f"SELECT {', '.join(f'CASE WHEN {where} THEN {changes[c]} ELSE {e} END AS {c}' if c in changes else f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


OVER = {"summary": "NULL", "summary_status": "1", "summary_attempts": "0", "has_vector": "false"}
JUNK = "lower(regexp_replace(summary, '^[\"''().:*\\-\\s\\x{A0}]+|[\"''().:*\\-\\s\\x{A0}]+$', '', 'g'))"
UNIT_LINES = f"(SELECT rel_path, mtime, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT rel_path, mtime, {sql_lines('content')} AS l FROM (SELECT DISTINCT * FROM raw_notes)))"
META = "max(CASE WHEN event = 'meta' THEN data END)"
EVENTS = f"""
SELECT ask_id, {META} AS meta, max(CASE WHEN event = 'done' THEN data END) AS done, bool_or(event = 'error') AS failed,
  coalesce(string_agg(CASE WHEN event = 'delta' THEN data ->> '$.text' END, '' ORDER BY seq), '') AS answer,
  count(*) FILTER (received_at > sent_at + INTERVAL 1 MINUTE) AS late
FROM (SELECT DISTINCT * FROM ask_events) GROUP BY ask_id"""
CHECKED = f"""
SELECT *, coalesce(list_filter(named, lambda x: list_contains(known, x)), []) AS cited, coalesce(list_filter(named, lambda x: NOT list_contains(known, x)), []) AS invalid FROM (
  SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::INT))) AS named,
    coalesce((meta -> '$.sources[*].n')::INT[], []) AS known FROM ({EVENTS}))"""

SQL = {
    "top_level_units": f"SELECT rel_path, mtime, (dense_rank() OVER (PARTITION BY rel_path, mtime, content ORDER BY unit) - 1)::INTEGER AS unit, lines FROM (SELECT rel_path, mtime, '' AS content, unit, string_agg(line, chr(10) ORDER BY pos) AS lines FROM (SELECT *, sum({TOP_SQL}::INT) OVER (PARTITION BY rel_path, mtime ORDER BY pos) AS unit FROM {UNIT_LINES}) WHERE unit > 0 GROUP BY ALL)",
    "heading_lines": f"SELECT rel_path, mtime, (pos - 1)::INTEGER AS pos, line FROM {UNIT_LINES} WHERE regexp_matches(line, '^[\\s\\x{{A0}}]*#+[ \\t]')",
    "latest_scan": LATEST,
    "scan_diff": f"SELECT rel_path, note_id, change, mtime FROM ({CHANGES})",
    "upsert_notes": state_sql(
        "change = 'reindex'", f"(SELECT n.* EXCLUDE (mtime), CASE WHEN change IN ('reindex', 'touch') THEN c.mtime ELSE n.mtime END AS mtime, change FROM notes n LEFT JOIN ({CHANGES}) c USING (rel_path))",
        chunker_version="6", **OVER,
    ),
    "delete_cascade": "SELECT chunk_id, note_id, ord FROM chunks WHERE note_id NOT IN (SELECT note_id FROM notes WHERE starts_with(rel_path, 'archive/'))",
    "list_paths": "SELECT DISTINCT rel_path FROM notes",
    "orphan_chunks": "SELECT 'chunk' AS kind, chunk_id AS id FROM chunks ANTI JOIN notes USING (note_id) UNION ALL SELECT 'note', note_id FROM notes ANTI JOIN chunks USING (note_id)",
    "summary_counts": "SELECT count(*) AS total, count(*) FILTER (summary_status = 4) AS ok, count(*) FILTER (summary_status = 5) AS failed, count(*) - count(*) FILTER (summary_status = 4) - count(*) FILTER (summary_status = 5) AS pending FROM notes",
    "index_status": f"SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(DISTINCT note_id) FROM chunks) AS indexed_notes, (SELECT count(*) FROM chunks) AS indexed_chunks, (SELECT count(*) FROM ({searches.SQL['usable_vectors']})) AS usable_vectors",
    "next_candidates": "SELECT note_id, summary_status, summary_attempts FROM notes WHERE summary_status IN (0, 1, 2) AND summary_attempts < 3 ORDER BY summary_status = 2 DESC, note_id LIMIT 256",
    "list_summarized": "SELECT note_id, summary_status FROM notes WHERE summary IS NOT NULL OR summary_embedding IS NOT NULL",
    "promote_high": state_sql("summary_status IN (0, 1)", summary_status="2"),
    "record_failure": state_sql("summary_status = 3", summary_attempts="summary_attempts + 1", summary_status="CASE WHEN summary_attempts + 1 >= 3 THEN 5 ELSE 0 END"),
    "reset_running": state_sql("summary_status = 3", summary_status="1"),
    "requeue_missing": state_sql("summary_status = 4 AND summary IS NOT NULL AND summary_embedding IS NULL", **OVER),
    "requeue_junk": state_sql(f"summary_status = 4 AND {JUNK} IN ({', '.join(chr(39) + j + chr(39) for j in text.JUNK_SUMMARIES)})", **OVER),
    "save_summary": state_sql("summary_status = 3", summary="'About ' || page_title", summary_status="4", has_vector="true"),
    "answers_assembled": f"SELECT ask_id, meta ->> '$.question' AS question, coalesce(json_array_length(meta -> '$.sources'), NULL)::INTEGER AS sources, answer, failed, late FROM ({EVENTS})",
    "citations": f"SELECT ask_id, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, len(cited) > 0 AS answered, list_sort(coalesce((done -> '$.cited')::INT[], [])) = cited AS claim_holds FROM ({CHECKED})",
    "cited_notes": f"SELECT ask_id, (s ->> '$.n')::INT AS n, (s ->> '$.note_id')::BIGINT AS note_id, s ->> '$.title' AS title, coalesce(replace(page_title, '%2F', '/') = replace(s ->> '$.title', '%2F', '/'), false) AS known FROM (SELECT ask_id, cited, unnest(meta -> '$.sources[*]') AS s FROM ({CHECKED})) LEFT JOIN (SELECT note_id AS stored, page_title FROM notes) ON stored = (s ->> '$.note_id')::BIGINT WHERE list_contains(cited, (s ->> '$.n')::INT)",
    "protocol_breaks": "SELECT * FROM (SELECT ask_id, string_agg(CASE event WHEN 'meta' THEN 'm' WHEN 'delta' THEN 't' WHEN 'done' THEN 'd' WHEN 'error' THEN 'e' ELSE '?' END, '' ORDER BY seq, CASE event WHEN 'meta' THEN 'm' WHEN 'delta' THEN 't' WHEN 'done' THEN 'd' WHEN 'error' THEN 'e' ELSE '?' END) AS events FROM (SELECT DISTINCT * FROM ask_events) GROUP BY ask_id) WHERE NOT regexp_matches(events, '^(mt*d|mt*e|e)$')",
    "question_check": f"SELECT ask_id, CASE WHEN coalesce({sql_trimmed('q')}, '') = '' THEN 'empty' WHEN length({sql_trimmed('q')}) > 4000 THEN 'too long' END AS error FROM (SELECT ask_id, meta ->> '$.question' AS q FROM ({EVENTS}))",
}


def first_sentence(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: the first line of the page that isn't blank."""
    pages = (p.split("\nContent:\n", 1)[-1].rsplit("\nSummary:", 1)[0] for p in prompts)
    return [next((row.strip(" \t-*>#") for row in page.split("\n") if row.strip(" \t-*>#")), None) for page in pages]


def summarize_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of summarizing each note's newest scan with a stand-in for a model."""
    pages = titled(spark, folder).withColumn("note_id", F.xxhash64("rel_path"))
    out = summarize.summarized(pages, first_sentence, hashed_words(64)).join(pages.select("note_id", "rel_path"), "note_id")
    return out.select("rel_path", "outcome", "summary", F.size("vector").alias("width"))


def stream_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Text of each recorded delta, from the lines that a model would have streamed it in."""
    delta = F.get_json_object("data", "$.text")
    line = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    body = F.concat(F.lit(": hello\n"), line(delta), F.lit("data: nothing\n"), line(F.lit("!")), F.lit("data: [DONE]\n"), line(F.lit("?")))
    rows = table(spark, folder, "ask_events").distinct().filter("event = 'delta' and data is not null")
    return rows.select("ask_id", "seq", summarize.stream_text(body).alias("text"))


QUERIES |= {"summarize_scans": summarize_scans, "stream_answers": stream_answers}
SQL |= {"stream_answers": "SELECT ask_id, seq, (data ->> '$.text') || '!' AS text FROM (SELECT DISTINCT * FROM ask_events) WHERE event = 'delta' AND data IS NOT NULL"}


def looked_up_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that some recorded answer was given as a source."""
    wanted = answers.assembled(table(spark, folder, "ask_events")).select(F.explode("sources").alias("s")).select("s.note_id")
    return notes_of(spark, folder).join(wanted.distinct(), "note_id", "left_semi").select("note_id", "page_title", "rel_path")


def linked_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers as HTML with links to their sources."""
    told = answers.assembled(table(spark, folder, "ask_events"))
    return told.select("ask_id", answers.linked_citations(F.col("answer"), F.col("sources.n")).alias("html"))


def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Of each link that search results carry, whether a note is stored where it leads."""
    hits = searches.hybrid_search(spark, folder).select("note_id", "link").distinct()
    file = F.try_url_decode(F.regexp_extract("link", "&file=(.*)$", 1))
    known = notes_of(spark, folder).select(text.percent_decoded(F.col("rel_path")).alias("path"), F.lit(True).alias("known")).distinct()
    led = hits.withColumn("path", F.concat(file, F.lit(".md"))).join(known, "path", "left")
    return led.select("note_id", F.coalesce("known", F.lit(False)).alias("known"))


def link_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Links of documents that carry an id: host, id, how many documents link there."""
    urls = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(https?://[^\s()<>|\[\]]+)"), F.lit(1)))).alias("url")
    read = table(spark, folder, "documents").select("doc_id", urls)
    asked = read.select("doc_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"[?&]id=(\d+)", 1).alias("id"))
    return asked.filter("id != ''").groupBy("host", "id").agg(F.count_distinct("doc_id").alias("documents"))


def search_highlights(spark: SparkSession, folder: str) -> DataFrame:
    """Highlights of the first three hits of each query, with a stand-in for a model."""
    hits = searches.hybrid_search(spark, folder).filter("rank < 3")
    stored = notes_of(spark, folder).select("note_id", "rel_path")
    pages = state.latest_scan(table(spark, folder, "raw_notes")).join(stored, "rel_path").select("note_id", "content")
    return answers.highlights(hits, table(spark, folder, "chunks"), pages, longest_line)


def longest_line(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: the page's longest line."""
    return [max(p.split("\nPage:\n", 1)[-1].split("\n"), key=len) for p in prompts]


def debug_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Of each note's newest scan, one text with what was read, what is left of it, and its chunks."""
    read = titled(spark, folder)
    chunks = chunking.chunk(read).groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("chunks"))  # the chunks of one note
    left = F.when(F.col("outline"), text.outline_text(F.col("content"))).otherwise(text.prose_text(F.col("content")))
    parts = F.concat(F.lit("=== read\n"), "content", F.lit("\n=== left\n"), left, F.lit("\n=== chunks\n"), F.coalesce(F.array_join(F.col("chunks.text"), "\n---\n"), F.lit("")))
    return read.join(chunks, "rel_path", "left").select("rel_path", parts.alias("dump"))


QUERIES |= {f.__name__: f for f in (looked_up_notes, linked_answers, link_targets, link_parameters, search_highlights, debug_dump)}
SQL |= {
    "looked_up_notes": f"SELECT note_id, page_title, rel_path FROM notes WHERE note_id IN (SELECT unnest((meta -> '$.sources[*].note_id')::BIGINT[]) FROM ({EVENTS}) WHERE meta IS NOT NULL)",
    "link_targets": f"SELECT DISTINCT note_id, url_decode(regexp_extract(link, '&file=(.*)$', 1)) || '.md' IN (SELECT url_decode(rel_path) FROM notes) AS known FROM ({searches.SQL['hybrid_search']})",
    "link_parameters": r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]id=(\d+)', 1) AS id, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(https?://[^\s()<>|\[\]]+)', 1)) AS url FROM documents) WHERE regexp_matches(url, '[?&]id=\d') GROUP BY ALL",
}


EXCERPTS = f"(SELECT h.*, CASE WHEN starts_with(text, '# ' || title || chr(10) || chr(10)) THEN substr(text, length(title) + 5) ELSE text END AS body FROM ({searches.SQL['hybrid_search']}) h LEFT JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id))"
TRIMMED = sql_trimmed("body")
SQL |= {
    "search_excerpts": f"SELECT term, rank, note_id, chunk_id, coalesce(CASE WHEN length({TRIMMED}) > 500 THEN left({TRIMMED}, 500) || '…' ELSE {TRIMMED} END, ({sql_lines('summary')})[1], '') AS excerpt FROM {EXCERPTS}",
    "ask_context": f"""
SELECT term, count(*)::INTEGER AS sources, string_agg('[' || (rank + 1) || '] ' || coalesce(title, '') || coalesce(chr(10) || 'Summary: ' || summary, '')
    || coalesce(chr(10) || 'Excerpt: ' || CASE WHEN length({TRIMMED}) > 2400 THEN left({TRIMMED}, 2400) || chr(10) || '…[truncated]' ELSE {TRIMMED} END, ''), chr(10) || chr(10) ORDER BY rank) AS context,
  CASE WHEN max(score) < 0.02 THEN 'low' ELSE 'high' END AS confidence FROM {EXCERPTS} WHERE rank < 8 GROUP BY term""",
    "embed_batches": f"""
WITH RECURSIVE sized AS (
  SELECT note_id, ord, chunk_id, coalesce({EMBEDDED} + (length(text) - {EMBEDDED}) // 4, 0)::BIGINT AS tokens, row_number() OVER (PARTITION BY note_id ORDER BY ord, chunk_id) AS n FROM chunks),
packed AS (
  SELECT *, 0 AS batch, 1 AS held, tokens AS total FROM sized WHERE n = 1
  UNION ALL
  SELECT s.*, CASE WHEN full_ THEN batch + 1 ELSE batch END, CASE WHEN full_ THEN 1 ELSE held + 1 END, CASE WHEN full_ THEN s.tokens ELSE total + s.tokens END
  FROM (SELECT p.note_id, p.n, p.batch, p.held, p.total FROM packed p) p JOIN sized s ON s.note_id = p.note_id AND s.n = p.n + 1, LATERAL (SELECT p.total + s.tokens > 7000 OR p.held >= 32 AS full_) f)
SELECT note_id, ord, chunk_id, tokens, batch FROM packed""",
}


def claim_next(spark: SparkSession, folder: str) -> DataFrame:
    """The notes after the next 16 were claimed for summarizing."""
    notes = notes_of(spark, folder)
    chosen = state.candidates(notes, 16).select("note_id", F.lit(True).alias("chosen"))
    return shown(notes.join(F.broadcast(chosen), "note_id", "left").withColumns(state.only_where(F.col("chosen"), state.claimed())))


def rescanned(spark: SparkSession, folder: str) -> rescan.Rescan:
    notes, chunks = notes_of(spark, folder), table(spark, folder, "chunks")
    return rescan.rescan(notes, chunks, table(spark, folder, "raw_notes"), F.col("rel_path").rlike("^(pages|journals)/"))


def rescan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes after a scan of the whole vault: what it didn't find is gone."""
    return shown(rescanned(spark, folder).notes)


def rescan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that a scan of the whole vault leaves as they are."""
    after = rescanned(spark, folder)
    old = after.changes.filter("change in ('touch', 'unchanged')").select("note_id")
    return after.chunks.join(old, "note_id", "left_semi").select("chunk_id", "note_id", "ord", "text")


def cites_first(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: cites the first source and one that isn't there."""
    return ["See [1], not [9]." for _ in prompts]


def ask_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each stored query asked: what was found, what a stand-in for a model said to it, and what that cites."""
    told = answers.asked(ask_context(spark, folder), cites_first)
    return told.select("term", "sources", "confidence", "error", "answer", *(F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in ("cited", "invalid")), "answered")


def ask_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event streams of those answers."""
    return answers.answer_events(answers.asked(ask_context(spark, folder), cites_first)).select("term", "seq", "event", F.get_json_object("data", "$.text").alias("text"))


def broken_streams(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers whose events break the protocol once their first event is lost."""
    events = table(spark, folder, "ask_events")
    firsts = events.groupBy("ask_id").agg(F.min("seq").alias("first"))
    return answers.protocol_breaks(events.join(firsts, "ask_id").filter("seq > first").drop("first"))


QUERIES |= {f.__name__: f for f in (claim_next, rescan_notes, rescan_chunks, ask_answers, ask_events, broken_streams)}
RESCANNED = f"(SELECT * FROM ({CHANGES}) WHERE rel_path NOT IN (SELECT rel_path FROM raw_notes GROUP BY rel_path HAVING count(content) = 0))"
CODES = "string_agg(CASE event WHEN 'meta' THEN 'm' WHEN 'delta' THEN 't' WHEN 'done' THEN 'd' WHEN 'error' THEN 'e' ELSE '?' END, '' ORDER BY seq)"
SQL |= {
    "claim_next": state_sql("note_id IN (SELECT note_id FROM notes WHERE summary_status IN (0, 1, 2) AND summary_attempts < 3 ORDER BY summary_status = 2 DESC, note_id LIMIT 16)", summary_status="3"),
    "rescan_notes": state_sql(
        "change = 'reindex'", f"(SELECT n.* EXCLUDE (mtime), CASE WHEN change IN ('reindex', 'touch') THEN c.mtime ELSE n.mtime END AS mtime, change FROM notes n LEFT JOIN {RESCANNED} c USING (rel_path) WHERE change IS DISTINCT FROM 'missing')",
        chunker_version="6", **OVER,
    ),
    "rescan_chunks": f"SELECT chunk_id, note_id, ord, text FROM chunks WHERE note_id IN (SELECT note_id FROM {RESCANNED} WHERE change IN ('touch', 'unchanged'))",
    "ask_answers": f"SELECT term, sources, confidence, NULL::VARCHAR AS error, 'See [1], not [9].' AS answer, '1' AS cited, '9' AS invalid, true AS answered FROM ({SQL['ask_context']})",
    "ask_events": f"SELECT term, unnest([0, 1, 2])::INTEGER AS seq, unnest(['meta', 'delta', 'done']) AS event, unnest([NULL, 'See [1], not [9].', NULL]) AS text FROM ({SQL['ask_context']})",
    "broken_streams": f"SELECT * FROM (SELECT ask_id, {CODES} AS events FROM (SELECT DISTINCT * FROM ask_events) e JOIN (SELECT ask_id, min(seq) AS first FROM ask_events GROUP BY ask_id) f USING (ask_id) WHERE seq > first GROUP BY ask_id) WHERE NOT regexp_matches(events, '^(mt*d|mt*e|e)$')",
    "linked_answers": """
SELECT ask_id, list_reduce(list_prepend(escaped, list_transform(known, lambda x: '[' || x || ']')), lambda html, m: replace(html, m, '<a href="#source-' || m[2:-2] || '">' || m || '</a>')) AS html
FROM (SELECT ask_id, known, replace(replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM (""" + CHECKED + "))",
}


def insert_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes after a scan that finds those of the pages folder for the first time."""
    known = notes_of(spark, folder).filter(~F.col("rel_path").startswith("pages/"))
    return shown(state.upserted(known, state.scan_changes(known, table(spark, folder, "raw_notes")))).drop("note_id")


QUERIES |= {"insert_notes": insert_notes}
CHUNKS = note_sql.chunks_sql(LATEST)
SCANNED = note_sql.outlined(f"({LATEST})")
ONLY_NEW = f"""
SELECT * EXCLUDE (note_id) FROM ({SQL["upsert_notes"]}) WHERE NOT starts_with(rel_path, 'pages/')
UNION ALL
SELECT rel_path, {searches.TITLE_SQL}, mtime, 6, NULL, 1, 0, false FROM (SELECT *, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM ({LATEST})) WHERE starts_with(rel_path, 'pages/')"""
SQL |= {
    "insert_notes": ONLY_NEW,
    "chunk_notes": CHUNKS,
    "chunk_coverage": f"SELECT rel_path, count(*) AS chunks, max(length(text) // 4)::BIGINT AS most_tokens FROM ({CHUNKS}) GROUP BY rel_path",
    "scrub_summaries": f"""
SELECT note_id, CASE WHEN chars < {text.SUMMARY_CHARS} THEN 'purge' WHEN coalesce({JUNK} IN ({', '.join(chr(39) + j + chr(39) for j in text.JUNK_SUMMARIES)}), false) THEN 'requeue' ELSE 'keep' END AS action
FROM (SELECT * FROM notes WHERE summary IS NOT NULL OR summary_embedding IS NOT NULL) JOIN (SELECT rel_path, {note_sql.narrative()} AS chars FROM {SCANNED}) USING (rel_path)""",
    "debug_dump": f"""
SELECT rel_path, '=== read' || chr(10) || content || chr(10) || '=== left' || chr(10) || CASE WHEN {note_sql.IS_OUTLINE} THEN plain ELSE {note_sql.SHARED_SQL} END || chr(10) || '=== chunks' || chr(10) || coalesce(chunks, '') AS dump
FROM {SCANNED} LEFT JOIN (SELECT rel_path, string_agg(text, chr(10) || '---' || chr(10) ORDER BY ord) AS chunks FROM ({CHUNKS}) GROUP BY rel_path) USING (rel_path)""",
}


HIT_TEXTS = f"SELECT h.*, text, CASE WHEN starts_with(text, '# ' || title || chr(10) || chr(10)) THEN substr(text, length(title) + 5) ELSE text END AS body FROM ({searches.SQL['hybrid_search']}) h LEFT JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id)"
MARKS = "' ' || chr(9) || '-*>#'"
PAGE = f"CASE WHEN {note_sql.IS_OUTLINE} THEN plain ELSE {note_sql.SHARED_SQL} END"
LONGEST = sql_trimmed(f"list_reduce(string_split(left(page, {answers.HIGHLIGHT_PAGE}), chr(10)), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)")
SQL |= {
    "search_snippets": note_sql.snippets_sql(HIT_TEXTS, 6, searches.WIDTH, 500),
    "summarize_scans": f"""
SELECT rel_path, CASE WHEN chars < {text.SUMMARY_CHARS} THEN 'skipped' WHEN answer IS NULL OR {JUNK.replace('summary', 'answer')} IN ({', '.join(chr(39) + j + chr(39) for j in text.JUNK_SUMMARIES)}) THEN 'failed' ELSE 'ok' END AS outcome,
  CASE WHEN outcome = 'ok' THEN answer END AS summary, CASE WHEN outcome = 'ok' THEN 64 END AS width
FROM (SELECT rel_path, {note_sql.narrative()} AS chars, {sql_trimmed(f"list_filter(list_transform(string_split({PAGE}, chr(10)), lambda r: trim(r, {MARKS})), lambda r: r <> '')[1]")} AS answer FROM {SCANNED})""",
    "replace_chunks": f"""
SELECT chunk_id, note_id, ord, text FROM chunks WHERE note_id NOT IN (SELECT note_id FROM ({CHANGES}) WHERE change = 'reindex')
UNION ALL
SELECT NULL, note_id, ord, text FROM ({CHUNKS}) JOIN (SELECT rel_path, note_id FROM ({CHANGES}) WHERE change = 'reindex') USING (rel_path)""",
    "search_highlights": f"""
SELECT term, note_id, chunk_id, coalesce(nullif({LONGEST}, ''), first, '') AS highlight FROM (
  SELECT term, h.note_id, h.chunk_id, coalesce(content, body) AS page, ({sql_lines('text')}) AS l, list_filter(l, lambda x: {sql_trimmed('x')} <> '' AND {sql_trimmed('x')} IS DISTINCT FROM '# ' || title)[1] AS first
  FROM ({HIT_TEXTS}) h LEFT JOIN (SELECT note_id, content FROM ({LATEST}) JOIN (SELECT note_id, rel_path FROM notes) USING (rel_path)) p ON h.note_id = p.note_id WHERE rank < 3 AND text IS NOT NULL)""",
}


def read_vault(dialect: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """The newest scans written out as a vault and read again in a dialect."""
        root = scratch(spark, "vault").removeprefix("file:")
        vault.write(state.latest_scan(table(spark, folder, "raw_notes")), root)
        vault.register(spark)
        return spark.read.format("vault").option("path", root).option("dialect", dialect).load().select("rel_path", "content", "error")

    return query


QUERIES |= {"vault_prose": read_vault("prose"), "vault_outline": read_vault("outline")}
IN_VAULT = f"SELECT rel_path, content, NULL::VARCHAR AS error FROM ({LATEST}) WHERE regexp_matches(rel_path, '[^/]\\.md$')"
SQL |= {
    "vault_prose": f"{IN_VAULT} AND NOT regexp_matches(rel_path, '(^|/)(\\.[^/]*|trash)/')",
    "vault_outline": f"{IN_VAULT} AND regexp_matches(rel_path, '^(pages|journals)/')",
    "mark_unsummarizable": state_sql(f"chars < {text.SUMMARY_CHARS}", f"notes LEFT JOIN (SELECT rel_path, {note_sql.narrative()} AS chars FROM {SCANNED}) USING (rel_path)", **OVER | {"summary_status": "4"}),
}
