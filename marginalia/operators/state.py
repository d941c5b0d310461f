"""The note table as states: what a scan changes, and the life of summaries.

Every operator is a pure function from a state (and input) to the next state; ``snapshots`` publishes states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators.ranking import rank_within

#: Version of the chunker, states of a summary, failed attempts after which it is given up.
CHUNKER = 6
NONE, QUEUED_LOW, QUEUED_HIGH, RUNNING, OK, FAILED = range(6)
ATTEMPTS = 3



def newest_scan(scans: DataFrame) -> DataFrame:
    """Newest version of each path of ``scans`` (rel_path, mtime, content, scanned_at): the highest mtime, among equal ones the last
    scanned, then the larger content. Rows without path or content count as not scanned; exact duplicates are one row."""
    rows = scans.filter("content is not null and rel_path is not null")
    return rows.groupBy("rel_path").agg(F.max(F.struct("mtime", "scanned_at", "content")).alias("s")).select("rel_path", "s.mtime", "s.scanned_at", "s.content")


def latest_scan(scans: DataFrame) -> DataFrame:
    """``newest_scan`` without the time of the scan: rel_path, mtime, content."""
    return newest_scan(scans).drop("scanned_at")


def scan_changes(notes: DataFrame, scans: DataFrame, version: int = CHUNKER) -> DataFrame:
    """What a scan means for each path: rel_path, note_id, change (new, unchanged, touch, reindex, missing), mtime, content.

    unchanged: same mtime and version. touch: other mtime, same content and version. missing: stored but not scanned.
    """
    stored = notes.select("rel_path", "note_id", F.col("mtime").alias("old_mtime"), "content_hash", "chunker_version")
    both = stored.join(latest_scan(scans), "rel_path", "full_outer")
    same_version = F.col("chunker_version").eqNullSafe(F.lit(version))
    change = (
        F.when(F.col("note_id").isNull(), "new")
        .when(F.col("content").isNull(), "missing")
        .when(same_version & F.col("mtime").eqNullSafe(F.col("old_mtime")), "unchanged")
        .when(same_version & F.unhex(F.sha2("content", 256)).eqNullSafe(F.col("content_hash")), "touch")
        .otherwise("reindex")
    )
    return both.select("rel_path", "note_id", change.alias("change"), "mtime", "content")


def upserted(notes: DataFrame, changes: DataFrame, version: int = CHUNKER, expected: int = 1_000_000) -> DataFrame:
    """``notes`` after a scan: touched rows get the new mtime, reindexed ones start over with a queued summary, new ones too.

    New ids go on from the largest. Missing notes stay; ``removed`` drops them. ``expected``: new notes that are likely, for
    the number of tasks that number them.
    """
    news = changes.filter("change != 'missing'").select("rel_path", "change", F.col("mtime").alias("new_mtime"), F.unhex(F.sha2("content", 256)).alias("new_hash"))
    kept = notes.join(news, "rel_path", "left")
    fresh, moved = F.col("change") == "reindex", F.col("change").isin("reindex", "touch")
    pick = lambda when, new, old: F.when(F.coalesce(when, F.lit(False)), new).otherwise(F.col(old)).alias(old)
    old = kept.select(
        "note_id", "rel_path", "page_title", pick(moved, F.col("new_mtime"), "mtime"), pick(fresh, F.col("new_hash"), "content_hash"),
        pick(fresh, F.lit(version), "chunker_version"), pick(fresh, F.lit(None), "summary"), pick(fresh, F.lit(QUEUED_LOW), "summary_status"),
        pick(fresh, F.lit(0), "summary_attempts"), pick(fresh, F.lit(None), "summary_embedding"),
    )
    start = notes.agg(F.coalesce(F.max("note_id"), F.lit(0))).first()[0]
    ranked = rank_within(news.filter("change = 'new'"), "change", ["rel_path"], expected)
    numbered = ranked.withColumn("note_id", F.col("rank").cast("long") + start + 1)
    new = numbered.select(
        "note_id", "rel_path", text.page_title(F.col("rel_path")).alias("page_title"), F.col("new_mtime").alias("mtime"),
        F.col("new_hash").alias("content_hash"), F.lit(version).alias("chunker_version"), F.lit(None).cast("string").alias("summary"),
        F.lit(QUEUED_LOW).alias("summary_status"), F.lit(0).alias("summary_attempts"), F.lit(None).cast("array<float>").alias("summary_embedding"),
    )
    return old.unionByName(new)


def removed(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``gone``: deletes notes, and by note_id their chunks and vectors with them."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def replaced_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame, expected: int = 1_000_000) -> DataFrame:
    """``chunks`` with those of the ``changed`` notes (note_id) replaced by ``fresh`` ones (note_id, ord, text), with ids that go on from
    the largest and no vector yet. ``expected``: new chunks that are likely, for the number of tasks that number them."""
    kept = removed(chunks, changed, "note_id")
    start = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
    ranked = rank_within(fresh.withColumn("_all", F.lit(0)), "_all", ["note_id", "ord"], expected)
    numbered = ranked.withColumn("chunk_id", F.col("rank").cast("long") + start + 1)
    return kept.unionByName(numbered.select("chunk_id", "note_id", "ord", "text", F.lit(None).cast("array<float>").alias("embedding")))


# --- summaries: each function gives the columns that change, for DataFrame.withColumns


def promoted() -> dict[str, Column]:
    """Notes waiting or without request are wanted soon."""
    status = F.col("summary_status")
    return {"summary_status": F.when(status.isin(NONE, QUEUED_LOW), QUEUED_HIGH).otherwise(status)}


def started_over() -> dict[str, Column]:
    """No summary, queued, no attempt."""
    return {"summary": F.lit(None).cast("string"), "summary_embedding": F.lit(None).cast("array<float>"), "summary_status": F.lit(QUEUED_LOW), "summary_attempts": F.lit(0)}


def unsummarizable() -> dict[str, Column]:
    """Nothing to summarize: done, without summary."""
    return started_over() | {"summary_status": F.lit(OK)}


def failed_once() -> dict[str, Column]:
    """One more failure: given up after ATTEMPTS, else free to be queued again."""
    tries = F.col("summary_attempts") + 1
    return {"summary_attempts": tries, "summary_status": F.when(tries >= ATTEMPTS, FAILED).otherwise(NONE)}


def saved(summary: Column, vector: Column) -> dict[str, Column]:
    """A finished summary; an empty one counts as none."""
    return {"summary": F.when(summary != "", summary), "summary_embedding": vector, "summary_status": F.lit(OK)}


def recovered() -> dict[str, Column]:
    """What was running when the last run ended is queued again."""
    status = F.col("summary_status")
    return {"summary_status": F.when(status == RUNNING, QUEUED_LOW).otherwise(status)}


def only_where(condition: Column, changes: dict[str, Column]) -> dict[str, Column]:
    """``changes`` for the rows that meet ``condition``; null conditions aren't met."""
    met = F.coalesce(condition, F.lit(False))
    return {name: F.when(met, value).otherwise(F.col(name)) for name, value in changes.items()}


def claimed() -> dict[str, Column]:
    """A note whose summary is being made, so that nobody else takes it."""
    return {"summary_status": F.lit(RUNNING)}


def lacks_vector() -> Column:
    """Finished summaries that were saved without a vector."""
    return (F.col("summary_status") == OK) & F.col("summary").isNotNull() & F.col("summary_embedding").isNull()


def candidates(notes: DataFrame, n: int) -> DataFrame:
    """The ``n`` notes to summarize next: wanted soon first, then by id; those given up or done are left out."""
    waiting = notes.filter(F.col("summary_status").isin(NONE, QUEUED_LOW, QUEUED_HIGH) & (F.col("summary_attempts") < ATTEMPTS))
    return waiting.orderBy((F.col("summary_status") == QUEUED_HIGH).desc(), "note_id").limit(n)


def counts(notes: DataFrame) -> DataFrame:
    """One row: all notes, and their summaries by state as users see it."""
    status = F.col("summary_status")
    done, failed = F.count_if(status == OK), F.count_if(status == FAILED)
    return notes.agg(F.count("*").alias("total"), done.alias("ok"), failed.alias("failed"), (F.count("*") - done - failed).alias("pending"))
