"""One run over a vault: what a scan changes in the tables of notes and chunks, as the next state of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import chunking, state
from marginalia.sources import snapshots
from marginalia.tables import settle


@dataclass(frozen=True)
class Rescan:
    """Notes and chunks after a scan, what it meant for each path, and the files that couldn't be read."""

    notes: DataFrame
    chunks: DataFrame
    changes: DataFrame
    errors: DataFrame


def rescan(notes: DataFrame, chunks: DataFrame, scans: DataFrame, outline: Column) -> Rescan:
    """The state after ``scans`` (rel_path, mtime, content, scanned_at and, from a vault, error) of a whole vault.

    Notes that aren't there any more go with their chunks, but a file that couldn't be read stays as it is. New and changed notes
    are cut into chunks anew (``outline``: whether a path's note is one), all others keep theirs. Only their contents are cut.
    """
    failed = scans.filter("content is null") if "error" not in scans.columns else scans.filter("error is not null or content is null")
    failed = failed.join(state.latest_scan(scans), "rel_path", "left_anti")
    changes = settle(state.scan_changes(notes, scans).join(failed.select("rel_path").distinct(), "rel_path", "left_anti"))
    gone = changes.filter("change = 'missing'")
    kept = settle(state.removed(state.upserted(notes, changes), gone, "rel_path"))
    fresh = changes.filter("change in ('new', 'reindex')").select("rel_path", "content").join(kept.select("rel_path", "note_id"), "rel_path")
    cut = chunking.chunk(fresh.withColumn("title", text.page_title(F.col("rel_path"))).withColumn("outline", outline))
    named = cut.join(fresh.select("rel_path", "note_id"), "rel_path").select("note_id", "ord", "text")
    left = state.removed(chunks, gone.filter("note_id is not null"), "note_id")
    return Rescan(kept, state.replaced_chunks(left, fresh, named), changes, failed)


def publish(after: Rescan, notes_root: str, chunks_root: str) -> tuple[int, int]:
    """Both tables as their next versions, chunks first: a reader of the new notes finds their chunks."""
    chunks = snapshots.publish(after.chunks, chunks_root)
    return snapshots.publish(after.notes, notes_root), chunks
