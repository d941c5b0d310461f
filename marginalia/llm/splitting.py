"""Problem 2: oversized texts into pieces under a limit, cut at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: code points of a chunk token.
TOKEN_CHARS = 4
#: Kinds of boundary, strongest last: (where a cut may fall, pattern). A cut falls behind the match; "before" puts it in front of it.
BOUNDARIES = (
    ("before", r"[\s.!?;,。！？；，]"),
    ("behind", r"[.!?;,。！？；，]"),
    ("behind", r"\s"),
    ("behind", r"[;,]\s|[；，]"),
    ("behind", r"[.!?]+[\"')\]»”’]*\s|[。！？]+[”’」』）]*"),
    ("behind", r"\r?\n"),
    ("behind", r"\n\s*\n\s*(?=\S)|\n(?=#{1,6}\s)"),
)
PATTERNS = tuple((where, regex.compile(pattern)) for where, pattern in BOUNDARIES)
#: Rows of a note are numbered in stretches of this many old ordinals, so that a long note is no single task.
ORD_STRETCH = 1000
#: Stands for a missing note_id between Spark and pandas.
NO_NOTE = -(1 << 62)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending, and the strength of each."""
    strength = np.full(len(text) + 1, -1, dtype=np.int8)
    for rank, (where, pattern) in enumerate(PATTERNS):
        at = [m.start() if where == "before" else m.end() for m in pattern.finditer(text)]
        strength[at] = rank
    positions = np.flatnonzero(strength >= 0)
    return positions, strength[positions]


def cut_points(text: str, core: int, limit: int) -> tuple[list[int], bool]:
    """Ends of consecutive parts of ``text``, by recursive bisection, and whether a cut had to fall inside a word.

    A part longer than ``core`` is cut at its strongest boundary in its middle half, among equals the nearest to the
    midpoint; else at the boundary nearest to the midpoint. A part without boundary may have up to ``limit`` characters
    and is halved beyond.
    """
    positions, strength = boundaries(text)
    ends, hard, todo = [], False, [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= core:
            ends.append(b)
            continue
        middle, quarter = (a + b) // 2, (b - a) // 4
        low, high = np.searchsorted(positions, [a + quarter, b - quarter], side="left")
        if low < high:
            best = low + np.flatnonzero(strength[low:high] == strength[low:high].max())
        else:
            best = np.arange(*np.searchsorted(positions, [a + 1, b], side="left"))
        if len(best):
            cut = int(positions[best[np.abs(positions[best] - middle).argmin()]])
        elif b - a <= limit:
            ends.append(b)
            continue
        else:
            cut, hard = middle, True
        todo += [(cut, b), (a, cut)]
    return ends, hard


def pieces(text: str, limit: int, overlap: int) -> tuple[list[str], bool]:
    """Pieces of at most ``limit`` characters that together hold ``text``, and whether a cut was hard.

    Each piece but the first begins with the last ``overlap`` characters of what comes before; only a part that can't be
    cut naturally and is longer than ``limit`` - ``overlap`` begins with fewer.
    """
    ends, hard = cut_points(text, limit - overlap, limit)
    starts = [0, *ends[:-1]]
    return [text[max(0, a - min(overlap, limit - (b - a))) : b] for a, b in zip(starts, ends)], hard


def oversized(text: Column, max_tokens: int) -> Column:
    """Whether a text has more than ``max_tokens`` chunk tokens; null texts haven't."""
    return F.coalesce(F.floor(F.length(text) / TOKEN_CHARS) > max_tokens, F.lit(False))


def split(chunks: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """Pieces of the oversized rows of ``chunks`` (chunk_id, note_id, ord, text): chunk_id, note_id, piece, text, cut.

    ``cut`` is "hard" where a stretch without any boundary exceeded the limit, else "natural". Rows within the limit and
    null texts give no piece, rows without chunk_id take no part; repeated rows count once. The pieces without their overlaps
    add up to the text.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("overlap_tokens must be at least 0 and below max_tokens")
    limit, overlap = max_tokens * TOKEN_CHARS + TOKEN_CHARS - 1, overlap_tokens * TOKEN_CHARS

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for chunk_id, note_id, text in zip(rows["chunk_id"], rows["note_id"], rows["text"]):
                parts, hard = pieces(text, limit, overlap)
                out += [(chunk_id, note_id, i, part, "hard" if hard else "natural") for i, part in enumerate(parts)]
            yield pd.DataFrame(out, columns=["chunk_id", "note_id", "piece", "text", "cut"])

    large = chunks.filter(oversized(F.col("text"), max_tokens) & F.col("chunk_id").isNotNull()).select("chunk_id", F.coalesce("note_id", F.lit(NO_NOTE)).alias("note_id"), "text")
    out = large.distinct().mapInPandas(cut, "chunk_id long, note_id long, piece int, text string, cut string")
    return out.withColumn("note_id", F.nullif("note_id", F.lit(NO_NOTE)))


def renumbered(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with ``ord``: the place of a piece among all chunks and pieces of its note, in reading order from 0."""
    counts = parts.groupBy("chunk_id").agg(F.count("*").alias("_parts"))
    stretch = F.floor(F.coalesce(F.col("ord"), F.lit(-1)) / ORD_STRETCH)
    rows = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", "note_id", "ord", stretch.alias("_stretch")).join(counts, "chunk_id", "left").fillna(1, ["_parts"])
    earlier = Window.partitionBy("note_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("note_id", "_stretch").agg(F.sum("_parts").alias("_sum"))
    firsts = firsts.select("note_id", "_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("note_id", "_stretch").orderBy("ord", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_parts").over(within), F.lit(0)))
    same = placed["note_id"].eqNullSafe(firsts["note_id"]) & (placed["_stretch"] == firsts["_stretch"])
    starts = placed.join(firsts, same).select("chunk_id", (F.col("_first") + F.col("_before")).alias("_start"))
    return parts.join(starts, "chunk_id").select("chunk_id", "note_id", (F.col("_start") + F.col("piece")).cast("int").alias("ord"), "piece", "text", "cut")
