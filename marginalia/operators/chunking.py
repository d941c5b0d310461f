"""Notes into chunks under a token cap, keeping bullets and headings together.

Notes don't depend on each other, so chunking is one pass over them in Arrow batches. Tokens are code points / 4.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text

#: Most tokens of a chunk, and tokens at which a long bullet's parts are cut.
CAP, TARGET = 600, 400


def size(part: str) -> int:
    return len(part) // text.TOKEN_CHARS


def rows_of(part: str) -> list[str]:
    """Lines as ``text.lines`` has them."""
    rows = part.split("\n")
    return [r[:-1] if r.endswith("\r") else r for r in (rows[:-1] if rows[-1] == "" else rows)]


def is_heading(row: str) -> bool:
    return re.match(r"\s*#+[ \t]", row) is not None


def bullet_parts(unit: list[str]) -> list[str]:
    """Parts of a bullet over the cap; each begins with the bullet's own line. A single line is never cut."""
    head, parts, held, tokens = unit[0], [], [unit[0]], size(unit[0])
    for row in unit[1:]:
        if len(held) > 1 and tokens + size(row) >= TARGET:
            parts.append("\n".join(held))
            held, tokens = [head], size(head)
        held.append(row)
        tokens += size(row)
    return parts + ["\n".join(held)] if len(held) > 1 or not parts else parts


def outline_chunks(units: list[list[str]]) -> list[str]:
    """Bodies of an outline note's chunks: neighbouring top bullets (lists of lines) packed up to the cap."""
    out, held, tokens = [], [], 0
    for unit in units:
        n = size("\n".join(unit))
        if held and (n > CAP or tokens > 0 and tokens + n > CAP):
            out.append("\n".join(held))
            held, tokens = [], 0
        if n > CAP:
            out += bullet_parts(unit)
        else:
            held, tokens = held + list(unit), tokens + n
    return out + ["\n".join(held)] if held else out


def paragraphs(rows: list[str]) -> list[str]:
    """Stretches of lines between blank ones, each line with its end."""
    out: list[list[str]] = [[]]
    for row in rows:
        if row.strip():
            out[-1].append(row + "\n")
        elif out[-1]:
            out.append([])
    return ["".join(p) for p in out if p]


def section_parts(section: str) -> list[str]:
    """Parts of a section over the cap, cut at paragraphs, or at lines where a paragraph is too long; each repeats the heading."""
    rows = rows_of(section)
    head = rows[0] if rows and is_heading(rows[0]) else None
    body = paragraphs(rows[1:] if head is not None else rows)
    if not body:
        return [head] if head is not None else []
    out, held, tokens, head_tokens = [], "", 0, size(head or "")
    with_head = lambda part: part.rstrip() if head is None else f"{head}\n\n{part.rstrip()}"
    for paragraph in body:
        if tokens > 0 and tokens + size(paragraph) > CAP:
            out.append(with_head(held))
            held, tokens = "", 0
        if size(paragraph) <= CAP:
            held, tokens = held + paragraph, tokens + size(paragraph)
            continue
        for row in rows_of(paragraph):
            if held and tokens + head_tokens + size(row) > CAP:
                out.append(with_head(held))
                held, tokens = "", 0
            held, tokens = held + row + "\n", tokens + size(row)
    return out + [with_head(held)] if held.strip() else out


def sections(note: str) -> list[str]:
    """A note cut in front of every heading; blank stretches are left out."""
    out: list[list[str]] = [[]]
    for row in rows_of(note):
        if is_heading(row):
            out.append([])
        out[-1].append(row + "\n")
    return [s for s in ("".join(part) for part in out) if s.strip()]


def prose_chunks(note: str) -> list[str]:
    """Bodies of a prose note's chunks: the whole note if it fits, else neighbouring sections packed up to the cap."""
    if not note.strip():
        return []
    if size(note.strip()) <= CAP:
        return [note.strip()]
    out, held, tokens = [], "", 0
    for section in (s.strip("\n") for s in sections(note)):
        n = size(section)
        if n > CAP or tokens > 0 and tokens + n > CAP:
            if held.strip():
                out.append(held.rstrip())
            # a section that follows a full chunk keeps one more line end before its successor
            held, tokens = ("", 0) if n > CAP else (section + "\n", n)
            if n > CAP:
                out += section_parts(section)
        else:
            held, tokens = (held + "\n\n" if held else "") + section, tokens + n
    return out + [held.rstrip()] if held.strip() else out


def chunk(notes: DataFrame, outline: str = "outline") -> DataFrame:
    """Chunks of ``notes`` (rel_path, title, content, and a boolean column named by ``outline``): rel_path, ord, text.

    Each text begins with the title as a heading. Null or empty contents, and outlines of nothing but stubs, give no
    chunk; a null title counts as empty.
    """
    units = F.filter(text.top_units(text.outline_text(F.col("content"))), lambda u: ~text.is_stub(u))
    read = notes.filter("content is not null").select(
        "rel_path", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col(outline), units).alias("units"), text.prose_text(F.col("content")).alias("plain")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, title, bullets, plain in zip(part["rel_path"], part["title"], part["units"], part["plain"]):
                bodies = prose_chunks(plain) if bullets is None else outline_chunks([list(u) for u in bullets])
                out += [(path, i, f"# {title}\n\n{body}") for i, body in enumerate(bodies)]
            yield pd.DataFrame(out, columns=["rel_path", "ord", "text"])

    return read.mapInPandas(cut, "rel_path string, ord int, text string")


def embedding_batches(chunks: DataFrame, budget: int = 7000, most: int = 32) -> DataFrame:
    """``chunks`` (note_id, ord, chunk_id, text) with the batch each is embedded in: consecutive chunks of a note while
    they have at most ``budget`` estimated tokens and ``most`` rows together. Null texts count as empty.

    The rows of a note come in order from a sorted partition, one after the other; none is held.
    """
    sized = chunks.select("note_id", "ord", "chunk_id", F.coalesce(text.embedding_tokens(F.col("text")), F.lit(0)).cast("long").alias("tokens"))
    ordered = sized.repartition("note_id").sortWithinPartitions("note_id", "ord", "chunk_id")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        note, batch, rows, tokens = None, 0, 0, 0
        for part in batches:
            numbers = []
            for note_id, n in zip(part["note_id"], part["tokens"]):
                if note_id != note:
                    note, batch, rows, tokens = note_id, 0, 0, 0
                elif tokens + n > budget or rows >= most:
                    batch, rows, tokens = batch + 1, 0, 0
                rows, tokens = rows + 1, tokens + n
                numbers.append(batch)
            yield part.assign(batch=numbers)

    return ordered.mapInPandas(assign, "note_id long, ord int, chunk_id long, tokens long, batch int")
