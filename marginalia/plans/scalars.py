"""Queries of the scalar functions over whole tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text, uri
from marginalia.tables import table

#: White space and word characters of any script, for a dialect whose classes are ASCII.
WS = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_pattern(pattern: str) -> str:
    """A pattern of ``text`` for the SQL engine's regular expressions."""
    inner = WS[1:-1]
    out, in_class, i = "", False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out += inner if in_class else WS
        elif pair == r"\w":
            out += r"\pL\pM\pN_" if in_class else r"[\pL\pM\pN_]"
        elif pair == r"\z":
            out += r"\z"
        elif pair[0] == "\\":
            out += pair
        else:
            in_class = pair[0] == "[" or in_class and pair[0] != "]"
            out += pair[0]
            i += 1
            continue
        i += 2
    return quoted(out)


def sql_replaced(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {sql_pattern(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"


def sql_trimmed(c: str) -> str:
    return sql_replaced(c, r"\A\s+|\s+\z")


def sql_lines(c: str) -> str:
    every = f"list_transform(string_split({c}, chr(10)), lambda x: regexp_replace(x, '\\r\\z', ''))"
    return f"(CASE WHEN ends_with({c}, chr(10)) OR {c} = '' THEN ({every})[:-2] ELSE {every} END)"


def sql_encoded(c: str) -> str:
    return f"replace(replace(replace(url_encode({c}), '%20', '+'), '~', '%7E'), '%2A', '*')"


SHARED_SQL = sql_replaced(sql_replaced(sql_replaced("content", text.FRONTMATTER), text.IMAGE_WIKI), text.IMAGE_LINK)
OUTLINE_SQL = SHARED_SQL
for _pattern in (text.MACRO, text.BLOCK_REF, text.QUERY_BLOCK, text.PROPERTY):
    OUTLINE_SQL = sql_replaced(OUTLINE_SQL, _pattern)
OUTLINE_SQL = sql_replaced(OUTLINE_SQL, text.TASK_TIMES, "$1\n")


def sql_plain(c: str) -> str:
    for pattern, by in ((text.LINK, "$1"), (text.WIKI_LINK, "$1"), (text.SCHEME, ""), (text.BULLET, "")):
        c = sql_replaced(c, pattern, by)
    return sql_replaced(sql_trimmed(c), r"\s+", " ")


TOP_SQL = "(starts_with(line, '- ') OR starts_with(line, '* ') OR line IN ('-', '*'))"
TITLE_SQL = "url_decode(CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '(?s)^(.+)\\.[^.]*$', 1) ELSE name END)"


@dataclass(frozen=True)
class Scalar:
    """A function over a table: columns kept, result name, its column expression and its SQL (over ``source``, the table by default)."""

    source: str
    keep: tuple[str, ...]
    expression: Callable[[], Column]
    sql: str | None
    where: str | None = None
    sql_source: str | None = None
    out: str = "result"

    def query(self, spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, self.source)
        if self.where:
            rows = rows.filter(self.where)
        return rows.select(*self.keep, self.expression().alias(self.out))

    def oracle(self) -> str | None:
        where = f" WHERE {self.where}" if self.where else ""
        return self.sql and f"SELECT {', '.join(self.keep)}, {self.sql} AS {self.out} FROM {self.sql_source or self.source}{where}"


c = F.col


def in_outline() -> Column:
    """Whether a note's folder is one of an outline."""
    return c("rel_path").rlike("^(pages|journals)/")


RAW, NOTE, CHUNK = ("rel_path", "mtime"), ("note_id",), ("chunk_id",)
#: Code points of an excerpt.
EXCERPT = 160
NAMED = "(SELECT *, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM notes)"
THINKING = "'<think>draft ' || rel_path || chr(10) || '</think>' || chr(10) || ' ' || summary"
EMBEDDED = "length(regexp_replace(text, '[^" + text.WIDE + "]', '', 'g'))"

SCALARS: dict[str, Scalar] = {
    "strip_frontmatter": Scalar("raw_notes", RAW, lambda: text.without_frontmatter(c("content")), sql_replaced("content", text.FRONTMATTER)),
    "strip_images": Scalar("raw_notes", RAW, lambda: text.without_images(c("content")), sql_replaced(sql_replaced("content", text.IMAGE_WIKI), text.IMAGE_LINK)),
    "strip_macros": Scalar("raw_notes", RAW, lambda: text.replaced(c("content"), text.MACRO), sql_replaced("content", text.MACRO)),
    "strip_block_refs": Scalar("raw_notes", RAW, lambda: text.replaced(c("content"), text.BLOCK_REF), sql_replaced("content", text.BLOCK_REF)),
    "strip_query_blocks": Scalar("raw_notes", RAW, lambda: text.replaced(c("content"), text.QUERY_BLOCK), sql_replaced("content", text.QUERY_BLOCK)),
    "strip_properties": Scalar("raw_notes", RAW, lambda: text.replaced(c("content"), text.PROPERTY), sql_replaced("content", text.PROPERTY)),
    "strip_task_times": Scalar("raw_notes", RAW, lambda: text.without_task_times(c("content")), sql_replaced("content", text.TASK_TIMES, "$1\n")),
    "preprocess_prose": Scalar("raw_notes", RAW, lambda: text.prose_text(c("content")), SHARED_SQL),
    "preprocess_outline": Scalar("raw_notes", RAW, lambda: text.outline_text(c("content")), None),
    "plain_text": Scalar("raw_notes", RAW, lambda: text.plain_text(c("content")), sql_plain("content")),
    "narrative_chars": Scalar("raw_notes", RAW, lambda: text.narrative_chars(c("content"), in_outline()), None),
    "is_summarizable": Scalar("raw_notes", RAW, lambda: text.narrative_chars(c("content"), in_outline()) >= text.SUMMARY_CHARS, None),
    "is_junk_summary": Scalar(
        "notes", NOTE, lambda: text.is_junk_summary(c("summary")),
        "lower(" + sql_replaced("summary", r"\A[\"'().:*\-\s]+|[\"'().:*\-\s]+\z") + f") IN ({', '.join(map(quoted, text.JUNK_SUMMARIES))})",
    ),
    "approx_tokens": Scalar("chunks", CHUNK, lambda: text.tokens(c("text")), "(length(text) // 4)::BIGINT"),
    "embedding_tokens": Scalar("chunks", CHUNK, lambda: text.embedding_tokens(c("text")), f"({EMBEDDED} + (length(text) - {EMBEDDED}) // 4)::BIGINT"),
    "heading_only": Scalar(
        "chunks", CHUNK, lambda: text.is_heading_only(c("text")),
        f"len(list_filter({sql_lines('text')}, lambda x: {sql_trimmed('x')} <> '')) = 1 AND coalesce(regexp_matches(list_filter({sql_lines('text')}, lambda x: {sql_trimmed('x')} <> '')[1], {sql_pattern(chr(92) + 'A' + chr(92) + 's*#+[ ' + chr(92) + 't]')}), false)",
        where="text IS NOT NULL",
    ),
    "excerpt": Scalar("chunks", CHUNK, lambda: text.shortened(c("text"), EXCERPT), f"CASE WHEN length(text) > {EXCERPT} THEN left(text, {EXCERPT}) || '…' ELSE text END"),
    "clipped": Scalar("chunks", CHUNK, lambda: text.clipped(c("text"), 2400), "CASE WHEN length(text) > 2400 THEN left(text, 2400) || chr(10) || '…[truncated]' ELSE text END"),
    "preview": Scalar("chunks", CHUNK, lambda: text.shortened(F.replace(c("text"), F.lit("\n"), F.lit(" ⏎ ")), EXCERPT), f"CASE WHEN length(replace(text, chr(10), ' ⏎ ')) > {EXCERPT} THEN left(replace(text, chr(10), ' ⏎ '), {EXCERPT}) || '…' ELSE text END".replace("ELSE text", "ELSE replace(text, chr(10), ' ⏎ ')")),
    "strip_thinking": Scalar(
        "notes", NOTE, lambda: text.without_thinking(F.concat(F.lit("<think>draft "), c("rel_path"), F.lit("\n</think>\n "), c("summary"))),
        sql_replaced(sql_replaced(sql_replaced(THINKING, r"\A\s+"), r"(?s)\A(?:<think>.*?</think>|</think>)"), r"\A\s+"),
    ),
    "query_term": Scalar("notes", NOTE, lambda: text.query_term(c("rel_path")), "list_aggregate(list_transform(string_split(replace(rel_path, '%20', ' '), ' '), lambda x: url_decode(x)), 'string_agg', ' ')"),
    "lexical_gate": Scalar(
        "notes", NOTE, lambda: text.is_searchable(c("page_title")),
        f"length({sql_trimmed('page_title')}) >= 2 OR length({sql_trimmed('page_title')}) = 1 AND regexp_matches({sql_trimmed('page_title')}, '^[{text.MEANINGFUL}]$')",
    ),
    "content_hash": Scalar("raw_notes", RAW, lambda: F.sha2(c("content"), 256), "sha256(content)"),
    "page_title_from_path": Scalar("notes", NOTE, lambda: text.page_title(c("rel_path")), TITLE_SQL, sql_source=NAMED),
    "display_title": Scalar("notes", NOTE, lambda: uri.display_title(c("page_title")), "replace(url_decode(page_title), '___', '/')"),
    "link_prose": Scalar("notes", NOTE, lambda: uri.prose_link(F.lit("My Vault"), c("rel_path")), f"replace('obsidian://open?vault=My+Vault&file=' || {sql_encoded('url_decode(regexp_replace(rel_path, ' + quoted(chr(92) + '.md' + chr(92) + 'z') + ', ' + quoted('') + '))')}, '+', '%20')"),
    "link_outline_page": Scalar(
        "notes", NOTE, lambda: uri.outline_link(F.lit("notes"), c("page_title")), f"'logseq://graph/notes?page=' || {sql_encoded('replace(url_decode(page_title), ' + quoted('___') + ', ' + quoted('/') + ')')}",
        where="NOT coalesce(length(page_title) = 10 AND substr(page_title, 1, 2) = '20', false)",
    ),
    "link_outline_journal": Scalar(
        "notes", NOTE, lambda: uri.outline_link(F.lit("notes"), c("page_title")),
        "'logseq://graph/notes?page=' || "
        + "(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[substr(page_title, 6, 2)::INT] || '+' || substr(page_title, 9, 2)::INT || "
        + "CASE WHEN substr(page_title, 9, 2)::INT IN (1, 21, 31) THEN 'st' WHEN substr(page_title, 9, 2)::INT IN (2, 22) THEN 'nd' WHEN substr(page_title, 9, 2)::INT IN (3, 23) THEN 'rd' ELSE 'th' END"
        + " || '%2C+' || substr(page_title, 1, 4)::INT",
        where="length(page_title) = 10 AND page_title LIKE '20__!___!___' ESCAPE '!'",
    ),
    "summary_label": Scalar(
        "notes", NOTE, lambda: F.when(c("summary_status") == 4, "ok").when(c("summary_status") == 5, "failed").otherwise("pending"),
        "CASE summary_status WHEN 4 THEN 'ok' WHEN 5 THEN 'failed' ELSE 'pending' END",
    ),
}
