"""Text of notes as column expressions: dialect syntax, markup, sizes, excerpts.

Patterns run in the JVM with Unicode classes and ``\\n`` as the only line end (``(?dU)``). Null in, null out, unless said.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?dU)"

#: What the dialects' syntax looks like.
FRONTMATTER = r"(?s)\A---\n.*?\n---\n?"
IMAGE_WIKI = r"!\[\[[^\]]*\]\]"
IMAGE_LINK = r"!\[[^\]]*\]\([^)]*\)"
MACRO = r"\{\{[a-z][a-z-]*(?:\s+[^}]*)?\}\}"
BLOCK_REF = r"\(\([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\)\)"
QUERY_BLOCK = r"(?msi)^[ \t]*(?:[-*]\s*)?#\+BEGIN_QUERY.*?#\+END_QUERY[ \t]*\n?"
PROPERTY = r"(?m)^\s*(?:[-*]\s+)?[A-Za-z][\w-]*::\s*.*$"
TASK_TIMES = r"(?m)^(\s*[-*]\s+(?:DONE|TODO|DOING|NOW|LATER|CANCELED|WAITING)\b[^\n]*)\n(?:\s*(?:SCHEDULED|DEADLINE|CLOSED):\s*<[^>]+>\s*\n?)+"
LINK = r"\[([^\]]+)\]\([^)]*\)"
WIKI_LINK = r"\[\[([^\]]+)\]\]"
SCHEME = r"https?://"
BULLET = r"(?m)^\s*[-*]\s*"
#: Fixed value: bodies of bullets that only head a template.
TEMPLATE_HEADS = ("journal template",)
#: Summaries that say nothing, without the marks around them.
JUNK_SUMMARIES = ("", "empty", "empty string", "empty page", "empty summary", "summary", "n/a", "na", "none", "no content", "blank", "nothing", "空", "空页面", "空字符串", "无", "无内容")
#: Code points that count as one token each when embedding, and those of which one makes a query.
WIDE = r"\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
MEANINGFUL = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
#: Code points of a token, and the least code points of prose that are worth a summary.
TOKEN_CHARS, SUMMARY_CHARS = 4, 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replaced(c: Column, pattern: str, by: str = "") -> Column:
    """All matches replaced."""
    return F.regexp_replace(c, FLAGS + pattern, by)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return replaced(c, r"\A\s+|\s+\z")


def trimmed_start(c: Column) -> Column:
    return replaced(c, r"\A\s+")


def lines(c: Column) -> Column:
    """Lines without their ends (``\\n`` or ``\\r\\n``); a final line end begins no line."""

    def ends_off(parts: Column) -> Column:
        return F.transform(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), lambda x: F.regexp_replace(x, r"\r\z", ""))

    return let(F.split(c, "\n", -1), ends_off)


def without_frontmatter(c: Column) -> Column:
    return replaced(c, FRONTMATTER)


def without_images(c: Column) -> Column:
    return replaced(replaced(c, IMAGE_WIKI), IMAGE_LINK)


def without_task_times(c: Column) -> Column:
    """Task bullets keep their line; the schedule lines below them go."""
    return replaced(c, TASK_TIMES, "$1\n")


def is_top_bullet(line: Column) -> Column:
    return line.startswith("- ") | line.startswith("* ") | (line == "-") | (line == "*")


def without_template_heads(c: Column) -> Column:
    """Top bullets that only name a template go, their children move up to where the first of them was; every line ends with ``\\n``."""
    body = lambda line: F.lower(trimmed(replaced(line, r"\A[-*\s]+")))
    indent = lambda line: F.length(F.regexp_extract(line, r"^[ \t]*", 0))
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("inside"), F.lit(-1).alias("indent"))

    def step(s: Column, line: Column) -> Column:
        head = is_top_bullet(line) & body(line).isin(*TEMPLATE_HEADS)
        inside = s["inside"] & ~is_top_bullet(line)
        level = F.when(inside & (s["indent"] < 0) & (trimmed(line) != ""), indent(line)).otherwise(s["indent"])
        moved = F.substring(line, F.when(inside, F.least(F.greatest(level, F.lit(0)), indent(line))).otherwise(F.lit(0)) + 1, F.length(line))
        return F.struct(
            F.when(head, s["out"]).otherwise(F.concat(s["out"], moved, F.lit("\n"))).alias("out"),
            (head | inside).alias("inside"),
            F.when(head, F.lit(-1)).otherwise(level).alias("indent"),
        )

    plain = lambda every: F.array_join(F.transform(every, lambda line: F.concat(line, F.lit("\n"))), "")
    heads = lambda every: F.exists(every, lambda line: is_top_bullet(line) & body(line).isin(*TEMPLATE_HEADS))
    return let(lines(c), lambda every: F.when(heads(every), F.aggregate(every, state, step, lambda s: s["out"])).otherwise(plain(every)))


def without_shared_syntax(c: Column) -> Column:
    """Frontmatter and images, which both dialects have."""
    return without_images(without_frontmatter(c))


def outline_text(c: Column) -> Column:
    """Content of an outline note (bullets) without macros, references, queries, properties, schedules and template heads."""
    plain = without_shared_syntax(c)
    for pattern in (MACRO, BLOCK_REF, QUERY_BLOCK, PROPERTY):
        plain = replaced(plain, pattern)
    return without_template_heads(without_task_times(plain))


def prose_text(c: Column) -> Column:
    """Content of a prose note without frontmatter and images."""
    return without_shared_syntax(c)


def plain_text(c: Column) -> Column:
    """Markdown as text: labels of links, no schemes and bullets, single blanks."""
    for pattern, by in ((LINK, "$1"), (WIKI_LINK, "$1"), (SCHEME, ""), (BULLET, "")):
        c = replaced(c, pattern, by)
    return replaced(trimmed(c), r"\s+", " ")


def top_units(c: Column) -> Column:
    """Lines of each top bullet and what is below it; lines before the first one are left out."""

    def cut(every: Column) -> Column:
        starts = F.filter(F.transform(every, lambda line, i: F.when(is_top_bullet(line), i + 1)), lambda i: i.isNotNull())
        unit = lambda starts: F.transform(starts, lambda s, i: F.slice(every, s, F.coalesce(F.try_element_at(starts, i + 2), F.size(every) + 1) - s))
        return let(starts, unit)

    return let(lines(c), cut)


def is_stub(unit: Column) -> Column:
    """Whether all lines of a unit are bare bullets."""
    return F.forall(unit, lambda line: trimmed(line).isin("", "-", "*"))


def narrative_chars(c: Column, outline: Column) -> Column:
    """Code points of a note's prose; of an outline only the units that aren't stubs count. ``outline``: boolean column."""
    units = F.filter(top_units(outline_text(c)), lambda u: ~is_stub(u))
    bullets = F.array_join(F.flatten(units), "\n")
    return F.length(plain_text(F.when(outline, bullets).otherwise(prose_text(c))))


def is_junk_summary(c: Column) -> Column:
    return F.lower(replaced(c, r"\A[\"'().:*\-\s]+|[\"'().:*\-\s]+\z")).isin(*JUNK_SUMMARIES)


def tokens(c: Column) -> Column:
    """Chunk tokens of a text."""
    return F.floor(F.length(c) / TOKEN_CHARS)


def embedding_tokens(c: Column) -> Column:
    """Estimated tokens for an embedding model: wide characters count one each."""
    wide = F.length(F.regexp_replace(c, f"[^{WIDE}]", ""))
    return wide + F.floor((F.length(c) - wide) / TOKEN_CHARS)


def is_heading(line: Column) -> Column:
    return matches(line, r"\A\s*#+[ \t]")


def is_heading_only(c: Column) -> Column:
    """Whether the only line that isn't blank is a heading."""
    only = lambda filled: (F.size(filled) == 1) & F.coalesce(is_heading(F.try_element_at(filled, F.lit(1))), F.lit(False))
    return let(F.filter(lines(c), lambda line: trimmed(line) != ""), only)


def first_content_line(c: Column, title: Column) -> Column:
    """First line that is neither blank nor the title line; empty if there is none."""
    head = F.concat(F.lit("# "), title)
    kept = F.filter(lines(c), lambda line: (trimmed(line) != "") & ~trimmed(line).eqNullSafe(head))
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


def without_title(c: Column, title: Column) -> Column:
    """Without the title line that chunks begin with, if it is there."""
    prefix = F.concat(F.lit("# "), title, F.lit("\n\n"))
    return F.when(F.coalesce(c.startswith(prefix), F.lit(False)), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c)


def shortened(c: Column, n: int, mark: str = "…") -> Column:
    """First ``n`` code points and ``mark``, if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def clipped(c: Column, n: int) -> Column:
    return shortened(c, n, "\n…[truncated]")


def without_thinking(c: Column) -> Column:
    """An answer without the thinking block, or the bare end of one, that a chat model put in front."""
    return trimmed_start(replaced(trimmed_start(c), r"(?s)\A(?:<think>.*?</think>|</think>)"))


def percent_decoded(c: Column) -> Column:
    """URL decoding that leaves ``+`` and whatever isn't valid as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def query_term(c: Column) -> Column:
    """A search term from a request path: each word decoded."""
    words = F.transform(F.split(F.replace(c, F.lit("%20"), F.lit(" ")), " ", -1), percent_decoded)
    return F.array_join(words, " ")


def is_searchable(c: Column) -> Column:
    """Whether a term is worth a lexical search: two characters, or one that carries meaning."""
    t = trimmed(c)
    return (F.length(t) >= 2) | ((F.length(t) == 1) & t.rlike(f"^[{MEANINGFUL}]$"))


def page_title(path: Column) -> Column:
    """Title of a note by its path: decoded file name without the last extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return percent_decoded(F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name))
