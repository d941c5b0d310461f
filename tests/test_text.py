import pytest
from pyspark.sql import functions as F

from marginalia.functions import text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


OUTLINE = [
    ("---\nid: 1\n---\n- kept", "- kept\n"),
    ("- a {{embed ((x))}} b", "- a  b\n"),
    ("- {{query (and [[A]] [[B]])}}", "- \n"),
    ("- see ((0123abcd-0000-1111-2222-0123456789ab)) and ((not a ref))", "- see  and ((not a ref))\n"),
    ("- a\n\t- #+BEGIN_QUERY\n{:q 1}\n#+END_QUERY\n- b", "- a\n- b\n"),
    ("id:: 1\n- a\n\t- tags:: x, y\n- b", "\n- a\n\n- b\n"),
    ("- TODO call\n  SCHEDULED: <2024-01-02 Tue>\n  DEADLINE: <2024-01-03 Wed>\n- next", "- TODO call\n- next\n"),
    ("- Journal Template\n\t- one\n\t\t- two\n- three", "- one\n\t- two\n- three\n"),
    ("- JOURNAL template\n- three", "- three\n"),
    ("- Journal Template - done", "- Journal Template - done\n"),
    ("![[a.png]]\n- x ![alt](b.png) y", "\n- x  y\n"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize("raw, expected", OUTLINE)
def test_outline_text(spark, raw, expected):
    assert one(spark, raw, text.outline_text) == expected


def test_prose_keeps_what_outlines_lose(spark):
    assert one(spark, "---\na: b\n---\nkey:: value {{x}}", text.prose_text) == "key:: value {{x}}"
    assert one(spark, "---\r\na: b\r\n---\r\nx", text.prose_text) == "---\r\na: b\r\n---\r\nx"


def test_plain_text(spark):
    assert one(spark, " - [a b](http://x.y) [[Page]]\n* https://host/path  c ", text.plain_text) == "a b Page host/path c"


@pytest.mark.parametrize("raw, outline, chars", [("- \n-\n", True, 0), ("- abc\n-\n", True, 3), ("before\n- abc", True, 3), ("before\nabc", False, 10), ("", False, 0), (None, False, None)])
def test_narrative_chars(spark, raw, outline, chars):
    assert one(spark, raw, lambda c: text.narrative_chars(c, F.lit(outline))) == chars


def test_lines_and_units(spark):
    assert one(spark, "a\r\nb\n\nc\n", text.lines) == ["a", "b", "", "c"]
    assert one(spark, "", text.lines) == [] and one(spark, "\n", text.lines) == [""]
    assert one(spark, "lost\n- a\n\tb\n* c\n-\n", text.top_units) == [["- a", "\tb"], ["* c"], ["-"]]
    assert one(spark, "none", text.top_units) == []


@pytest.mark.parametrize("raw, junk", [(" **N/A**. ", True), ("Empty page", True), ("空", True), ("", True), ("Empty shelf", False), ("Notes on nothing", False)])
def test_junk_summaries(spark, raw, junk):
    assert one(spark, raw, text.is_junk_summary) is junk


def test_tokens(spark):
    assert one(spark, "日本😀abcd", text.tokens) == 1
    assert one(spark, "日本abcdefgh", text.embedding_tokens) == 4
    assert one(spark, "", text.tokens) == 0


@pytest.mark.parametrize("line, heading", [("# a", True), ("   ### b", True), ("#tag", False), ("#", False), ("#\tx", True), ("a # b", False)])
def test_headings(spark, line, heading):
    assert one(spark, line, text.is_heading) is heading


def test_heading_only_and_first_line(spark):
    assert one(spark, "\n## a\n \n", text.is_heading_only) and not one(spark, "## a\nb", text.is_heading_only) and not one(spark, "", text.is_heading_only)
    first = lambda c: text.first_content_line(c, F.lit("T"))
    assert one(spark, "# T\n\n  x \ny", first) == "  x " and one(spark, "# T\n", first) == ""


def test_excerpts(spark):
    assert one(spark, "# T\n\nbody", lambda c: text.without_title(c, F.lit("T"))) == "body"
    assert one(spark, "# Tx\n\nbody", lambda c: text.without_title(c, F.lit(None).cast("string"))) == "# Tx\n\nbody"
    assert one(spark, "abcdef", lambda c: text.shortened(c, 3)) == "abc…" and one(spark, "abc", lambda c: text.shortened(c, 3)) == "abc"
    assert one(spark, "abcdef", lambda c: text.clipped(c, 2)) == "ab\n…[truncated]"


@pytest.mark.parametrize("raw, expected", [("<think>x\ny</think>\n a", "a"), ("</think> a", "a"), ("<think> a", "<think> a"), (" a ", "a "), ("<think></think>", "")])
def test_thinking(spark, raw, expected):
    assert one(spark, raw, text.without_thinking) == expected


def test_search_terms(spark):
    assert one(spark, "caf%C3%A9%20C++ 100%", text.query_term) == "café C++ 100%"
    assert [one(spark, t, text.is_searchable) for t in ("", " ", "a", "水", "か", "ab", " x ")] == [False, False, False, True, True, True, False]


def test_page_titles(spark):
    got = [one(spark, p, text.page_title) for p in ("a/b/C%2B%2B notes.md", "x.y.md", ".md", "100%.md", "noext")]
    assert got == ["C++ notes", "x.y", ".md", "100%", "noext"]
