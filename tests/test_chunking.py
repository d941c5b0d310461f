import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.operators import chunking


def test_small_bullets_share_a_chunk():
    assert chunking.outline_chunks([["- a"], ["- b", "\tc"]]) == ["- a\n- b\n\tc"]


def test_bullets_fill_up_to_the_cap():
    unit = ["- " + "x" * 998]  # 250 tokens
    assert [c.count("- ") for c in chunking.outline_chunks([unit] * 5)] == [2, 2, 1]


def test_long_bullets_repeat_their_head():
    unit = ["- head"] + ["\t- " + "y" * 400 for _ in range(10)]
    parts = chunking.outline_chunks([["- before"], unit, ["- after"]])
    assert parts[0] == "- before" and parts[-1] == "- after"
    assert all(p.startswith("- head\n") for p in parts[1:-1]) and sum(p.count("y" * 400) for p in parts) == 10


def test_a_single_giant_line_stays_whole():
    assert chunking.outline_chunks([["- " + "z" * 9000]]) == ["- " + "z" * 9000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=30))
def test_no_bullet_is_lost(sizes):
    units = [[f"- {i} " + "x" * n] for i, n in enumerate(sizes)]
    chunks = chunking.outline_chunks(units)
    assert "\n".join(chunks) == "\n".join(u[0] for u in units)
    assert all(chunking.size(c) <= chunking.CAP + len(units) or "\n" not in c for c in chunks)


def test_small_prose_is_one_chunk():
    assert chunking.prose_chunks("\n# a\n\nb\n\n# c\nd\n") == ["# a\n\nb\n\n# c\nd"]
    assert chunking.prose_chunks(" \n") == []


def test_prose_is_cut_at_headings():
    section = "x" * 1600  # 400 tokens
    note = "\n".join(f"# h{i}\n{section}" for i in range(3)) + "\n#tag is no heading"
    assert chunking.prose_chunks(note) == [f"# h0\n{section}", f"# h1\n{section}", f"# h2\n{section}\n#tag is no heading"]


def test_a_section_after_a_full_chunk_keeps_a_line_end():
    a, b, c = "# a\n" + "x" * 1500, "# b\n" + "y" * 1500, "# c\nz"
    assert chunking.prose_chunks("\n".join((a, b, c))) == [a, f"{b}\n\n\n{c}"]


def test_long_sections_are_cut_at_paragraphs_then_lines():
    note = "# head\n" + "\n\n".join("p" * 1400 for _ in range(4)) + "\n\n" + "\n".join("l" * 900 for _ in range(4))
    parts = chunking.prose_chunks(note)
    assert all(p.startswith("# head\n\n") for p in parts)
    assert sum(p.count("p" * 1400) for p in parts) == 4 and sum(p.count("l" * 900) for p in parts) == 4
    assert chunking.section_parts("# only") == ["# only"]


def test_chunk(spark):
    rows = [("a.md", "A", "- x {{embed [[y]]}}\n-\n", True), ("b.md", "B", "---\nk: v\n---\nprose", False), ("c.md", None, "-\n- ", True), ("d.md", "D", None, False), ("e.md", None, "e", False)]
    got = chunking.chunk(spark.createDataFrame(rows, "rel_path string, title string, content string, outline boolean").selectExpr("*", "1 AS ord", "2 AS units")).collect()
    assert {(r["rel_path"], r["ord"], r["text"]) for r in got} == {("a.md", 0, "# A\n\n- x "), ("b.md", 0, "# B\n\nprose"), ("e.md", 0, "# \n\ne")}


def test_embedding_batches(spark):
    rows = [(1, i, i, "水" * 3000) for i in range(5)] + [(2, i, 100 + i, "a") for i in range(70)] + [(3, 0, 900, None)]
    got = chunking.embedding_batches(spark.createDataFrame(rows, "note_id long, ord int, chunk_id long, text string")).collect()
    of = lambda n: [r["batch"] for r in sorted(got, key=lambda r: r["ord"]) if r["note_id"] == n]
    assert of(1) == [0, 0, 1, 1, 2] and of(2) == [0] * 32 + [1] * 32 + [2] * 6 and of(3) == [0]


@pytest.mark.parametrize("text_, rows", [("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("", [])])
def test_rows_equal_the_column_function(spark, text_, rows):
    from pyspark.sql import functions as F

    from marginalia.functions import text

    assert chunking.rows_of(text_) == rows
    assert spark.createDataFrame([(text_,)], "x string").select(text.lines(F.col("x"))).first()[0] == rows
