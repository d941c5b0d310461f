import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.splitting import cut_points, pieces, renumbered, split


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,。字", max_size=400), st.integers(20, 60), st.integers(0, 10))
def test_round_trip_limits_and_hardness(text, limit, overlap):
    ends, hard = cut_points(text, limit - overlap, limit)
    parts, _ = pieces(text, limit, overlap)
    assert all(len(p) <= limit for p in parts)
    starts = [0, *ends[:-1]]
    assert "".join(text[a:b] for a, b in zip(starts, ends)) == text
    import re

    longest = max((len(x) for x in re.findall(r"[^\s.!?;,。！？；，]+", text)), default=0)
    assert hard == (longest > limit)


def test_cuts_at_the_strongest_boundary_and_overlaps():
    text = "word " * 30 + "end.\n\n" + "next " * 30
    parts, hard = pieces(text, 190, 20)
    assert not hard and len(parts) == 2
    assert parts[1].endswith("next ") and parts[0].endswith("\n\n")
    assert parts[1].startswith(parts[0][-20:])


def test_split_and_order(spark):
    rows = [(1, 7, 0, "a b " * 30), (2, 7, 1, "short"), (3, 7, 2, "x" * 130), (4, 8, 0, None), (5, 8, None, ""), (None, 8, 3, "y " * 80), (6, None, 0, "z. " * 50), (1, 7, 0, "a b " * 30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, note_id long, ord int, text string")
    parts = split(chunks.selectExpr("*", "1 AS piece", "'q' AS cut"), 20, 5)
    got = {}
    for r in parts.collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert set(got) == {1, 3, 6}
    assert {r["cut"] for r in got[3]} == {"hard"} and {r["cut"] for r in got[1]} == {"natural"}
    assert got[6][0]["note_id"] is None
    placed = renumbered(chunks, parts).filter("note_id = 7").orderBy("ord").collect()
    assert [r["chunk_id"] for r in placed] == [1] * len(got[1]) + [3] * len(got[3])
    assert [r["ord"] for r in placed] == [*range(len(got[1])), *range(len(got[1]) + 1, len(got[1]) + 1 + len(got[3]))]


def test_empty_table_and_bad_limits(spark):
    empty = spark.createDataFrame([], "chunk_id long, note_id long, ord int, text string")
    assert split(empty, 20, 5).count() == 0
    with pytest.raises(ValueError):
        split(empty, 5, 5)
