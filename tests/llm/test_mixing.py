import pytest

from marginalia.llm.mixing import mix, sainte_lague


def test_sainte_lague_by_hand():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7, dict.fromkeys("abc", 9)) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague({"a": 1, "b": 1}, 3, {"a": 9, "b": 9}) == {"a": 2, "b": 1}
    assert sainte_lague({"a": 9, "b": 1}, 5, {"a": 2, "b": 9}) == {"a": 2, "b": 3}
    assert sainte_lague({"a": 1}, 5, {"a": 0}) == {"a": 0}


def test_mix_reaches_shares_and_caps(spark):
    rows = [(i, "big", 10) for i in range(3000)] + [(10_000 + i, " Small-Source ", 10) for i in range(300)] + [(20_000 + i, None, 10) for i in range(700)]
    items = spark.createDataFrame(rows, "id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("big", 0.5, 1), ("small_source", 0.1, 2), ("absent", 0.1, 3), (None, 0.1, 1), ("big", None, 1)], "source string, target_share double, max_uses int")
    uses, report = mix(items, targets)
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"big", "small_source", "absent"}
    assert by["absent"]["short"] and not by["big"]["short"] and not by["small_source"]["short"]
    assert by["small_source"]["mixed_tokens"] <= 2 * by["small_source"]["available_tokens"]
    assert by["big"]["reached_share"] == pytest.approx(0.5, abs=0.01) and by["small_source"]["reached_share"] == pytest.approx(0.1, abs=0.01)
    assert sum(r["mixture_share"] for r in by.values()) == pytest.approx(1)
    used = {r["id"]: r["uses"] for r in uses.collect()}
    assert max(n for i, n in used.items() if i < 10_000) <= 1 and max(n for i, n in used.items() if 10_000 <= i < 20_000) <= 2
    assert not any(i >= 20_000 for i in used)


def test_short_source_gives_all_it_may(spark):
    items = spark.createDataFrame([(i, "a" if i < 5 else "b", 10) for i in range(100)], "id long, source string, tokens long").cache()
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 1)], "source string, target_share double, max_uses int")
    report = {r["source"]: r for r in mix(items, targets)[1].collect()}
    assert report["a"]["short"] and report["a"]["mixed_tokens"] == 150


def test_empty_tables(spark):
    items = spark.createDataFrame([], "id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 3)], "source string, target_share double, max_uses int")
    assert [r["reached_share"] for r in mix(items, targets)[1].collect()] == [None]
    full = spark.createDataFrame([(1, "a", 3), (2, "a", None)], "id long, source string, tokens long")
    assert mix(full, targets.limit(0))[1].count() == 0
