from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.packing import pack, plan_containers


def fills(histogram, plan):
    """Tokens in each container, by walking through the plan's runs."""
    runs = defaultdict(list)
    for size, rank, container, per in zip(plan.size, plan.rank, plan.container, plan.per):
        runs[size].append((rank, container, per))
    out = defaultdict(int)
    for size, count in histogram.items():
        own = sorted(runs[size])
        for rank in range(count):
            first, container, per = [r for r in own if r[0] <= rank][-1]
            out[container + (rank - first) // per] += size
    return out


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 100), st.integers(1, 30), max_size=20))
def test_no_container_overflows_and_all_items_are_placed(histogram):
    plan = plan_containers(histogram, 100)
    filled = fills(histogram, plan)
    assert all(n <= 100 for n in filled.values())
    assert sum(filled.values()) == sum(s * n for s, n in histogram.items())
    assert all(0 <= c < plan.containers for c in filled)


def test_close_to_the_lower_bound():
    histogram = {s: 40 + s % 7 for s in range(20, 900, 3)}
    plan = plan_containers(histogram, 4096)
    assert plan.containers <= 1.01 * sum(s * n for s, n in histogram.items()) / 4096 + 1


def test_work_depends_on_sizes_not_items():
    small = plan_containers({s: 3 for s in range(300, 2000, 7)}, 4096)
    large = plan_containers({s: 3_000_000 for s in range(300, 2000, 7)}, 4096)
    assert len(large.size) < 50 * len(small.size)


def test_pack(spark):
    rows = [(i, n, "x") for i, n in enumerate([0, None, 5, 5, 10, 11, 25, 3])] + [(2, 5, "x"), (None, 4, "x")]
    items = spark.createDataFrame(rows, "id long, tokens long, rank string").cache()
    packed, plan = pack(items, 10)
    got = packed.collect()
    assert sorted(r["piece"] for r in got if r["id"] == 6) == [0, 1, 2]
    assert sum(r["tokens"] for r in got) == sum(n or 0 for _, n, _ in rows)
    filled = defaultdict(int)
    for r in got:
        filled[r["container"]] += r["tokens"]
    assert max(filled.values()) <= 10 and len(filled) <= plan.containers
    assert len([r for r in got if r["id"] == 2]) == 2


def test_pack_of_nothing(spark):
    packed, plan = pack(spark.createDataFrame([], "id long, tokens long"), 10)
    assert packed.count() == 0 and plan.containers == 0


def test_capacity_must_be_positive(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "id long, tokens long"), 0)
