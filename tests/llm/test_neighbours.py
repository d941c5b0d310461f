import numpy as np
import pytest

from marginalia.llm.neighbours import Settings, colliding, packed, similar_pairs, unpacked


def brute(ids, vectors, k, floor):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims, out = unit @ unit.T, set()
    for i in range(len(ids)):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in best if sims[i, j] >= floor}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 64))
    rows = [c + rng.standard_normal(64) * s for c in centres for s in (0.0, 0.1, 0.2, 0.3)]
    return np.array(rows)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def exact_best(ids, vectors, k, floor):
    """As ``brute``, a block at a time."""
    rows, out = unit(vectors.astype(np.float32).astype(float)), set()
    for start in range(0, len(rows), 1000):
        sims = rows[start : start + 1000] @ rows.T
        sims[np.arange(len(sims)), start + np.arange(len(sims))] = -1
        for i, row in enumerate(sims):
            top = np.argpartition(-row, k)[: k + 1]
            for j in top[np.argsort(-row[top])][:k]:
                if row[j] >= floor:
                    out.add((min(ids[start + i], ids[j]), max(ids[start + i], ids[j])))
    return out


def frame(spark, ids, vectors):
    return spark.createDataFrame([("v", int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "kind string, id long, vector array<float>")


def test_recall_against_brute_force(spark, clustered):
    ids = np.arange(len(clustered)) * 3 + 1
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, clustered)).collect()}
    true = brute(ids, clustered.astype(np.float32).astype(float), 5, 0.9)
    assert len(got & true) >= 0.97 * len(true) and len(got - true) <= 0.03 * len(true)


def test_copies_scaled_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    one, two = rng.standard_normal(64), rng.standard_normal(64)
    rows = [("v", i, list(map(float, one))) for i in range(9)] + [("v", 20, list(map(float, 4 * two))), ("v", 21, list(map(float, two)))]
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63]
    rows += [("v", 100 + i, v) for i, v in enumerate(bad)] + [("v", None, list(map(float, one))), ("w", 0, list(map(float, one)))]
    vectors = spark.createDataFrame(rows, "kind string, id long, vector array<float>").selectExpr("*", "'x' AS cell", "1 AS home")
    got = {(r["kind"], r["id_a"], r["id_b"]) for r in similar_pairs(vectors).collect()}
    copies = {(a, b) for a in range(9) for b in range(a + 1, 9) if a < 5}
    assert {(a, b) for _, a, b in got if b < 20} == copies
    assert ("v", 20, 21) in got and all(kind == "v" for kind, _, _ in got)


def test_runs_of_a_crowded_cell(spark, clustered):
    ids = np.arange(len(clustered))
    crowded = Settings(per_cell=10_000, run=200)  # few cells, many runs in each
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, clustered), crowded).collect()}
    true = brute(ids, clustered.astype(np.float32).astype(float), 5, 0.9)
    assert len(got & true) >= 0.9 * len(true)


def test_windows_count_lines(monkeypatch):
    from marginalia.llm import neighbours

    rng = np.random.default_rng(1)
    p = rng.standard_normal((50, 6))
    home = np.flatnonzero(rng.random(50) < 0.5)
    for members in (10, 10**6):
        monkeypatch.setattr(neighbours, "MEMBERS", members)
        a, b = colliding(p, np.argsort(p, axis=0), home, 0.4, 3)
        true = {(i, j) for i in home for j in range(50) if (np.abs(p[i] - p[j]) <= 0.4).sum() >= 3}
        assert set(zip(a.tolist(), b.tolist())) == true


def test_rounding_stays_within_the_slack():
    rng = np.random.default_rng(2)
    for width in (64, 7):
        rows = rng.standard_normal((400, width)) * np.exp(rng.standard_normal((400, width)))
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        back = unpacked(packed(unit).slice(3), width)
        assert np.abs(back @ back.T - unit[3:] @ unit[3:].T).max() < Settings().slack


def test_empty_table(spark):
    assert similar_pairs(spark.createDataFrame([], "kind string, id long, vector array<float>")).count() == 0


def test_nearest_equals_brute_force(spark, clustered, monkeypatch):
    from pyspark.sql import functions as F

    from marginalia.llm import neighbours

    monkeypatch.setattr(neighbours, "HELD", 7)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 100)
    vectors = np.concatenate([clustered[:200], np.repeat(clustered[:1], 40, axis=0)])
    ids = np.arange(len(vectors)) * 2
    frame_ = frame(spark, ids, vectors).union(spark.createDataFrame([("v", 1, None), ("w", 0, [1.0] * 64)], "kind string, id long, vector array<float>"))
    got = {}
    for r in neighbours.nearest(frame_, F.col("id") % 50 == 0).orderBy("kind", "id", "rank").collect():
        got.setdefault((r["kind"], r["id"]), []).append((r["neighbour"], r["similarity"]))
    rows = vectors.astype(np.float32).astype(float)
    sims = np.round((rows @ rows.T) / np.linalg.norm(rows, axis=1) / np.linalg.norm(rows, axis=1)[:, None], 6)
    for i in range(0, len(ids), 25):
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [n for n, _ in got[("v", int(ids[i]))]] == [int(ids[j]) for j in best]
    assert ("w", 0) not in got


def test_more_copies_than_a_run_holds(spark, clustered):
    rng = np.random.default_rng(6)
    few = clustered[:80]
    near = few[0] + rng.standard_normal((6, 64)) * 0.1
    vectors = np.concatenate([few, near, np.repeat(few[:1], 150, axis=0)])
    ids = rng.permutation(len(vectors)) + 1
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, vectors), Settings(run=40)).collect()}
    true = brute(ids, vectors.astype(np.float32).astype(float).round(6), 5, 0.9)
    of = dict(zip(ids, range(len(ids))))
    copies = {0, *range(86, len(vectors))}
    touches = lambda pairs: {(a, b) for a, b in pairs if of[a] in copies or of[b] in copies}
    first = sorted(ids[sorted(copies)])[:6]
    assert {(min(a, b), max(a, b)) for a in ids[sorted(copies)] for b in [c for c in first if c != a][:5]} == {(a, b) for a, b in touches(got) if of[a] in copies and of[b] in copies}
    assert {p for p in touches(true) if not {of[p[0]], of[p[1]]} <= copies} <= got


def test_recall_in_a_dense_cluster(spark, monkeypatch):
    from marginalia.llm import neighbours

    monkeypatch.setattr(neighbours, "HELD", 150)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 200)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    dense = 0.98**0.5 * unit(rng.standard_normal(64)) + 0.02**0.5 * unit(rng.standard_normal((800, 64)))
    vectors = np.concatenate([unit(rng.standard_normal((1600, 64))), dense])
    ids = rng.permutation(len(vectors)) + 1
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, vectors), Settings(run=200)).collect()}
    true = brute(ids, vectors.astype(np.float32).astype(float), 5, 0.9)
    assert len(got & true) >= 0.99 * len(true) and len(got - true) <= 0.01 * len(true)


def test_groups_of_near_copies_at_default_settings(spark):
    rng = np.random.default_rng(11)
    centres = unit(rng.standard_normal((150, 64)))
    vectors = np.concatenate([unit(c + 0.02 * rng.standard_normal((60, 64))) for c in centres])
    ids = rng.permutation(len(vectors)) + 1
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, vectors)).collect()}
    true = exact_best(ids, vectors, 5, 0.9)
    assert len(got & true) >= 0.999 * len(true) and len(got - true) <= 0.001 * len(true)


def test_a_clump_of_most_vectors_at_default_settings(spark):
    """Neighbours that are hardly nearer than the rest of the clump are the hardest case: all of it is above the floor."""
    rng = np.random.default_rng(12)
    clump = unit(unit(rng.standard_normal(64)) + 0.03 * rng.standard_normal((3000, 64)))
    vectors = np.concatenate([clump, unit(rng.standard_normal((1000, 64)))])
    ids = rng.permutation(len(vectors)) + 1
    got = {(r["id_a"], r["id_b"]) for r in similar_pairs(frame(spark, ids, vectors)).collect()}
    true = exact_best(ids, vectors, 5, 0.9)
    print("recall", len(got & true) / len(true), "wrong", len(got - true) / len(got))
    assert len(got & true) >= 0.9 * len(true)
