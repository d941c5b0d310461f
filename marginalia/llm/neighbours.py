"""Problem 4: the k most similar vectors of every vector.

Collision counting: vectors are projected on random lines, each projection is a sorted array, and a query collects the
vectors inside a window around its own projection. Vectors that fall into enough of a query's windows are verified. The
windows start narrow and widen (virtual rehashing) until all queries of a cell have k verified neighbours or the radius is reached.

A window on one line holds a fixed share of all vectors, so counting over a whole table takes quadratic work. The table
is therefore first routed into cells by the pair of lines on which a vector projects highest; a vector is home in its best
cell and visits the next ones, in several independent tables of cells. Counting runs inside a cell. A cell of more than
``run`` vectors is no task of its own: its home vectors are compared with all of its vectors, in blocks. Equal vectors are
folded before, so that one of them is routed for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.tables import settle


@dataclass(frozen=True)
class Settings:
    """Parameters of the search.

    width: elements of a usable vector. k: neighbours wanted. floor: least similarity wanted. tables, cells: independent
    routings and cells of each that a vector is put into. per_cell: home vectors a cell has on average. run: vectors
    counted against each other at most; in larger cells every pair is compared. lines: projections counted. windows: radii (chord lengths) tried one after the other; a window reaches ``reach`` radii to either side.
    share: part of the lines that a candidate must collide on. slack: by how much a similarity of rounded vectors may
    be off. routed_rows: rows of a counting task on average. sample: rows that the centre is measured on.
    """

    width: int = 64
    k: int = 5
    floor: float = 0.9
    tables: int = 4
    cells: int = 3
    per_cell: int = 110
    run: int = 4096
    lines: int = 24
    windows: tuple[float, ...] = (0.15, 0.45)
    reach: float = 1.3
    share: float = 0.55
    slack: float = 0.001
    routed_rows: int = 250_000
    sample: int = 20_000
    seed: int = 7


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """Rows of ``vectors`` (kind, id, vector) with exactly ``width`` finite elements that aren't all zero."""
    x = F.col("vector").cast("array<float>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.filter(F.col("id").isNotNull() & F.col("kind").isNotNull() & (F.size(x) == width) & finite & F.exists(x, lambda e: e != 0)).select("kind", "id", x.alias("vector"))


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of length 1."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed(unit: np.ndarray) -> pa.Array:
    """Each vector rounded to 12 bits an element, two elements in three bytes, as one binary value; scaled to use all of them."""
    v = np.rint(unit * (2047 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int16) + 2048
    if v.shape[1] % 2:
        v = np.column_stack([v, np.full(len(v), 2048, np.int16)])
    a, b = v[:, 0::2], v[:, 1::2]
    out = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], axis=2).astype(np.uint8).reshape(len(v), 3 * a.shape[1])
    offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out))])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a column of ``packed`` values."""
    size = 3 * -(-width // 2)
    rows = np.frombuffer(column.buffers()[2], np.uint8)[column.offset * size :][: len(column) * size].reshape(len(column), size // 3, 3).astype(np.int16)
    a, b = rows[:, :, 0] | ((rows[:, :, 1] & 15) << 8), (rows[:, :, 1] >> 4) | (rows[:, :, 2] << 4)
    x = (np.stack([a, b], axis=2).reshape(len(column), 2 * size // 3)[:, :width] - 2048).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_cells(x: np.ndarray, first: np.ndarray, second: np.ndarray, cells: int) -> np.ndarray:
    """For each row, the ``cells`` pairs (line of ``first``, line of ``second``) with the highest sum of projections."""
    top, tops = min(cells + 1, first.shape[1]), []
    for lines in (first, second):
        p = x @ lines
        at = np.argpartition(-p, top - 1, axis=1)[:, :top]
        tops.append((at, np.take_along_axis(p, at, 1)))
    (a, pa_), (b, pb) = tops
    sums = (pa_[:, :, None] + pb[:, None, :]).reshape(len(x), -1)
    names = (a[:, :, None] * first.shape[1] + b[:, None, :]).reshape(len(x), -1)
    return np.take_along_axis(names, np.argsort(-sums, axis=1, kind="stable")[:, :cells], 1)


def folded(vectors: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """``vectors`` with one row (the smallest id) for each class of equal vectors, named by ``same`` and ``twin``; the k + 1
    smallest ids of each class of several (kind, same, twin, firsts), None without any; and the rows of those classes."""
    named = vectors.withColumns({"same": F.xxhash64("vector"), "twin": F.xxhash64(F.lit(1), F.col("vector"))})
    key = ["kind", "same", "twin"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
    first = named.select(*key, "id").distinct().withColumn("place", place).filter(F.col("place") <= s.k + 1)
    classes = settle(first.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("firsts")).filter(F.size("firsts") > 1))
    if classes.isEmpty():
        return named, None, named.limit(0)
    joined = settle(named.join(classes, key, "left"))
    return joined.filter(F.col("firsts").isNull() | (F.col("id") == F.col("firsts")[0])).drop("firsts"), classes, joined.filter("firsts is not null")


ROUTED = "kind string, tab int, cell long, id long, home boolean, q binary"


@dataclass(frozen=True)
class Routing:
    """The lines that vectors are routed by: cells of a side for each kind, and the mean direction of its vectors."""

    side: dict[str, int]
    centre: dict[str, np.ndarray]
    n: int
    s: Settings

    @property
    def tasks(self) -> int:
        return max(1, -(-self.n * self.s.tables * self.s.cells // self.s.routed_rows))

    def placed(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, int, int, np.ndarray]]:
        """Of each kind in ``batch`` its rows and unit vectors, and for each table and place from home on the rows' cells."""
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        for kind in dict.fromkeys(kinds):
            rows = batch.filter(pa.array(kinds == kind))
            unit = unit_rows(rows.column("vector"), self.s.width)
            x = (unit - self.centre[kind]).astype(np.float32)
            for tab in range(self.s.tables):
                rng = np.random.default_rng([self.s.seed, tab, self.side[kind]])
                first, second = (rng.standard_normal((self.s.width, self.side[kind])).astype(np.float32) for _ in range(2))
                cells = best_cells(x, first / np.linalg.norm(first, axis=0), second / np.linalg.norm(second, axis=0), self.s.cells)
                for place in range(self.s.cells):
                    yield kind, rows, unit, tab, place, cells[:, place].astype(np.int64)


def routing(vectors: DataFrame, s: Settings) -> Routing:
    sizes = {r["kind"]: r["count"] for r in vectors.groupBy("kind").count().collect()}  # one row for each kind
    return Routing({kind: max(8, round((n / s.per_cell) ** 0.5)) for kind, n in sizes.items()}, centres(vectors, sizes, s), sum(sizes.values()), s)


def crowded(vectors: DataFrame, way: Routing) -> dict[tuple[str, int, int], tuple[int, int]]:
    """Home vectors and vectors of each cell (kind, table, cell) of more than ``run``: there are at most n * tables * cells / run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, _, _, tab, place, cells in way.placed(batch):
                names, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_pydict({"kind": [kind] * len(n), "tab": np.full(len(n), tab), "cell": names, "home": n * (place == 0), "n": n})

    parts = vectors.select("kind", "id", "vector").mapInArrow(count, "kind string, tab long, cell long, home long, n long")
    sums = parts.groupBy("kind", "tab", "cell").agg(F.sum("home").alias("home"), F.sum("n").alias("n"))
    return {(r["kind"], r["tab"], r["cell"]): (r["home"], r["n"]) for r in sums.filter((F.col("n") > way.s.run) & (F.col("home") > 0)).collect()}


def routed(vectors: DataFrame, way: Routing, full: set[tuple[str, int, int]]) -> DataFrame:
    """One row for each vector, table and cell outside ``full`` that it is put into; ``q`` is the vector rounded to 12 bits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, rows, unit, tab, place, cells in way.placed(batch):
                out = [c for k, t, c in full if (k, t) == (kind, tab)]
                at = np.flatnonzero(~np.isin(cells, out)) if out else np.arange(len(cells))
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * n, pa.string()), pa.array(np.full(n, tab, np.int32)), pa.array(cells[at]), rows.column("id").take(pa.array(at)), pa.array(np.full(n, place == 0)), packed(unit[at])],
                    names=["kind", "tab", "cell", "id", "home", "q"],
                )

    return vectors.select("kind", "id", "vector").mapInArrow(route, ROUTED)


#: Window members listed at once.
MEMBERS = 2_000_000


def colliding(p: np.ndarray, order: np.ndarray, home: np.ndarray, half: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (home row, row) whose projections (rows of ``p``, a column for each line) are within ``half`` on ``need`` lines at least.

    ``order`` has the rows of each line's sorted array. The members of every window are listed from it and counted.
    """
    n, lines = p.shape
    low, high = (np.empty((lines, len(home)), dtype=np.int64) for _ in range(2))
    for i in range(lines):
        array = p[order[:, i], i]
        low[i] = np.searchsorted(array, p[home, i] - half, side="left")
        high[i] = np.searchsorted(array, p[home, i] + half, side="right")
    members, firsts, seconds = order.T.ravel(), [], []
    step = max(1, int(MEMBERS * len(home) // max(1, (high - low).sum())))
    for a in range(0, len(home), step):
        begins, sizes = low[:, a : a + step], (high - low)[:, a : a + step]
        rows = np.broadcast_to(np.arange(sizes.shape[1]) * n, sizes.shape).ravel()
        begins, sizes = (begins + np.arange(lines)[:, None] * n).ravel(), sizes.ravel()
        places = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        counts = np.bincount(np.repeat(rows, sizes) + members[places])
        found = np.flatnonzero(counts >= need)
        firsts.append(home[a + found // n])
        seconds.append(found % n)
    return np.concatenate(firsts), np.concatenate(seconds)


def similar_in_cell(x: np.ndarray, home: np.ndarray, lines: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rounded unit vectors of one cell in which one is home and one may be among the best of the other: no
    neighbour is left out that rounding might have put behind the k-th."""
    at_home = np.flatnonzero(home)
    if not len(at_home) or len(x) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    p, need = x @ lines, int(np.ceil(s.share * lines.shape[1]))
    order = np.argsort(p, axis=0, kind="stable")
    a, b, sims = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for radius in s.windows:
        a, b = colliding(p, order, at_home, radius * s.reach, need)
        keep = (a != b) & ~(home[b] & (b < a))
        a, b = a[keep], b[keep]
        sims = np.einsum("ij,ij->i", x[a], x[b])
        keep = sims >= s.floor - s.slack
        a, b, sims = a[keep], b[keep], sims[keep]
        near = sims >= 1 - radius**2 / 2
        if (np.bincount(np.concatenate([a[near], b[near]]), minlength=len(x)) >= s.k).all():
            break
    query, other, sims = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sims, sims])
    ranked = np.lexsort((-sims, query))
    query, other, sims = query[ranked], other[ranked], sims[ranked]
    starts = np.searchsorted(query, query, side="left")
    last = np.minimum(starts + s.k - 1, np.searchsorted(query, query, side="right") - 1)
    best = sims >= sims[last] - 2 * s.slack
    return query[best], other[best]


#: Queries that a task holds at most, data rows of a task on average, and rows multiplied at once, in a search of stated queries.
HELD, TASK_ROWS, BLOCK = 100_000, 20_000, 512
#: By how much a product in single precision and its rounding may be off.
ROUGH = 5e-6
#: Pairs whose exact similarity is computed at once.
EXACT = 200_000


def compared(together: DataFrame, tasks: int, digits: int, s: Settings) -> DataFrame:
    """The best k rows (role 1) of each query (role 0) in each group (kind, part, held) of ``together`` (and id, vector), every
    pair being compared: kind, id, neighbour, similarity. The queries of a group are held, its rows stream."""
    columns = ["kind", "part", "held", "role", "id", "vector"]

    def products(own: np.ndarray, unit: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        every = [np.einsum("ij,ij->i", own[row[a : a + EXACT]], unit[col[a : a + EXACT]]) for a in range(0, len(row), EXACT)]
        return np.round(np.concatenate([np.zeros(0), *every]), digits)

    def best_of(asked_ids: np.ndarray, at: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best k of each query among found rows (query's place, id, similarity), best first; a query itself is left out."""
        others = ids != asked_ids[at]
        at, ids, sims = at[others], ids[others], sims[others]
        order = np.lexsort((ids, -sims, at))
        at, ids, sims = at[order], ids[order], sims[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at, side="left") < s.k
        return at[kept], ids[kept], sims[kept]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked_ids, asked_unit, best = None, np.zeros(0, np.int64), np.zeros((0, s.width)), {}

        def result() -> Iterator[pa.RecordBatch]:
            for start, (at, ids, sims) in best.items():
                out = [pa.array([key[0]] * len(at)), pa.array(asked_ids[start + at]), pa.array(ids), pa.array(sims)]
                yield pa.RecordBatch.from_arrays(out, names=["kind", "id", "neighbour", "similarity"])

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "part", "held", "role")]
            edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *edges], [*edges, len(batch)]):
                if key != (now := tuple(k[start] for k in keys[:3])):
                    yield from result()
                    key, asked_ids, asked_unit, best = now, np.zeros(0, np.int64), np.zeros((0, s.width)), {}
                part = batch.slice(start, end - start)
                ids, unit = part.column("id").to_numpy(), unit_rows(part.column("vector"), s.width)
                if keys[3][start] == 0:
                    asked_ids, asked_unit = np.concatenate([asked_ids, ids]), np.concatenate([asked_unit, unit])
                    continue
                for a in range(0, len(asked_ids), BLOCK):
                    own_ids, own = asked_ids[a : a + BLOCK], asked_unit[a : a + BLOCK]
                    rough = own.astype(np.float32) @ unit.T.astype(np.float32)
                    least = np.full(len(own), -np.inf)
                    if a in best:  # what a query's last place was worth so far
                        at, _, sims = best[a]
                        full = np.flatnonzero(np.bincount(at, minlength=len(own)) == s.k)
                        least[full] = sims[np.searchsorted(at, full, side="right") - 1]
                    elif rough.shape[1] > s.k + 1:
                        least = np.partition(rough, -(s.k + 1), axis=1)[:, -(s.k + 1)].astype(np.float64)
                    row, col = np.nonzero(rough >= (least - ROUGH)[:, None].astype(np.float32))
                    exact = products(own, unit, row, col)
                    at, old, sims = best.get(a, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
                    best[a] = best_of(own_ids, np.concatenate([at, row]), np.concatenate([old, ids[col]]), np.concatenate([sims, exact]))
        yield from result()

    ordered = together.select(columns).repartition(tasks, "kind", "part", "held").sortWithinPartitions(*columns[:5])
    return ordered.mapInArrow(scan, "kind string, id long, neighbour long, similarity double")


def nearest(vectors: DataFrame, asked: Column, s: Settings = Settings()) -> DataFrame:
    """For the rows of ``vectors`` (kind, id, vector) that meet ``asked``, their k most similar others of the kind:
    kind, id, neighbour, rank from 0, similarity (6 digits; equal ones go to the smaller id).

    However far the neighbours are: there the windows would hold most vectors, so every vector is verified. Queries and
    rows meet in blocks; no task holds more than HELD queries, whatever their number. Unusable vectors take no part.
    """
    vectors = usable(vectors, s.width).dropDuplicates(["kind", "id"])
    n, n_asked = vectors.agg(F.count("*"), F.count_if(asked)).first()
    parts, held = max(1, -(-n // TASK_ROWS)), max(1, -(-n_asked // HELD))
    spread = lambda of: F.pmod(F.xxhash64("kind", "id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    columns = ["kind", "part", "held", "role", "id", "vector"]
    queries = vectors.filter(asked).withColumn("held", spread(held)).withColumn("part", every(parts)).withColumn("role", F.lit(0))
    rows = vectors.withColumn("part", spread(parts)).withColumn("held", every(held)).withColumn("role", F.lit(1))

    found = compared(queries.select(columns).union(rows.select(columns)), parts * held, 6, s)
    order = Window.partitionBy("kind", "id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < s.k)


def candidates(rows: DataFrame, tasks: int, s: Settings) -> DataFrame:
    """Pairs (kind, id_a, id_b) that a cell found, from ``routed`` rows; pairs found in several cells repeat."""
    lines = np.random.default_rng([s.seed, 99]).standard_normal((s.width, s.lines)).astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(kind: str, ids: np.ndarray, home: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = similar_in_cell(x, home, lines, s)
            pairs = np.stack([ids[i], ids[j]])
            pairs = np.unique(np.sort(pairs, axis=0), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * pairs.shape[1]), pa.array(pairs[0]), pa.array(pairs[1])], names=["kind", "id_a", "id_b"])

        held: list[pa.RecordBatch] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            x = np.concatenate([unpacked(b.column("q"), s.width) for b in held])
            yield from found(key[0], *(whole.column(c).to_numpy() for c in ("id", "home")), x)

        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            tabs, cells = batch.column("tab").to_numpy(), batch.column("cell").to_numpy()
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (tabs[1:] != tabs[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for start, end in zip(np.concatenate([[0], edges]), np.concatenate([edges, [len(batch)]])):
                if held and key != (kinds[start], tabs[start], cells[start]):
                    yield from flush()
                    held = []
                key = (kinds[start], tabs[start], cells[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from flush()

    order = ["kind", "tab", "cell"]
    return rows.repartition(tasks, *order).sortWithinPartitions(*order, "id").mapInArrow(count, "kind string, id_a long, id_b long")


CROWD = "kind string, part long, held int, role int, id long, vector array<float>"


def crowd_pairs(vectors: DataFrame, way: Routing, full: dict[tuple[str, int, int], tuple[int, int]]) -> DataFrame:
    """Pairs (kind, id_a, id_b) of the ``full`` cells in which one is at home and the other among its best, every pair being compared."""
    s, grid, start = way.s, {}, 0
    for cell, (home, n) in sorted(full.items()):
        grid[cell] = (start, max(1, -(-n // TASK_ROWS)), max(1, -(-home // HELD)))  # first part, parts of the rows, blocks of the queries
        start += grid[cell][1]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, rows, _, tab, place, cells in way.placed(batch):
                salt = (rows.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for cell in np.unique(cells):
                    if (kind, tab, cell) not in grid:
                        continue
                    first, parts, blocks = grid[kind, tab, cell]
                    at = np.flatnonzero(cells == cell)
                    part, block = (salt[at] % np.uint64(parts)).astype(np.int64), (salt[at] % np.uint64(blocks)).astype(np.int32)
                    groups = [(1, part, np.full(len(at), b, np.int32)) for b in range(blocks)]
                    groups += [(0, np.full(len(at), p), block) for p in range(parts) if place == 0]
                    own = rows.take(pa.array(at))
                    for role, to, held in groups:
                        yield pa.RecordBatch.from_arrays(
                            [own.column("kind"), pa.array(first + to), pa.array(held), pa.array(np.full(len(at), role, np.int32)), own.column("id"), own.column("vector")],
                            names=["kind", "part", "held", "role", "id", "vector"],
                        )

    tasks = sum(parts * blocks for _, parts, blocks in grid.values())
    found = compared(vectors.select("kind", "id", "vector").mapInArrow(meet, CROWD), tasks, 12, s)
    best = F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc("similarity"), "neighbour"))
    kept = found.filter(F.col("similarity") >= s.floor - ROUGH).distinct().withColumn("rank", best).filter(F.col("rank") <= 2 * s.k)
    return kept.select("kind", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"))


def centres(vectors: DataFrame, sizes: dict[str, int], s: Settings) -> dict[str, np.ndarray]:
    """Mean direction of each kind, over a hashed sample of about ``s.sample`` rows."""
    step = max(1, sum(sizes.values()) // s.sample)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in dict.fromkeys(kinds):
                unit = unit_rows(batch.filter(pa.array(kinds == kind)).column("vector"), s.width)
                yield pa.RecordBatch.from_pydict({"kind": [kind], "n": [len(unit)], "total": [unit.sum(axis=0)]})

    sampled = vectors.filter(F.pmod(F.xxhash64("kind", "id"), F.lit(step)) == 0)
    parts = sampled.mapInArrow(sums, "kind string, n long, total array<double>").collect()  # a row for each batch of the sample
    out = {}
    for kind in sizes:
        own = [r for r in parts if r["kind"] == kind]
        out[kind] = np.sum([r["total"] for r in own], axis=0) / sum(r["n"] for r in own) if own else np.zeros(s.width)
    return out


def cosine(x: Column, y: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, e: t + e)
    return dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))


def similar_pairs(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Pairs (kind, id_a, id_b, similarity), id_a < id_b, of at least ``s.floor``, in which one is among the other's best k.

    ``vectors``: kind, id, vector. Unusable vectors take no part, equal similarities go to the smaller id. Repeated ids of
    a kind count once for each vector they come with; rows without id or vector take no part. Similarities are exact; a neighbour that
    the approximation misses may let the next one take its place.
    """
    vectors, classes, members = folded(usable(vectors, s.width), s)
    way = routing(vectors, s)
    full = crowded(vectors, way)
    found = candidates(routed(vectors, way, set(full)), way.tasks, s)
    if full:
        found = found.union(crowd_pairs(vectors, way, full))
    found = found.filter("id_a < id_b").distinct()
    for side in ("a", "b"):
        own = vectors.select("kind", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "same", "twin", "vector")))
        found = found.join(own, ["kind", f"id_{side}"])
    exact = found.withColumn("similarity", cosine(F.col("vector_a"), F.col("vector_b"))).drop("vector_a", "vector_b").filter(F.col("similarity") >= s.floor)
    if classes is not None:  # a class's k + 1 smallest ids stand for it: the best of the others are among them
        for side in ("a", "b"):
            own = classes.select("kind", *(F.col(c).alias(f"{c}_{side}") for c in ("same", "twin", "firsts")))
            ids = F.explode(F.coalesce(f"firsts_{side}", F.array(f"id_{side}")))
            exact = exact.join(own, ["kind", f"same_{side}", f"twin_{side}"], "left").withColumn(f"id_{side}", ids).drop(f"firsts_{side}")
        copies = members.select("kind", F.col("id").alias("id_a"), F.explode("firsts").alias("id_b"), cosine(F.col("vector"), F.col("vector")).alias("similarity"))
        exact = exact.select(copies.columns).union(copies.filter("id_a != id_b"))
    exact = exact.select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
    if classes is not None:
        exact = exact.distinct()  # pairs of a class's first ids come from both
    both = exact.select("*", F.explode(F.array("id_a", "id_b")).alias("query"))
    rank = F.row_number().over(Window.partitionBy("kind", "query").orderBy(F.desc("similarity"), F.when(F.col("query") == F.col("id_a"), F.col("id_b")).otherwise(F.col("id_a"))))
    return both.withColumn("rank", rank).filter(F.col("rank") <= s.k).select("kind", "id_a", "id_b", "similarity").distinct()
