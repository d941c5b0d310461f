"""Problem 5: documents into containers of one capacity.

Only the histogram of sizes reaches the driver. It has at most ``capacity`` entries, whatever the number of documents,
and the plan made from it is a list of runs ("the next r documents of size s, k to a container, from container c on").
Spark measures the documents, numbers them within their size and looks each one up in that list.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.ranking import rank_within

#: Items of at least capacity / BIG_PARTS tokens are planned by the linear program, smaller ones fill what is left.
BIG_PARTS = 16
#: Cells of the knapsack table; sizes are rounded up to capacity / GRID for pricing only.
GRID = 256
#: Ratio of neighbouring size classes of the linear program.
CLASS_RATIO = 1.08
#: Accuracy of the multiplicative weights: coverage is driven to ln(classes) / EPSILON**2.
EPSILON = 0.3


@dataclass
class Plan:
    """Runs of equal placements: ``count`` items of ``size`` from ``rank`` on, ``per`` to a container, from ``container`` on."""

    size: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    containers: int = 0

    def add(self, size: int, rank: int, container: int, per: int) -> None:
        self.size.append(size)
        self.rank.append(rank)
        self.container.append(container)
        self.per.append(per)


def best_configuration(weights: np.ndarray, values: np.ndarray, room: int) -> np.ndarray:
    """Copies of each item, by unbounded knapsack over ``room`` cells, whose values add up to the most."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(weights, kind="stable")
    ascending, worth = weights[order], values[order]
    for cell in range(int(ascending[0]), room + 1):
        fits = int(np.searchsorted(ascending, cell, side="right"))
        totals = best[cell - ascending[:fits]] + worth[:fits]
        top = int(totals.argmax())
        if totals[top] > best[cell - 1]:
            best[cell], choice[cell] = totals[top], order[top]
        else:
            best[cell] = best[cell - 1]
    copies, cell = np.zeros(len(weights), dtype=np.int64), room
    while cell > 0:
        if choice[cell] < 0:
            cell -= 1
            continue
        copies[choice[cell]] += 1
        cell -= int(weights[choice[cell]])
    return copies


def configuration_program(weights: np.ndarray, demand: np.ndarray, room: int, epsilon: float = EPSILON) -> list[tuple[float, np.ndarray]]:
    """Configurations and how often each is used so that all demand is covered, near the fewest containers.

    Multiplicative weights: a class counts exp(-coverage), the knapsack prices the configuration that covers most, and it
    is used until its tightest class is covered once more. At the end all uses are scaled down to coverage one.
    """
    classes = len(weights)
    target = np.log(max(classes, 2)) / epsilon**2
    coverage, used = np.zeros(classes), {}
    while (low := coverage < target).any():
        price = np.where(low, np.exp(-epsilon * (coverage - coverage.min())), 0.0) / demand
        copies = np.minimum(best_configuration(weights, price, room), np.ceil(demand).astype(np.int64))
        taken = copies > 0
        step = float((demand[taken] / copies[taken]).min())
        coverage += step * copies / demand
        used[copies.tobytes()] = used.get(copies.tobytes(), 0.0) + step
    return [(times / target, np.frombuffer(key, dtype=np.int64)) for key, times in sorted(used.items(), key=lambda x: (-x[1], x[0]))]


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """Placements of all items of a histogram (size to count; sizes from 0 to ``capacity``).

    The program's uses are rounded down, then up as long as the remaining items fill the whole configuration. Items that
    are left, and all small ones, go largest first to the fullest container that holds them. Containers with equal room
    are kept as one run, so the work depends on the number of sizes, not of items.
    """
    plan, ranks = Plan(), dict.fromkeys(histogram, 0)
    left = {s: n for s, n in histogram.items() if n > 0}
    open_runs: list[tuple[int, int, int]] = []  # room, first container, containers

    def place(size: int, per: int, container: int, containers: int) -> None:
        plan.add(size, ranks[size], container, per)
        ranks[size] += per * containers
        left[size] -= per * containers

    big = sorted((s for s in left if s * BIG_PARTS >= capacity), reverse=True)
    if big:
        bounds = [big[-1]]
        while bounds[-1] < big[0]:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
        of = {s: bisect.bisect_left(bounds, s) for s in big}
        classes = sorted(set(of.values()))
        queues = {c: [s for s in big if of[s] == c] for c in classes}
        demand = np.array([sum(left[s] for s in queues[c]) for c in classes], dtype=float)
        cells = np.array([-(-queues[c][0] * GRID // capacity) for c in classes])
        program = configuration_program(cells, demand, GRID)
        stock = demand.copy()
        for rounding in (np.floor, np.ceil):
            for times, copies in program:
                if rounding is np.ceil:
                    times -= np.floor(times)
                needed = copies > 0
                whole = int(min(rounding(times + 1e-9), (stock[needed] // copies[needed]).min()))
                stock -= whole * copies
                while whole > 0:  # a stretch of containers that get the same sizes
                    contents: dict[int, int] = {}
                    for c, n in zip(classes, copies):
                        for size in queues[c]:
                            take = min(int(n), left[size] - contents.get(size, 0))
                            if take > 0:
                                contents[size] = take
                                n -= take
                            if n == 0:
                                break
                    stretch = min(whole, *(left[s] // n for s, n in contents.items()))
                    for size, n in contents.items():
                        place(size, n, plan.containers, stretch)
                    for c in classes:
                        queues[c] = [s for s in queues[c] if left[s] > 0]
                    bisect.insort(open_runs, (capacity - sum(s * n for s, n in contents.items()), plan.containers, stretch))
                    plan.containers += stretch
                    whole -= stretch
    for size in sorted(left, reverse=True):
        while left[size] > 0:
            at = bisect.bisect_left(open_runs, (size, -1, -1))
            room, first, containers = open_runs.pop(at) if at < len(open_runs) else (capacity, plan.containers, None)
            per = left[size] if size == 0 else min(room // size, left[size])
            wanted = max(1, left[size] // per)
            if containers is None:
                containers = wanted
                plan.containers += wanted
            filled = min(wanted, containers)
            place(size, per, first, filled)
            bisect.insort(open_runs, (room - size * per, first, filled))
            if filled < containers:
                bisect.insort(open_runs, (room, first + filled, containers - filled))
    return plan


def look_up(plan: Plan, size: Column, rank: Column) -> Column:
    """Container of the item with this rank within its size."""
    order = np.lexsort((plan.rank, plan.size)) if plan.size else np.array([], dtype=int)
    sizes, ranks, firsts, pers = (np.array(x, dtype=np.int64)[order] for x in (plan.size, plan.rank, plan.container, plan.per))
    starts = {int(s): (int(a), int(b)) for s, a, b in zip(*np.unique(sizes, return_index=True), np.append(np.unique(sizes, return_index=True)[1][1:], len(sizes)))}

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for size, rank in batches:
            out = np.zeros(len(size), dtype=np.int64)
            for s, rows in pd.Series(np.arange(len(size))).groupby(size.to_numpy()):
                a, b = starts[int(s)]
                r = rank.to_numpy()[rows]
                run = a + np.searchsorted(ranks[a:b], r, side="right") - 1
                out[rows] = firsts[run] + (r - ranks[run]) // pers[run]
            yield pd.Series(out)

    return container(size, rank)


def pack(items: DataFrame, capacity: int) -> tuple[DataFrame, Plan]:
    """Containers for ``items`` (id, tokens): one row per piece (id, piece, tokens, container), and the plan.

    An item over the capacity is cut into full pieces and a rest; no other item is cut. Repeated ids are separate items;
    null sizes count as 0 and take no room. ``items`` is read twice, so it should be settled.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    last = F.greatest(F.lit(0), F.floor((tokens - 1) / capacity))
    pieces = (
        items.select("id", tokens.alias("_all"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
        .withColumn("tokens", F.least(F.lit(capacity), F.col("_all") - F.col("piece").cast("long") * capacity))
        .drop("_all")
    )
    histogram = {r["tokens"]: r["count"] for r in pieces.groupBy("tokens").count().collect()}  # at most capacity + 1 rows
    plan = plan_containers(histogram, capacity)
    ranked = rank_within(pieces, "tokens", ["id", "piece"], sum(histogram.values()))
    return ranked.withColumn("container", look_up(plan, F.col("tokens"), F.col("rank"))).drop("rank"), plan
