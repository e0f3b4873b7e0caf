"""Fill containers of a fixed capacity with whole items, wasting little.

Items are counted by length, so the plan works on at most ``capacity``
counters whatever the number of items. Planning takes the longest length left
and looks its gap up among the single, pair and triple sums of the lengths
still available; a hit is consumed as many times as the counts allow. Lengths
without an exact complement take the longest item that fits and try again
(best fit). The plan is a list of patterns with multiplicities; items get a
rank within their length in parallel and read their container off the plan.

Defined cases: items of length zero, null or negative are left out; an item
longer than the capacity is cut into full pieces and a rest, all numbered by
``piece``; equal lengths are interchangeable, ranked by key; repeated rows are
items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import default_parallelism, materialize


class _Sums:
    """Lengths still available, with an index of their pair sums."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts, self.capacity = counts, capacity

    def lengths(self, most: int) -> np.ndarray:
        return np.flatnonzero(self.counts[: most + 1])[::-1]

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.counts[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        a = self.lengths(gap - 1)
        b = gap - a
        ok = (a >= b) & (self.counts[b] > (a == b))
        hit = np.flatnonzero(ok)
        return (int(a[hit[0]]), int(b[hit[0]])) if hit.size else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in self.lengths(gap - 2).tolist():
            if 3 * a < gap:
                break
            self.counts[a] -= 1
            rest = self.pair(gap - a)
            self.counts[a] += 1
            if rest and rest[0] <= a:
                return (a, *rest)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many containers each fills."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    sums, plan = _Sums(left, capacity), []
    for top in range(capacity, 0, -1):
        while left[top]:
            left[top] -= 1
            pattern, gap = [top], capacity - top
            while gap:
                rest = sums.fill(gap)
                if rest is None:
                    fits = sums.lengths(gap)
                    if not fits.size:
                        break
                    rest = (int(fits[0]),)
                for x in rest:
                    left[x] -= 1
                pattern += rest
                gap -= sum(rest)
            need = np.bincount(pattern, minlength=capacity + 1)
            used = np.flatnonzero(need)
            again = int((left[used] // need[used]).min())
            left[used] -= again * need[used]
            plan.append((tuple(pattern), 1 + again))
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int):
    """Per length: ranks where a pattern begins, its items a container, its first container."""
    starts, per, base = {}, {}, {}
    seen = np.zeros(capacity + 1, dtype=np.int64)
    first = 0
    for pattern, times in plan:
        for length in set(pattern):
            k = pattern.count(length)
            starts.setdefault(length, []).append(int(seen[length]))
            per.setdefault(length, []).append(k)
            base.setdefault(length, []).append(first)
            seen[length] += k * times
        first += times
    return {x: (np.array(starts[x]), np.array(per[x]), np.array(base[x])) for x in starts}


def split_oversized(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """``key, piece, length``: full pieces and a rest for items above the capacity."""
    n = F.expr(f"cast(`{size}` as bigint)")
    return (
        items.select(F.col(key).alias("key"), n.alias("n"))
        .where("n > 0")
        .select("key", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {capacity})")).alias("piece"))
        .select("key", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))
    )


def pack(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """``key, piece, length, container`` for every item of positive size."""
    kind = items.schema[key].dataType.simpleString()
    spread = 8 * default_parallelism(items.sparkSession)
    pieces = materialize(
        split_oversized(items, capacity, key, size).withColumn("bin", F.pmod(F.xxhash64("key", "piece"), F.lit(spread)).cast("int")),
        "pieces",
    )
    by_bin = pieces.groupBy("length", "bin").agg(F.count("*").alias("n"))
    # at most `capacity` rows, whatever the number of items
    counts = {r["length"]: r["n"] for r in by_bin.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = items.sparkSession.sparkContext.broadcast(_slots(plan_patterns(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bin.select("length", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("length", "bin").orderBy("key", "piece")
    ranked = (
        pieces.withColumn("r", F.row_number().over(own) - 1)
        .join(offsets, ["length", "bin"])
        .select("key", "piece", "length", (F.col("start") + F.col("r")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (2, 3))
            container = np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                start, per, base = slots.value[int(length[own[0]])]
                at = np.searchsorted(start, rank[own], side="right") - 1
                container[own] = base[at] + (rank[own] - start[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(container)], names=["key", "piece", "length", "container"])

    return ranked.mapInArrow(place, f"key {kind}, piece int, length int, container bigint").withColumnRenamed("key", key)
