"""The k most similar vectors of every vector, by a forest of hash prefixes.

Each tree gives a vector a long string of hyperplane bits. The strings of a
tree form a sorted array, kept in partitions whose borders are quantiles of a
sample; vectors travel as 16-bit numbers (an error of some 1e-6 in a
similarity). A run of the array with a
common prefix is descended into while it is larger than a leaf; neighbouring
small runs ascend to their common prefix again as long as they fit in one
leaf. Within a leaf all similarities are computed at once. The best of all
trees are merged for each vector.

Vectors of one direction (to 1e-6 in each place of the unit vector) are
collapsed before and spread out after, so a group of copies of any size costs a
row. A run that no bit of the string divides is held whole and compared in
blocks against all windows of itself; what equals the k-th best to 1e-6 is
chosen by the smaller id.

Defined cases: null vectors, vectors of another length than ``dims``, with a
null, NaN or infinite value, or all zero, take no part; repeated rows count
once; equal similarities are ordered by the smaller id; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import default_parallelism, materialize

#: A larger leaf costs more products, another tree a further copy of the vectors in the shuffle.
TREES, BITS, LEAF = 5, 128, 16_384
#: Rows of sorted arrays in a partition, and rows held in memory at once.
PARTITION_ROWS, HELD_ROWS = 131_072, 65_536
#: Rows compared at once, those that they are compared with, and the difference of similarities that rounding makes.
BLOCK, WINDOW, EQUAL = 1024, 16_384, 1e-6
#: Hashes of a sample that each border between partitions is chosen from.
SAMPLED = 64
SEED = 20_011


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id, v`` of the rows that take part, once each."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.where(v.isNotNull() & (F.size(v) == dims))
        .where(fine & F.exists(v, lambda x: x != 0))
        .select(F.col(key).alias("id"), F.transform(v, lambda x: x + F.lit(0.0).cast("float")).alias("v"))
        .dropDuplicates(["id"])
    )


def _planes(dims: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, trees * BITS)).astype(np.float32)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors of lists of floats, or of packed ones."""
    if pa.types.is_binary(column.type):
        x = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").astype(np.float32).reshape(-1, dims)
    else:
        x = np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dims)
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (x / n).astype(np.float32)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as 16-bit numbers, the largest value of each at the end of their range; their length doesn't matter."""
    q = np.rint(x * (32767 / np.abs(x).max(1, keepdims=True))).astype("<i2")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())


def _hashes(x: np.ndarray, planes: np.ndarray, tree: int) -> np.ndarray:
    return np.packbits(x @ planes[:, tree * BITS : (tree + 1) * BITS] > 0, axis=1).view(f"S{BITS // 8}").reshape(-1)


def _runs(bits: np.ndarray, lo: int, hi: int, leaf: int) -> list[tuple[int, int]]:
    """The sorted rows ``lo..hi`` as runs of at most ``leaf`` rows, or of rows equal in all bits."""
    out: list[tuple[int, int]] = []
    todo = [(lo, hi, 0)]
    while todo:
        a, b, bit = todo.pop()
        if b - a <= leaf or bit == bits.shape[1]:
            if out and b - a + out[-1][1] - out[-1][0] <= leaf:
                out[-1] = (out[-1][0], b)
            elif b > a:
                out.append((a, b))
            continue
        mid = a + int(np.searchsorted(bits[a:b, bit], 1))
        todo += [(mid, b, bit + 1), (a, mid, bit + 1)]
    return out


def _best(ids: np.ndarray, x: np.ndarray, k: int, least: float, block: int = BLOCK, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per row of ``x`` its ``k`` best others of each window: row numbers, their ids, similarities."""
    for a in range(0, len(x), block):
        for w in range(0, len(x), window):
            s = x[a : a + block] @ x[w : w + window].T
            other = ids[w : w + window]
            own = np.arange(max(a, w), min(a + len(s), w + s.shape[1]))
            s[own - a, own - w] = -2.0
            if s.shape[1] > 4 * k and (s >= least).sum() > 16 * k * len(s):
                cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                # all that equal the k-th best stay, so that the smaller ids can be chosen
                keep = s >= np.maximum(cut - EQUAL, least)[:, None]
                many = np.flatnonzero(keep.sum(1) > 2 * k)
                for r in many:
                    col = np.flatnonzero(keep[r])
                    keep[r] = False
                    keep[r, col[np.lexsort((other[col], _level(s[r, col])))[:k]]] = True
                row, col = np.nonzero(keep)
            else:
                row, col = np.nonzero(s >= least)
            sim = s[row, col]
            order = np.lexsort((other[col], _level(sim), row))
            row, col, sim = row[order], col[order], sim[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            keep = nth < k
            yield row[keep] + a, other[col[keep]], sim[keep]


def _level(sim: np.ndarray) -> np.ndarray:
    """Sorts similarities downwards, those that differ by rounding only as equal."""
    return -np.round(sim.astype(np.float64) / EQUAL)


def _lists(ids: np.ndarray, row: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """Sorted pairs as a list of neighbours for each row."""
    at = np.flatnonzero(np.diff(row, prepend=-1))
    offsets = pa.array(np.append(at, len(row)).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(sim.astype(np.float32)), pa.array(other)], names=["s", "o"])
    return pa.RecordBatch.from_arrays([pa.array(ids[row[at]]), pa.ListArray.from_arrays(offsets, pairs)], names=["id", "near"])


NEAR = "id bigint, near array<struct<s: float, o: bigint>>"


def forest_neighbours(vectors: DataFrame, k: int, least: float, dims: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``id, near`` with up to ``k`` others of similarity ``least`` or more, for distinct ``id, v``."""
    rows = vectors.count()
    per = max(1, -(-max(default_parallelism(vectors.sparkSession), -(-rows * trees // PARTITION_ROWS)) // trees))
    borders = _borders(vectors, rows, dims, trees, per)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dims, trees)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            packed = _packed(x)
            for t in range(trees):
                h = _hashes(x, planes, t)
                part = t * per + np.searchsorted(borders[t], h, side="right")
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(x), [None, pa.py_buffer(h)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), raw, batch.column(0), packed], names=["part", "h", "id", "v"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, HELD_ROWS

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, limit
            table = pa.Table.from_batches(held).combine_chunks()
            tree = np.asarray(table.column(0)) // per
            ids = np.asarray(table.column(2))
            x = _matrix(table.column(3).chunk(0), dims)
            raw = np.frombuffer(b"".join(table.column(1).to_pylist()), dtype=np.uint8).reshape(len(ids), BITS // 8)
            bits = np.unpackbits(raw, axis=1)
            # a run that no bit divides waits until all of it is held
            unlike = np.flatnonzero((raw != raw[-1]).any(1) | (tree != tree[-1]))
            begin = int(unlike[-1]) + 1 if len(unlike) else 0
            done = len(ids) if last or len(ids) - begin <= leaf else begin
            for a, b in zip(*_edges(tree[:done])):
                for lo, hi in _runs(bits, a, b, leaf):
                    for row, other, sim in _best(ids[lo:hi], x[lo:hi], k, least):
                        if len(row):
                            yield _lists(ids[lo:hi], row, other, sim)
            # the end of what is held may cut a run: it is seen again with what follows
            held = [] if last else [b for b in table.slice(max(0, done - leaf)).to_batches()]
            size = sum(b.num_rows for b in held)
            limit = max(HELD_ROWS, 2 * size)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= limit:
                    yield from flush(False)
        if held:
            yield from flush(True)

    sorted_arrays = (
        vectors.select("id", "v")
        .mapInArrow(hashes, "part int, h binary, id bigint, v binary")
        .repartitionById(per * trees, F.col("part"))
        .sortWithinPartitions("part", "h")
    )
    lists = sorted_arrays.mapInArrow(leaves, NEAR).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return lists.mapInArrow(lambda batches: _merge(batches, k), NEAR)


def _borders(vectors: DataFrame, rows: int, dims: int, trees: int, per: int) -> list[np.ndarray]:
    """For each tree the hashes that part its sorted array evenly, from a sample of some SAMPLED rows a partition."""
    most = SAMPLED * per
    share = max(1, rows // most)
    own = vectors.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("v").limit(4 * most).toArrow()
    if per == 1 or not own.num_rows:
        return [np.empty(0, f"S{BITS // 8}")] * trees
    x, planes = _matrix(own["v"].combine_chunks(), dims), _planes(dims, trees)
    at = np.arange(1, per) * len(x) // per
    return [np.sort(_hashes(x, planes, t))[at] for t in range(trees)]


def _edges(tree: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(tree):
        return [], []
    cut = np.flatnonzero(np.diff(tree)) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(tree)]


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` distinct neighbours of each row over all trees."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = batch.column(1)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(near.value_lengths()))
        flat = near.flatten()
        sim, other = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        order = np.lexsort((-sim, other, row))
        row, other, sim = row[order], other[order], sim[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
        row, other, sim = row[first], other[first], sim[first]
        order = np.lexsort((other, _level(sim), row))
        row, other, sim = row[order], other[order], sim[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        yield _lists(np.asarray(batch.column(0)), row[keep], other[keep], sim[keep])


def nearest(vectors: DataFrame, k: int, least: float, dims: int, key: str = "chunk_id", vector: str = "embedding", trees: int = TREES) -> DataFrame:
    """``id, other, similarity``: the ``k`` most similar others of each row, those of ``least`` or more."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # vectors of one direction are copies whatever their norms
    # (the norm in an array is computed once a vector, not once a value)
    unit = F.transform(F.array(norm), lambda n: F.transform("v", lambda x: F.round(x.cast("double") / n / EQUAL).cast("int")))
    way = usable(vectors, key, vector, dims).withColumn("w", unit)
    own = materialize(way.select("id", "v", F.xxhash64("w").alias("h1"), F.hash("w").alias("h2")), "vectors")
    groups = materialize(own.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    singles = own.select("id", "v").join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    near = forest_neighbours(singles, k, least - 1e-5, dims, trees)
    # of a group of copies only the k + 1 least ids can be anyone's neighbour
    members = own.select("id", "h1", "h2").join(groups.where("n > 1").select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    least_ids = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(least_ids)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = near.select(F.col("id").alias("rep"), F.explode("near").alias("n")).select("rep", F.col("n.o").alias("o"), F.col("n.s").cast("double").alias("s"))
    spread = (
        pairs.join(heads.select(F.col("rep").alias("o"), "ids"), "o", "left")
        .select("rep", F.struct((-F.col("s")).alias("d"), F.coalesce("ids", F.array("o")).alias("ids")).alias("e"))
        .union(heads.select("rep", F.struct(F.lit(-1.0).alias("d"), F.col("ids")).alias("e")))
        .groupBy("rep")
        .agg(F.collect_list("e").alias("es"))
    )
    each = F.flatten(F.transform("es", lambda e: F.transform(e["ids"], lambda i: F.struct(F.round(e["d"] / EQUAL).alias("level"), i.alias("o"), e["d"].alias("d")))))
    lists = spread.select("rep", F.slice(F.sort_array(each), 1, k + 1).alias("near"))
    everyone = own.join(groups.where("n > 1").select("h1", "h2", "rep"), ["h1", "h2"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return (
        everyone.join(lists, "rep")
        .select("id", F.explode(F.slice(F.filter("near", lambda e: e["o"] != F.col("id")), 1, k)).alias("e"))
        .select("id", F.col("e.o").alias("other"), (-F.col("e.d")).alias("similarity"))
        .where(F.col("similarity") >= least)
    )


def similar_pairs(found: DataFrame) -> DataFrame:
    """``a, b``: pairs of which one is among the other's nearest, the smaller id first."""
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
