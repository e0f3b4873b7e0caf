import numpy as np
import pyarrow as pa

from lodestone.llm.neighbours import nearest, similar_pairs


def brute(rows, k, least):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if s[a, b] >= least}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    rows = [(1000 - i, (centres[i % 30] + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(2000 + i, rows[0][1]) for i in range(25)]  # more copies than k
    rows += [(3000, rows[5][1])]
    bad = [(4000, None), (4001, [0.0] * 16), (4002, [1.0] * 4), (4003, [float("nan")] + [1.0] * 15), (4004, [None] + [1.0] * 15)]
    table = spark.createDataFrame([(*r, "m") for r in rows + bad + rows[:3]], "chunk_id long, embedding array<float>, id string")
    got = {(r["a"], r["b"]) for r in similar_pairs(nearest(table, 5, 0.8, 16)).collect()}
    want = brute(rows, 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    copies = {p for p in want if min(p) >= 2000 and max(p) < 3000}
    assert copies <= got


def test_small_leaves_and_equal_strings(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(i, (base + 1e-5 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    assert nearest(table, 3, 0.8, 8).groupBy("id").count().where("count = 3").count() == 300


def test_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert nearest(none, 3, 0.8, 8).count() == 0


def test_one_direction_of_many_norms(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8).astype(np.float32)
    rows = [(int(i), (base * np.float32(n)).tolist()) for i, n in zip(rng.permutation(5000), rng.uniform(0.1, 9, 5000))]
    got = {(r["id"], r["other"]) for r in nearest(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), 3, 0.8, 8).collect()}
    assert got == {(i, o) for i in range(5000) for o in [x for x in range(4) if x != i][:3]}


def test_undivided_run_across_windows(spark, monkeypatch):
    from lodestone.llm import neighbours

    rng = np.random.default_rng(9)
    base = rng.standard_normal(8)
    x = (base + 3e-5 * rng.standard_normal((600, 8))).astype(np.float32)
    ids = rng.permutation(600)
    unit = neighbours._matrix(pa.array(x.tolist(), pa.list_(pa.float32())), 8)
    pairs = {(int(ids[r]), int(o)) for row, other, _ in neighbours._best(ids, unit, 3, 0.8, 64, 128) for r, o in zip(row, other)}
    assert {(i, o) for i in range(600) for o in [y for y in range(4) if y != i][:3]} <= pairs
    monkeypatch.setattr(neighbours, "HELD_ROWS", 100)
    table = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "id long, v array<float>").repartition(1)
    got = {(r["id"], n["o"]) for r in neighbours.forest_neighbours(table, 3, 0.8, 8, 2, 50).collect() for n in r["near"]}
    assert got == {(i, o) for i in range(600) for o in [y for y in range(4) if y != i][:3]}
