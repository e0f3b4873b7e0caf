import json
import math

import pytest

from lodestone.operators import index, search, vectors
from lodestone.plans import finder
from lodestone.plans.store import SCHEMAS, IndexStore


@pytest.fixture(scope="module")
def golden(spark):
    chunks = spark.createDataFrame([(1, "get user"), (2, "user id")], "chunk_id long, content string")
    return chunks, index.postings(chunks)


def test_golden_numbers(golden):
    chunks, posts = golden
    idf = {r["term"]: r["idf"] for r in index.idf(posts, chunks).collect()}
    assert idf == pytest.approx({"get": math.log(1.5) + 1, "user": 1.0, "id": math.log(1.5) + 1}, abs=1e-9)
    w = index.weighted(posts, chunks)
    tfidf = {(r["chunk_id"], r["term"]): r["tfidf"] for r in w.collect()}
    assert tfidf == pytest.approx({(1, "get"): 0.7027325541, (1, "user"): 0.5, (2, "user"): 0.5, (2, "id"): 0.7027325541}, abs=1e-9)
    assert [r["magnitude"] for r in index.magnitudes(w, chunks).collect()] == pytest.approx([0.8624575598] * 2, abs=1e-9)
    df = {r["term"]: r["df"] for r in index.doc_freqs_of(posts, ["get", "user", "id", "missing", "get"]).collect()}
    assert df == {"get": 1, "user": 2, "id": 1, "missing": 0}


def test_magnitude_of_a_chunk_without_terms(spark):
    chunks = spark.createDataFrame([(1, "get"), (2, "-")], "chunk_id long, content string")
    got = {r["chunk_id"]: r["magnitude"] for r in index.magnitudes(index.weighted(index.postings(chunks), chunks), chunks).collect()}
    assert got[2] == 0.0 and got[1] > 0


CANDS = [(1, "a.go", "user", 2, 10), (1, "a.go", "get", 1, 10), (2, "b.go", "user", 1, 5)]


def ranked(spark, limit, avgdl=None):
    cands = spark.createDataFrame(CANDS, "chunk_id long, path string, term string, raw_freq int, dl int")
    weights = spark.createDataFrame([("user", 1.5), ("get", 1.2)], "term string, idf double")
    return search.bm25(cands, weights, ["get", "user"], limit, avgdl).collect()


def test_bm25(spark):
    got = ranked(spark, 10)
    gain = lambda idf, tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 7.5))
    assert [r["chunk_id"] for r in got] == [1, 2]
    assert got[0]["score"] == pytest.approx(gain(1.5, 2, 10) + gain(1.2, 1, 10))
    assert got[1]["score"] == pytest.approx(gain(1.5, 1, 5))
    assert got[0]["matched_terms"] == ["get", "user"] and got[0]["path"] == "a.go"
    assert ranked(spark, 0) == [] and ranked(spark, -3) == [] and len(ranked(spark, 1)) == 1


def test_fusion(spark):
    bm = spark.createDataFrame([(10, 4.0)], "chunk_id long, score double")
    near = spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, rank int")
    assert [tuple(r) for r in search.fuse(bm, near, 5).collect()] == [(10, 1.0), (20, 0.25)]
    assert [tuple(r) for r in search.fuse(bm, near, 5, -1).collect()] == [(10, 0.5 + 2.0), (20, 1.0)]
    assert [tuple(r) for r in search.fuse(bm, near, 5, 2).collect()] == [(10, 2.0 + 0.5), (20, 0.25)]
    assert [tuple(r) for r in search.fuse(bm.where("false"), near, 1).collect()] == [(10, 0.5)]


def test_vectors(spark):
    table = spark.createDataFrame([(i + 1, [float(i == j) for j in range(4)], f"{i}.go") for i in range(3)], "chunk_id long, embedding array<float>, metadata string")
    top = vectors.nearest(table, [1, 0, 0, 0], 2).collect()
    assert [(r["chunk_id"], r["metadata"], r["rank"]) for r in top] == [(1, "0.go", 1), (2, "1.go", 2)]
    new = spark.createDataFrame([(2, [9.0] * 4, "n"), (8, [1.0] * 4, "m")], table.schema)
    after = {r["chunk_id"]: r["metadata"] for r in vectors.upsert(table, new, 4).collect()}
    assert after == {1: "0.go", 2: "n", 3: "2.go", 8: "m"}
    assert vectors.delete(table, new).count() == 2
    with pytest.raises(Exception, match="dimension"):
        vectors.upsert(table, new, 5).collect()
    with pytest.raises(ValueError):
        vectors.check_dims(table, 0)
    assert vectors.nearest(table, [1, 0, 0, 0], 1, metric="cosine").first()["distance"] == pytest.approx(0)


def test_tables_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, content string")
    posts = index.postings(none)
    assert index.idf(posts, none).count() == 0 and index.token_counts(none).count() == 0
    assert index.corpus_size(none).first()["n"] == 1


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    own = IndexStore(spark, str(tmp_path_factory.mktemp("store") / "index"))
    files = spark.createDataFrame([(1, "src/a.go"), (2, "src/b.py"), (3, "docs/c.md")], "file_id long, path string")
    files = files.selectExpr("*", "'' AS content", "'' AS hash", "0L AS size", "0L AS mtime", "'' AS language", "0L AS indexed_at")
    texts = [(10, 1, "func getUser() { user }"), (20, 2, "def get_user(): pass"), (30, 3, "user guide"), (40, 99, "user orphan"), (50, 1, "nothing else")]
    chunks = spark.createDataFrame([(c, f, t, "text", 1, 2, None, 3) for c, f, t in texts], SCHEMAS["chunks"])
    own.load(files, chunks, spark.createDataFrame([(10, [0.0, 1.0], None), (50, [1.0, 0.0], None), (999, [1.0, 0.1], None)], SCHEMAS["vectors"]))
    return own


class Axis:
    def embed(self, texts):
        return [[1.0, 0.0] for _ in texts]


def test_find(store):
    ids = lambda *a, **k: [r["chunk_id"] for r in finder.find(store, *a, **k).results]
    assert ids("user") == [10, 30, 20] and ids("get user", limit=1) == [10]
    first = finder.find(store, "get user").results[0]
    assert first["uri"] == "file://src/a.go" and first["matched_terms"] == ["get", "user"] and first["content"].startswith("func") and (first["start_line"], first["end_line"]) == (1, 2)
    assert ids("user", filters=finder.Filters(extensions=["go"])) == [10] and ids("user", filters=finder.Filters("src/", [], ["b.py"])) == [10]
    assert finder.find(store, "-- !").message == "No search terms." and finder.find(store, "zebra").message == "No matches."
    assert finder.find(store, "user", filters=finder.Filters("zzz")).message == "No matches after filters." and finder.find(store, "user", filters=finder.Filters(exclude=[""])).message == "No matches after filters."
    assert finder.find(store, "user", limit=0) == finder.Answer([]) and finder.find(store, "orphan").message == "No matches."


def test_find_fused(store):
    got = finder.find(store, "user", limit=5, provider=Axis()).results
    # 50 is nearest by vector, 999 isn't in the index; 10 is third by vector and best by words
    assert [r["chunk_id"] for r in got][:2] == [10, 50] and 999 not in {r["chunk_id"] for r in got}
    assert got[1]["matched_terms"] == [] and got[1]["uri"] == "file://src/a.go" and got[1]["score"] == pytest.approx(0.5)
    assert got[0]["score"] == pytest.approx(0.5 + 0.5 / 3)


def test_rendering(store):
    rows = finder.find(store, "guide").results
    assert finder.as_markdown(store, rows, "/r") == "### 1. /r/docs/c.md (L1-L2)\n\n```\nuser guide\n```\n\n"
    assert finder.as_markdown(store, rows, content=False) == "### 1. docs/c.md (L1-L2)\n\n"
    one = json.loads(finder.as_json(store, rows, "/r"))["results"][0]
    assert one["path"] == "/r/docs/c.md" and one["uri"] == "file://docs/c.md" and "content" not in one and one["matched_terms"] == ["guide"]


def test_term_filter_reaches_the_scan(store):
    plan = store.terms(["get", "id"])._jdf.queryExecution().toString()
    assert "In(term, [get,id])" in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket#") or "PartitionFilters: [bucket" in plan
