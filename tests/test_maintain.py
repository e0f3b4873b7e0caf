import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import maintain
from lodestone.plans.store import SCHEMAS, Conflict, IndexStore, ProjectMetadata
from lodestone.sources import embeddings, scan
from lodestone.streaming import watch


def test_scan(spark, tmp_path):
    for name, text in {"a.go": "x", "sub/b.go": "y" * 100, "skip.ign": "z", "node_modules/x/y.js": "n", "c.PY": "p", ".gitignore": "*.ign\n!keep.ign\n/only/\n", "keep.ign": "k", "only/x.go": "o", "deep/only/x.go": "o"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    names = lambda **kw: sorted(r["relative"] for r in scan.scan(spark, str(tmp_path), **kw).collect())
    assert names(extensions=[".go"]) == ["a.go", "deep/only/x.go", "sub/b.go"]
    assert names(extensions=[".py"]) == ["c.PY"]
    assert names(max_size=50, extensions=[".go"]) == ["a.go", "deep/only/x.go"]
    assert "keep.ign" in names() and "skip.ign" not in names() and "node_modules/x/y.js" not in names()
    assert "skip.ign" in names(use_ignore=False)
    read = {r["path"]: r for r in scan.read_files(spark, str(tmp_path), extensions=[".go"]).collect()}
    assert read["a.go"]["content"] == "x" and read["a.go"]["language"] == "go" and len(read["a.go"]["hash"]) == 64


def test_languages(spark):
    df = spark.createDataFrame([(".GO",), ("go",), (".txt",), ("tsx",)], "e string")
    assert [r[0] for r in df.select(scan.language_for(F.col("e"))).collect()] == ["go", "go", None, "tsx"]
    assert scan.language_table(spark).count() == len(scan.LANGUAGES)


FILE = "path string, content string, hash string, size long, mtime long, language string, indexed_at long"


def rows(spark, *items):
    return spark.createDataFrame([(p, c, str(hash(c)), len(c), m, "go", 1) for p, c, m in items], FILE)


def test_change_detection(spark):
    stored = rows(spark, ("a", "x", 1000), ("b", "y", 1000), ("c", "z", 1000), ("d", "w", 1000))
    now = rows(spark, ("a", "x", 2000), ("b", "y", 2001), ("c", "zz", 1000), ("e", "n", 1))
    assert {r["path"] for r in maintain.changed(now, stored).collect()} == {"b", "c", "e"}
    assert {r["path"] for r in maintain.changed(now, stored, by_time=False).collect()} == {"c", "e"}
    assert [r["path"] for r in maintain.vanished(stored, now).collect()] == ["d"]


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


def content(store, name, *cols):
    return sorted(tuple(r) for r in store.table(name).select(*cols).collect())


def test_incremental_equals_rebuild(spark, store, tmp_path):
    first = rows(spark, ("a.go", "package a\nfunc F() {}\n", 1), ("b.go", "package b\nfunc Old() {}\n", 1))
    second = rows(spark, ("a.go", "package a\nfunc F() {}\n", 1), ("b.go", "package b\nfunc NewContent() {}\n", 9000), ("c.go", "x\n" * 900, 5))
    assert store.refresh(first) == {"indexed": 2, "removed": 0}
    assert store.refresh(first) == {"indexed": 0, "removed": 0}
    ids = dict(content(store, "files", "path", "file_id"))
    assert store.refresh(second) == {"indexed": 2, "removed": 0}
    assert dict(content(store, "files", "path", "file_id"))["b.go"] == ids["b.go"]
    assert store.status()["chunks"] == store.table("chunks").count() and store.status()["files"] == 3
    other = IndexStore(spark, str(tmp_path / "other"))
    other.refresh(second)
    for name, cols in (("files", ("path", "hash")), ("chunks", ("chunk_id", "content", "start_line", "end_line", "token_count")), ("postings", ("chunk_id", "term", "raw_freq"))):
        assert content(store, name, *cols) == content(other, name, *cols)
    store.put_vectors(store.table("chunks").select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("m").alias("metadata")))
    assert store.refresh(second.where("path <> 'b.go'")) == {"indexed": 0, "removed": 1}
    assert store.table("vectors").count() == store.table("chunks").count() and store.status()["files"] == 2
    assert store.refresh(second, skip_unchanged=False)["indexed"] == 3


def test_a_failing_commit_leaves_the_old_snapshot(spark, store):
    store.refresh(rows(spark, ("a.go", "x y z", 1)))
    before, held = store.version, store.folder.names("files")
    with pytest.raises(Exception):
        store.commit({"files": store.table("files"), "chunks": store.rows("chunks").withColumn("type", F.raise_error(F.lit("no")))})
    assert store.version == before and store.table("files").count() == 1
    assert store.folder.names("files") == held or store.folder.names("files") == []


def test_of_two_writers_the_second_fails(spark, store, monkeypatch):
    store.refresh(rows(spark, ("a.go", "x y z", 1)))
    late = store.version - 1
    monkeypatch.setattr(IndexStore, "version", property(lambda self: late))
    with pytest.raises(Conflict):
        store._publish(late + 1, {"segments": {}})


def test_a_commit_writes_what_changed(spark, store):
    store.refresh(rows(spark, *[(f"{i}.go", f"package p{i}\nfunc F{i}() {{}}\n", 1) for i in range(20)]))
    assert store.refresh(rows(spark, *[(f"{i}.go", f"package p{i}\nfunc F{i}() {{}}\n" if i else "package changed\n", 1) for i in range(20)]))["indexed"] == 1
    last = store.manifest()["segments"]["files"][-1]
    assert spark.read.parquet(f"{store.folder.path}/files/{last}").count() == 1 and store.rows("files").count() == 20
    assert store.terms(["changed"]).count() == 1 and store.terms(["p0"]).count() == 0 and store.terms(["nosuch"]).count() == 0


def test_rebuild_compact_vacuum(spark, store):
    store.load(
        spark.createDataFrame([(1, "a.go", "", "", 1, 1, "go", 1)], "file_id long, path string, content string, hash string, size long, mtime long, language string, indexed_at long"),
        spark.createDataFrame([(1, 1, "get user", "text", 1, 1, None, 2), (2, 1, "user id", "text", 1, 1, None, 2), (3, 9, "-", "text", 1, 1, None, 0)], SCHEMAS["chunks"]),
    )
    assert {r["tfidf"] for r in store.rows("postings").collect()} == {None}
    store.manifest()
    store.commit({"gone_chunks": spark.createDataFrame([(3,)], "chunk_id long")})
    store.rebuild()
    assert {r["term"]: round(r["idf"], 10) for r in store.rows("idf").collect()} == {"get": 1.4054651081, "user": 1.0, "id": 1.4054651081}
    assert {(r["chunk_id"], r["term"]): round(r["tfidf"], 10) for r in store.rows("postings").collect()} == {(1, "get"): 0.7027325541, (1, "user"): 0.5, (2, "user"): 0.5, (2, "id"): 0.7027325541}
    assert {r["chunk_id"]: round(r["magnitude"], 10) for r in store.table("chunks").collect()} == {1: 0.8624575598, 2: 0.8624575598}
    before = content(store, "postings", "chunk_id", "term", "tfidf")
    store.compact()
    assert content(store, "postings", "chunk_id", "term", "tfidf") == before and store.manifest()["segments"]["gone_chunks"] == []
    assert store.vacuum() > 0 and content(store, "postings", "chunk_id", "term", "tfidf") == before
    assert all(len(store.folder.names(n)) <= 1 for n in SCHEMAS)


def test_put_chunks_and_vectors(spark, store):
    store.refresh(rows(spark, ("a.go", "x yy zz", 1)))
    own = store.file("a.go").first()["file_id"]
    new = lambda f: spark.createDataFrame([(77, f, "fresh words", "text", 1, 1, None)], "chunk_id long, file_id long, content string, type string, start_line int, end_line int, metadata string")
    with pytest.raises(KeyError, match="file not found"):
        store.put_chunks(new(12345))
    store.put_chunks(new(own))
    assert [r["chunk_id"] for r in store.rows("chunks").collect()] == [77] and store.terms(["yy"]).count() == 0 and store.terms(["fresh"]).first()["file_id"] == own
    vector = lambda v: spark.createDataFrame([(77, v, "m")], SCHEMAS["vectors"])
    store.put_vectors(vector([1.0, 2.0]), 2)
    store.put_vectors(vector([3.0, 4.0]), 2)
    assert [r["embedding"] for r in store.rows("vectors").collect()] == [[3.0, 4.0]]
    with pytest.raises(Exception, match="dimension"):
        store.put_vectors(vector([1.0]), 2)
    store.delete_vectors(vector([]))
    assert store.rows("vectors").count() == 0
    assert store.apply(None) == store.version and store.file("nosuch").first() is None


def test_migrations_run_once(spark, store, monkeypatch):
    from lodestone.plans import store as module

    assert store.migrate() == [] and store.manifest()["migrations"] == ["001_schema"]
    monkeypatch.setitem(module.MIGRATIONS, "002_note", lambda m: m | {"note": 1})
    again = IndexStore(spark, store.folder.path)
    assert again.manifest()["note"] == 1 and again.migrate() == [] and again.manifest()["migrations"] == ["001_schema", "002_note"]


def test_metadata(spark, tmp_path):
    m = ProjectMetadata(spark, str(tmp_path))
    assert m.read() is None
    m.set_rebuilt()
    assert m.read() is None
    first = m.ensure("/r")
    assert first["name"] == "." and first["createdAt"] == first["lastAccessedAt"] and first["idfRebuildCompletedAt"] == ""
    time.sleep(0.002)
    assert m.ensure("/r")["lastAccessedAt"] > first["createdAt"] and m.read()["createdAt"] == first["createdAt"]
    m.set_rebuilt()
    assert m.read()["idfRebuildCompletedAt"]
    m.set_rebuilt("")
    assert m.read()["idfRebuildCompletedAt"] == ""
    (tmp_path / "metadata.json").write_text("{broken")
    assert m.ensure("/r")["path"] == "/r"


def test_providers(spark):
    a = embeddings.HashProvider(8).embed(["x", "y", "x"])
    assert a[0] == a[2] != a[1] and sum(v * v for v in a[0]) == pytest.approx(1)
    p = embeddings.HttpProvider(base="http://h", model="m", key="k", num_ctx=10, max_chars=0)
    assert p.request(["abcdefghijklmnopqrstuvwxyz"]) == {"model": "m", "input": "abcdefghijklmnopqrst", "options": {"num_ctx": 10}}
    assert p.request(["abcdefghijkl", "b"])["input"] == ["abcdefghij", "b"]
    with pytest.raises(ValueError):
        embeddings.HttpProvider(base=embeddings.DEFAULT_BASE, key="").request(["x"])

    class Failing:
        def embed(self, texts):
            raise OSError("down")

    chunks = spark.createDataFrame([(1, "fine"), (2, "a\0b")], "chunk_id long, content string")
    assert [(r["chunk_id"], r["status"]) for r in embeddings.embed_chunks(chunks, Failing()).collect()] == [(1, "failed: OSError")]
    assert embeddings.embed_chunks(chunks, embeddings.ZeroProvider(3)).first()["embedding"] == [0.0] * 3


EVENTS = [("a.go", "Create", 0), ("a.go", "write", 5), ("a.go", "REMOVE", 400), ("b.go", "rename", 1), (None, "write", 1), ("vendor/x.go", "write", 1), ("c.txt", "write", 2), ("a.go", "write", 2000)]


def events(spark):
    return spark.createDataFrame(EVENTS, "path string, op string, t int").select("path", "op", F.timestamp_seconds("t").alias("ts"))


def test_debounce_forms_agree(spark):
    own = watch.relevant(events(spark), [".go"])
    a = watch.debounce(own, "600 seconds", ["path"]).select("path", "last_ts", "op", "events")
    b = watch.debounce_batch(own, 600, ["path"]).select("path", "last_ts", "op", "events")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted((r["op"], r["events"]) for r in b.collect()) == [("Change", 1), ("Remove", 3)]


def test_stream(spark, store, tmp_path):
    src = tmp_path / "events"
    texts = {"a.go": "package a", "b.go": "package b"}

    def read_paths(paths):
        table = rows(spark, *[(p, t, 1) for p, t in texts.items()])
        return table.join(paths, "path", "left_semi")

    def run(batch, name):
        spark.createDataFrame(batch, "path string, op string, t int").select("path", "op", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema("path string, op string, ts timestamp").json(str(src))
        q = watch.apply_stream(stream, store, read_paths, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    run([("a.go", "create", 1), ("b.go", "create", 1)], "1")
    assert store.table("files").count() == 2
    run([("a.go", "write", 2), ("b.go", "remove", 3)], "2")
    assert [r["path"] for r in store.table("files").collect()] == ["a.go"]
    assert os.path.exists(store.folder.path)
