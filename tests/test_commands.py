import io
import json
import os
import time

import pytest

from lodestone import commands
from lodestone.plans.indexer import Indexer
from lodestone.plans.store import ProjectMetadata
from lodestone.sources import embeddings, scan
from lodestone.streaming.source import DirectoryEvents, differences, listing

GO = 'package a\n\nimport "net/http"\n\nfunc HandleRequest(w http.ResponseWriter) {\n\tw.Write(nil)\n}\n\nfunc Other() {\n}\n'


@pytest.fixture
def root(tmp_path):
    own = tmp_path / "root"
    (own / "vendor").mkdir(parents=True)
    (own / "api.go").write_text(GO)
    (own / "lib.js").write_text("function loadFile() {\n  return 1;\n}\nclass Store {\n}\n")
    (own / "notes.txt").write_text("handle with care\n")
    (own / "skip.bin").write_text("handle request")
    (own / "vendor" / "x.go").write_text("package handle\n")
    return own


@pytest.fixture
def run(spark, root, tmp_path, capsys):
    def go(*argv):
        code = commands.main(["--root", str(root), "--home", str(tmp_path / "home"), *argv], spark)
        said = capsys.readouterr()
        return code, said.out, said.err

    return go


def test_console(run, root):
    assert run("status")[0] == 1 and "index not found for root" in run("search", "x")[2]
    code, out, _ = run("index")
    assert code == 0 and out.startswith("indexed files: 3, chunks: ")
    out = run("search", "handle request")[1]
    assert out.startswith(f"### 1. {root}/api.go (L") and "```" not in out
    assert "func HandleRequest" in run("search", "handle request", "--include-content")[1]
    assert run("search", "handle", "--ext", "txt")[1].count("###") == 1
    got = json.loads(run("--json", "search", "handle request", "--limit", "1")[1])["results"]
    assert len(got) == 1 and got[0]["path"] == f"{root}/api.go" and "content" not in got[0] and got[0]["matched_terms"] == ["handle", "request"]
    assert run("search", "zebra")[1] == "No matches.\n" and run("--json", "search", "zebra")[1] == ""
    assert run("search", "handle", "--path-filter", "nowhere")[1] == "No matches after filters.\n"
    code, _, err = run("search", "- !")
    assert code == 1 and "No search terms." in err
    assert "files: 3\n" in run("status")[1]
    now = json.loads(run("--json", "status")[1])
    assert now["files"] == 3 and now["last_accessed_at"] and now["idf_rebuild_completed_at"]


def test_runs_recovery_and_events(spark, root, tmp_path):
    ix = Indexer(spark, str(root), str(tmp_path / "d"), embeddings.HashProvider(4))
    assert ix.status() == {"is_indexing": False, "progress": 0, "files": 0, "chunks": 0}
    assert ix.run() == {"indexed": 3, "removed": 0} and ix.run() == {"indexed": 0, "removed": 0}
    assert ix.store.rows("vectors").count() == ix.store.status()["chunks"] > 0 and ix.status()["progress"] == 100
    assert {r["type"] for r in ix.store.rows("chunks").collect()} == {"function", "text"}  # small neighbours are joined
    # a run that ended before its rebuild is made good by the next one
    meta = ProjectMetadata(spark, str(tmp_path / "d"))
    meta.set_rebuilt("")
    version = ix.store.version
    assert ix.run() == {"indexed": 0, "removed": 0} and meta.read()["idfRebuildCompletedAt"] and ix.store.version == version + 1
    assert not ix.recover()
    (root / "notes.txt").unlink()
    (root / "api.go").write_text("package a\n\nfunc NewContent() {\n}\n")
    assert ix.run() == {"indexed": 1, "removed": 1}
    assert ix.store.terms(["request"]).count() == 0 and ix.store.terms(["content"]).count() == 1 and ix.store.status()["files"] == 2
    assert ix.store.rows("vectors").count() == ix.store.status()["chunks"]
    events = lambda *e: spark.createDataFrame(e, "path string, op string, ts timestamp")
    at = [commands_time(i) for i in range(4)]
    version = ix.store.version
    ix.process(events(("api.go", "Change", at[0])))
    assert ix.store.version == version  # the content is what it was
    (root / "new.py").write_text("def fresh_thing():\n    pass\n")
    ix.process(events(("new.py", "Add", at[0]), ("lib.js", "Change", at[1]), ("lib.js", "Remove", at[2]), ("gone.py", "Add", at[3]), ("x.bin", "Add", at[3])))
    assert sorted(r["path"] for r in ix.store.rows("files").collect()) == ["api.go", "new.py"] and ix.store.terms(["fresh"]).count() == 1
    assert Indexer(spark, str(root), str(tmp_path / "e"), skip_unchanged=False).run()["indexed"] == 3
    assert Indexer(spark, str(root), str(tmp_path / "e"), skip_unchanged=False).run()["indexed"] == 3


def commands_time(i):
    from datetime import datetime, timedelta

    return datetime(2026, 1, 1) + timedelta(seconds=i)


def test_failing_provider_leaves_keywords(spark, root, tmp_path):
    class Down:
        def embed(self, texts):
            raise OSError("down")

    ix = Indexer(spark, str(root), str(tmp_path / "d"), Down())
    assert ix.run()["indexed"] == 3 and ix.store.rows("vectors").count() == 0


def test_watch(spark, root, tmp_path):
    ix = Indexer(spark, str(root), str(tmp_path / "d"))
    spark.dataSource.register(DirectoryEvents)

    def look():
        stream = spark.readStream.format("directory_events").option("journal", str(tmp_path / "j")).load(str(root))
        q = ix.watch(stream, str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert q.exception() is None
        return sorted(r["path"] for r in ix.store.rows("files").collect())

    assert look() == ["api.go", "lib.js", "notes.txt"]
    (root / "lib.js").unlink()
    (root / "more.py").write_text("x = 1\n")
    assert look() == ["api.go", "more.py", "notes.txt"]


def test_looks_at_a_directory(root, tmp_path):
    before = listing(str(root))
    assert set(before) == {"api.go", "lib.js", "notes.txt", "skip.bin"}
    (root / "api.go").write_text("other")
    (root / "lib.js").unlink()
    (root / "z.go").write_text("z")
    assert differences(before, listing(str(root))) == [("api.go", "Change"), ("lib.js", "Remove"), ("z.go", "Add")]
    reader = DirectoryEvents({"path": str(root), "journal": str(tmp_path / "j"), "maxEvents": "2"}).simpleStreamReader(None)
    rows, at = reader.read(reader.initialOffset())
    first = [r[:2] for r in rows]
    assert first == [("api.go", "Add"), ("notes.txt", "Add")] and at == {"look": 1}
    assert [r[:2] for r in reader.read({"look": 0})[0]] == first  # asked again, the same
    rows, at = reader.read(at)
    assert [r[:2] for r in rows] == [("skip.bin", "Add"), ("z.go", "Add")] and reader.read(at)[1] == at
    reader.commit(at)
    assert sorted(os.listdir(tmp_path / "j")) == ["events-2.json", "listing-2.json"]


def test_tools(spark, root, tmp_path):
    ix = Indexer(spark, str(root), str(tmp_path / "d"))
    ix.run()
    requests = [
        {"id": 1, "method": "initialize", "params": {}},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "codebase_search", "arguments": {"query": "handle request", "limit": "1", "include_content": True}}},
        {"id": 4, "method": "tools/call", "params": {"name": "codebase_index_status"}},
        {"id": 5, "method": "tools/call", "params": {"name": "codebase_search", "arguments": {"query": "x", "limit": "ten"}}},
        {"id": 6, "method": "nosuch"},
        {"id": 7, "method": "tools/call", "params": {"name": "codebase_search", "arguments": {"query": "!"}}},
    ]
    out = io.StringIO()
    commands.serve(ix, io.StringIO("\n".join(map(json.dumps, requests)) + "\n{broken\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    text = lambda i: got[i]["result"]["content"][0]["text"]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, None] and len(got[1]["result"]["tools"]) == 2
    assert "func HandleRequest" in text(2) and text(2).count("###") == 1
    assert text(3).startswith("is_indexing: false\nprogress: 100\nfiles: 3\nchunks: ")
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and text(6) == "No search terms." and got[7]["error"]["code"] == -32700


def test_small_parts(monkeypatch, tmp_path):
    assert [commands.flexible_int(x) for x in (None, "", "7", 7, "-1")] == [None, None, 7, 7, -1]
    for bad in ("x", 1.5, True):
        with pytest.raises(ValueError):
            commands.flexible_int(bad)
    assert commands.split_comma(" a, ,b,") == ["a", "b"] and commands.shortened("abcdef", 3) == "abc…" and commands.shortened("abc", 0) == "abc"
    monkeypatch.setenv("INDEXING_BATCH_SIZE", "x")
    assert commands.env_int("INDEXING_BATCH_SIZE") == 0 and commands.env_int("NO_SUCH_NAME") == 0
    assert commands.log_level("Warning") == 30 and commands.log_level("?") == 20
    folder = commands.data_dir("/some/root", "/h")
    assert folder.startswith("/h/projects/") and len(os.path.basename(folder)) == 16
    monkeypatch.delenv("OPENAI_BASE_URL", raising=False)
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert commands.provider() is None
    monkeypatch.setenv("OPENAI_BASE_URL", "http://127.0.0.1:9")
    began = time.time()
    assert commands.provider() is None and time.time() - began < 60
    assert len(scan.SUPPORTED) == 61
