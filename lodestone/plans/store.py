"""An index on a shared folder as a log of commits.

Each commit adds segments (Parquet, one folder per table and commit) and one
manifest that lists all segments in force; what was deleted or replaced before
is listed in small tables of gone ids, which readers take away by an anti-join
on id and commit number. A commit so writes what changed and nothing else. A
manifest is created only where none of its number exists, so of two writers at
once the second fails and leaves no trace. ``compact`` writes the live rows
anew, ``vacuum`` removes segments that no manifest in force lists.

Postings lie in buckets of a hash of their term, sorted by term, and carry their
chunk's length and file, so a search reads a few buckets and nothing else until
its best chunks are known. Chunks are sorted by id, so fetching some reads a few
row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.chunking import DEFAULT_SIZE, chunk_lines
from lodestone.operators.index import idf_of, postings
from lodestone.operators.maintain import changed, vanished
from lodestone.operators.structural import structural_chunks
from lodestone.operators.vectors import check_dims
from lodestone.plans.folder import Folder
from lodestone.session import default_parallelism, materialize

#: Tables as readers see them; postings also have their bucket.
SCHEMAS = {
    "files": "file_id long, path string, content string, hash string, size long, mtime long, language string, indexed_at long",
    "chunks": "chunk_id long, file_id long, content string, type string, start_line int, end_line int, metadata string, token_count int",
    "postings": "chunk_id long, file_id long, term string, raw_freq int, tf double, dl int, tfidf double, bucket int",
    "vectors": "chunk_id long, embedding array<float>, metadata string",
    "gone_files": "file_id long",
    "gone_chunks": "chunk_id long",
    "gone_vectors": "chunk_id long",
    "idf": "term string, df long, idf double",
    "magnitudes": "chunk_id long, magnitude double",
}
#: Which ids take rows of a table away.
_GONE = {"files": ("gone_files",), "chunks": ("gone_chunks",), "postings": ("gone_chunks",), "vectors": ("gone_chunks", "gone_vectors")}
BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer committed first."""


def now_iso() -> str:
    at = datetime.now(timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class ProjectMetadata:
    """A project's small JSON file beside the index."""

    NAME = "metadata.json"

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = Folder(spark, folder)

    def read(self) -> dict | None:
        return self.folder.read_json(self.NAME)

    def write(self, data: dict) -> None:
        self.folder.replace(self.NAME, json.dumps(data, indent=2, ensure_ascii=False))

    def ensure(self, path: str, name: str = ".") -> dict:
        """Created, or touched; a broken file is written anew."""
        try:
            data = self.read()
        except ValueError:
            data = None
        at = now_iso()
        data = (data or {"path": path, "name": name, "createdAt": at, "idfRebuildCompletedAt": ""}) | {"lastAccessedAt": at}
        self.folder.make()
        self.write(data)
        return data

    def set_rebuilt(self, at: str | None = None) -> None:
        """Note (or with an empty string clear) the last rebuild; nothing where there's no file."""
        if (data := self.read()) is not None:
            self.write(data | {"idfRebuildCompletedAt": now_iso() if at is None else at})


def _first_schema(manifest: dict) -> dict:
    return manifest | {"segments": {name: [] for name in SCHEMAS}, "files": 0, "chunks": 0, "buckets": BUCKETS}


#: Changes of the layout, in the order in which a store takes them; each once.
MIGRATIONS: dict[str, Callable[[dict], dict]] = {"001_schema": _first_schema}


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder)
        self.migrate()

    # ---- manifests -----------------------------------------------------------

    @staticmethod
    def exists(spark: SparkSession, folder: str) -> bool:
        return bool(Folder(spark, folder).names("_log"))

    @property
    def version(self) -> int:
        """The number of the last commit; 0 for a new store."""
        return max((int(x.split(".")[0]) for x in self.folder.names("_log") if x.endswith(".json") and x[0].isdigit()), default=0)

    def manifest(self) -> dict:
        v = self.version
        return self.folder.read_json(f"_log/{v:020d}.json") if v else {"migrations": []}

    def migrate(self) -> list[str]:
        """Run the layout changes that this store hasn't had; their names."""
        now = self.manifest()
        todo = [x for x in sorted(MIGRATIONS) if x not in now["migrations"]]
        for name in todo:
            now = MIGRATIONS[name](now)
            now["migrations"] = [*now["migrations"], name]
        if todo:
            self._publish(self.version + 1, now)
        return todo

    def _publish(self, version: int, manifest: dict) -> None:
        text = json.dumps(manifest | {"at": now_iso(), "version": version})
        if not self.folder.write(f"_log/{version:020d}.json", text, overwrite=False):
            raise Conflict(f"version {version} is there already")

    # ---- reading ---------------------------------------------------------------

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[name])

    def _segments(self, name: str, manifest: dict) -> DataFrame:
        """All rows of a table's segments, with the number of their commit as ``seq``."""
        paths = [f"{self.folder.path}/{name}/{x}" for x in manifest["segments"][name]]
        own = self._schema(name)
        if not paths:
            return self.spark.createDataFrame([], own).withColumn("seq", F.lit(0).cast("long"))
        # the folder's name (seq=7-...) holds the number; bucket and seq come from the path
        rows = self.spark.read.option("basePath", f"{self.folder.path}/{name}").schema(own.add("seq", "string")).parquet(*paths)
        return rows.withColumn("seq", F.substring_index("seq", "-", 1).cast("long"))

    def rows(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The live rows of a table."""
        manifest = manifest or self.manifest()
        rows = self._segments(name, manifest)
        for gone in _GONE.get(name, ()):
            if manifest["segments"][gone] and manifest["segments"][name]:
                key = "file_id" if gone == "gone_files" else "chunk_id"
                g = self._segments(gone, manifest).groupBy(F.col(key).alias("g")).agg(F.max("seq").alias("upto"))
                rows = rows.join(g, (F.col(key) == F.col("g")) & (F.col("seq") < F.col("upto")), "left_anti")
        return rows.drop("seq")

    def table(self, name: str) -> DataFrame:
        """As ``rows``; chunks also have their magnitude as of the last rebuild, 0 before."""
        rows = self.rows(name)
        if name != "chunks":
            return rows
        own = self.rows("magnitudes")
        return rows.join(own, "chunk_id", "left").withColumn("magnitude", F.coalesce("magnitude", F.lit(0.0)))

    def terms(self, terms: list[str]) -> DataFrame:
        """Postings of some terms: only their buckets' files are opened, and the terms reach the scan."""
        manifest = self.manifest()
        listed = self.spark.createDataFrame([(t,) for t in terms] or [("",)], "t string")
        own = sorted({r["b"] for r in listed.select(bucket_of(F.col("t"), manifest["buckets"]).alias("b")).collect()})  # a row per term
        return self.rows("postings", manifest).where(F.col("bucket").isin(own) & F.col("term").isin(terms))

    def file(self, path: str) -> DataFrame:
        """One file's row, or none."""
        return self.rows("files").where(F.col("path") == path)

    def status(self) -> dict:
        now = self.manifest()
        return {"files": now["files"], "chunks": now["chunks"], "version": self.version}

    # ---- writing -----------------------------------------------------------------

    def _write(self, name: str, segment: str, rows: DataFrame) -> DataFrame:
        """A segment, laid out for the table's readers, and read back."""
        path, own = f"{self.folder.path}/{name}/{segment}", self._schema(name)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in own])
        if name == "postings":
            # a bucket and its hot terms go to several tasks, by chunk; range partitioning would count the postings twice
            salts = max(1, default_parallelism(self.spark) // BUCKETS)
            salted = rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)))
            salted.sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(path)
        elif name in ("chunks", "vectors"):
            rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.parquet(path)
        else:
            rows.write.parquet(path)
        return self.spark.read.schema(own).parquet(path)

    def commit(self, added: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], replaced: tuple[str, ...] = ()) -> int:
        """Write segments in the order given and publish them together.

        A table may be a function of those written before. ``replaced`` tables
        consist of the new segment alone from then on. Nothing is published if
        anything fails.
        """
        before, now = self.version, self.manifest()
        segment = f"seq={before + 1}-{uuid.uuid4().hex[:12]}"
        written: dict[str, DataFrame] = {}
        try:
            for name, rows in added.items():
                rows = rows(written) if callable(rows) else rows
                if rows is not None:
                    written[name] = self._write(name, segment, rows)
            count = lambda n: written[n].count() if n in written else 0  # noqa: E731  (of footers)
            segments = {n: [*([] if n in replaced else x), *([segment] if n in written else [])] for n, x in now["segments"].items()}
            files = (0 if "files" in replaced else now["files"]) + count("files") - count("gone_files")
            chunks = (0 if "chunks" in replaced else now["chunks"]) + count("chunks") - count("gone_chunks")
            self._publish(before + 1, now | {"segments": segments, "files": files, "chunks": chunks})
        except BaseException:
            for name in written:
                self.folder.delete(f"{name}/{segment}")
            raise
        return before + 1

    def _taken_away(self, paths: DataFrame) -> dict[str, DataFrame | Callable]:
        files = self.rows("files").join(paths.select("path").distinct(), "path", "left_semi").select("file_id")
        chunks = lambda w: self.rows("chunks").join(w["gone_files"], "file_id", "left_semi").select("chunk_id")
        return {"gone_files": files, "gone_chunks": chunks}

    def load(self, files: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> int:
        """Take in tables that have their ids already; a chunk without its file stays, but no search gives it out."""
        one = lambda t, k: t.dropDuplicates([k])
        posts = lambda w: self._posted(w["chunks"].join(w["files"].select("file_id", F.lit(True).alias("known")), "file_id", "left"))
        own = {"files": one(files, "file_id"), "chunks": one(chunks, "chunk_id"), "postings": posts}
        return self.commit(own | ({} if vectors is None else {"vectors": one(vectors, "chunk_id")}))

    def _posted(self, chunks: DataFrame) -> DataFrame:
        """Postings with their chunk's file; those of a chunk that isn't ``known`` have none."""
        home = F.when(F.col("known"), F.col("file_id")).alias("file_id")
        own = postings(chunks.withColumn("key", F.struct("chunk_id", home)), "key")
        return own.select("key.*", "term", "raw_freq", "tf", "dl", F.lit(None).cast("double").alias("tfidf"), bucket_of(F.col("term"), self.manifest()["buckets"]).alias("bucket"))

    def apply(self, upserts: DataFrame | None, removed: DataFrame | None = None, size: int = DEFAULT_SIZE, structural: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Put files in (``path, content, hash, size, mtime, language, indexed_at``) and take paths out, in one commit.

        A path that is known keeps its id; its chunks, postings and vectors are
        replaced. ``embed`` turns new chunks into ``chunk_id, embedding``.
        """
        paths = [x.select("path") for x in (upserts, removed) if x is not None]
        if not paths:
            return self.version
        plan = self._taken_away(paths[0] if len(paths) == 1 else paths[0].union(paths[1]))
        if upserts is not None:
            ids = self.rows("files").select("path", F.col("file_id").alias("old"))
            new = upserts.drop("file_id").dropDuplicates(["path"]).join(ids, "path", "left").withColumn("file_id", F.coalesce("old", F.abs(F.xxhash64("path"))))

            def chunks(w: dict[str, DataFrame]) -> DataFrame:
                files = w["files"].where(F.length("content") > 0)
                if structural:
                    cut = structural_chunks(files, size=size).join(files.select("file_id", "path"), "file_id")
                else:
                    cut = files.select("file_id", "path", F.posexplode(chunk_lines(F.col("content"), size)).alias("ordinal", "c")).select("file_id", "path", "ordinal", "c.*")
                cut = cut.withColumn("chunk_id", F.abs(F.xxhash64("path", "ordinal", "content"))).withColumn("metadata", F.lit(None).cast("string"))
                return _with_token_count(cut)

            plan |= {"files": new, "chunks": chunks, "postings": lambda w: self._posted(w["chunks"].withColumn("known", F.lit(True)))}
            if embed is not None:
                plan["vectors"] = lambda w: embed(w["chunks"]).where(F.col("embedding").isNotNull()).select("chunk_id", "embedding", F.lit("").alias("metadata"))
        return self.commit(plan)

    def put_chunks(self, chunks: DataFrame) -> int:
        """Replace all chunks of the files that the rows belong to; KeyError if a file isn't there."""
        own = chunks.select("file_id").distinct()
        lost = own.join(self.rows("files").select("file_id"), "file_id", "left_anti").first()
        if lost is not None:
            raise KeyError(f"file not found: {lost['file_id']}")
        gone = self.rows("chunks").join(own, "file_id", "left_semi").select("chunk_id")
        fresh = _with_token_count(chunks)
        return self.commit({"gone_chunks": gone, "chunks": fresh, "postings": lambda w: self._posted(w["chunks"].withColumn("known", F.lit(True)))})

    def put_vectors(self, rows: DataFrame, dims: int | None = None) -> int:
        """Vectors in place of those of the same chunks; with ``dims`` all must have that length."""
        rows = check_dims(rows, dims) if dims is not None else rows
        return self.commit({"vectors": rows.dropDuplicates(["chunk_id"]), "gone_vectors": lambda w: w["vectors"].select("chunk_id")})

    def delete_vectors(self, chunks: DataFrame) -> int:
        return self.commit({"gone_vectors": chunks.select("chunk_id").distinct()})

    def refresh(self, scanned: DataFrame, skip_unchanged: bool = True, **options) -> dict[str, int]:
        """One incremental run over a scan: what vanished goes, what changed is indexed again."""
        stored = self.rows("files").select("path", "hash", "mtime")
        # written once: what changed is counted and then indexed without another look at the scan
        new = materialize(changed(scanned, stored) if skip_unchanged else scanned, "changed")
        gone = materialize(vanished(stored, scanned), "vanished")
        counts = {"indexed": new.count(), "removed": gone.count()}
        if counts["indexed"] or counts["removed"]:
            self.apply(new if counts["indexed"] else None, gone, **options)
        return counts

    # ---- upkeep ----------------------------------------------------------------------

    def rebuild(self) -> int:
        """Document frequencies, tf-idf of every posting and magnitude of every chunk, from all live postings."""
        now = self.manifest()
        posts = self.rows("postings", now)
        n = max(1, now["chunks"])
        freqs = posts.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", idf_of(F.lit(n), F.col("df")).alias("idf"))

        def weighted(w: dict[str, DataFrame]) -> DataFrame:
            return posts.drop("tfidf").join(w["idf"].select("term", "idf"), "term").withColumn("tfidf", F.col("tf") * F.col("idf"))

        sizes = lambda w: w["postings"].groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("magnitude"))
        return self.commit({"idf": freqs, "postings": weighted, "magnitudes": sizes}, replaced=("idf", "postings", "magnitudes"))

    def compact(self) -> int:
        """Live rows alone, in one segment a table; the ids of what is gone are dropped with it."""
        now = self.manifest()
        names = ("files", "chunks", "postings", "vectors")
        return self.commit({n: self.rows(n, now) for n in names}, replaced=(*names, "gone_files", "gone_chunks", "gone_vectors"))

    def vacuum(self) -> int:
        """Remove segments that the manifest in force doesn't list, and older manifests; how many segments went.

        Queries that began on an older version fail after this.
        """
        now, removed = self.manifest(), 0
        for name in SCHEMAS:
            for segment in self.folder.names(name):
                if segment not in now["segments"][name]:
                    self.folder.delete(f"{name}/{segment}")
                    removed += 1
        for x in self.folder.names("_log"):
            if x.endswith(".json") and x[0].isdigit() and int(x.split(".")[0]) < now["version"]:
                self.folder.delete(f"_log/{x}")
        return removed


def _with_token_count(chunks: DataFrame) -> DataFrame:
    from lodestone.functions.text import tokens

    return chunks.withColumn("token_count", F.size(tokens(F.col("content"))))
