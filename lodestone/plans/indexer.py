"""Index a directory: full and incremental runs, recovery, file events, progress."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import DEFAULT_SIZE
from lodestone.operators.maintain import changed
from lodestone.plans.store import IndexStore, ProjectMetadata
from lodestone.session import materialize
from lodestone.sources import scan
from lodestone.sources.embeddings import Provider, embed_chunks
from lodestone.streaming import watch

#: Paths whose files are opened by name at once.
PATHS_AT_ONCE = 1000


class Indexer:
    """Keeps the index of ``root`` in ``folder``.

    With a provider, new chunks are embedded; a batch of texts that fails is
    left out and the run goes on. Files that the scan no longer takes (too
    large, ignored) count as deleted.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, provider: Provider | None = None, max_size: int = 0, size: int = DEFAULT_SIZE, skip_unchanged: bool = True, structural: bool = True):
        self.spark, self.root, self.max_size, self.skip_unchanged = spark, root, max_size, skip_unchanged
        self.store, self.metadata = IndexStore(spark, f"{folder}/index"), ProjectMetadata(spark, folder)
        embed = None if provider is None else lambda chunks: embed_chunks(chunks, provider)
        self.options = {"size": size if size > 0 else DEFAULT_SIZE, "structural": structural, "embed": embed}
        self._group: str | None = None

    def scanned(self) -> DataFrame:
        return scan.read_files(self.spark, self.root, max_size=self.max_size, extensions=list(scan.SUPPORTED))

    # ---- runs -----------------------------------------------------------------

    def run(self) -> dict[str, int]:
        """One run over the directory; what was indexed and removed."""
        self._group = f"index-{uuid.uuid4().hex[:8]}"
        self.spark.sparkContext.setJobGroup(self._group, f"indexing {self.root}")
        try:
            self.metadata.ensure(self.root)
            self.recover()
            now = self.store.rows("files").select("path", "hash", "mtime")
            found = self.scanned()
            new = materialize(changed(found, now) if self.skip_unchanged else found, "changed")
            gone = materialize(now.select("path").join(scan.scan(self.spark, self.root, self.max_size, list(scan.SUPPORTED)).select(F.col("relative").alias("path")), "path", "left_anti"), "vanished")
            counts = {"indexed": new.count(), "removed": gone.count()}
            if any(counts.values()):
                self._write(new if counts["indexed"] else None, gone)
            return counts
        finally:
            self._group = None
            self.spark.sparkContext._jsc.sc().clearJobGroup()

    def _write(self, new: DataFrame | None, gone: DataFrame | None) -> None:
        # the flag is down while weights lag behind the postings
        self.metadata.set_rebuilt("")
        self.store.apply(new, gone, **self.options)
        self.store.rebuild()
        self.metadata.set_rebuilt()

    def recover(self) -> bool:
        """Weights anew if a run ended between writing and rebuilding."""
        data = self.metadata.read()
        if data is None or data["idfRebuildCompletedAt"] or not self.store.status()["chunks"]:
            return False
        self.store.rebuild()
        self.metadata.set_rebuilt()
        return True

    # ---- events ----------------------------------------------------------------

    def read_paths(self, paths: DataFrame) -> DataFrame:
        """Files of ``path`` (below the root) with content and hash; those that aren't there are left out."""
        parts = [self._open(block) for block in _blocks(paths.select("path").distinct())]
        parts = [p for p in parts if p is not None]
        out = parts[0] if parts else self.scanned().where(F.lit(False))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _open(self, names: list[str]) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [n for n in (f"{self.root.rstrip('/')}/{x}" for x in names) if fs.exists(path(n))]
        return scan.read_named(self.spark, self.root, there) if there else None

    def process(self, events: DataFrame) -> None:
        """Apply ``path, op, ts``: each path's last operation; a change that left the content as it was does nothing.

        Weights of the whole index are not rebuilt here: searches take
        document frequencies from the postings.
        """
        last = materialize(watch.final_state(watch.relevant(events, list(scan.SUPPORTED)), ["ts"]), "events")
        files = self.store.rows("files").select("path", "hash", "mtime")
        fresh = self.read_paths(last.where("op <> 'Remove'"))
        new = materialize(changed(fresh, files, by_time=False), "changed")
        gone = last.where("op = 'Remove'").select("path")
        if not new.isEmpty() or not gone.join(files, "path", "left_semi").isEmpty():
            self.store.apply(new, gone, **self.options)

    def watch(self, events: DataFrame, checkpoint: str):
        """A streaming writer that applies each micro-batch; batches seen again after a failure change nothing."""
        return events.writeStream.foreachBatch(lambda rows, _: self.process(rows)).option("checkpointLocation", checkpoint)

    # ---- status -----------------------------------------------------------------

    def status(self) -> dict:
        """Counts of the store; while a run goes on also its share of tasks that are done."""
        now = self.store.status()
        out = {"is_indexing": self._group is not None, "progress": 100 if now["chunks"] else 0, "files": now["files"], "chunks": now["chunks"]}
        if self._group is not None:
            tracker = self.spark.sparkContext.statusTracker()
            stages = [s for j in tracker.getJobIdsForGroup(self._group) if (info := tracker.getJobInfo(j)) for i in info.stageIds if (s := tracker.getStageInfo(i))]
            total = sum(s.numTasks for s in stages)
            out["progress"] = 100 * sum(s.numCompletedTasks for s in stages) // total if total else 0
        return out


def _blocks(paths: DataFrame) -> Iterator[list[str]]:
    block: list[str] = []
    for r in paths.toLocalIterator():
        block.append(r["path"])
        if len(block) == PATHS_AT_ONCE:
            yield block
            block = []
    if block:
        yield block
