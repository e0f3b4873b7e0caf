"""Keep the index current: change detection, upserts, replacement and cascading deletes, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds that a file's time may differ by and still count as unchanged (fixed value).
SLACK_MS = 1000


def changed(scanned: DataFrame, stored: DataFrame, by_time: bool = True) -> DataFrame:
    """Scanned files to index: new, of another hash, or (``by_time``) of a time beyond the slack."""
    old = stored.select("path", F.col("hash").alias("old_hash"), F.col("mtime").alias("old_mtime"))
    same = F.col("hash") == F.col("old_hash")
    if by_time:
        same = same & (F.abs(F.col("mtime") - F.col("old_mtime")) <= SLACK_MS)
    return scanned.join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*scanned.columns)


def vanished(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    return stored.select("path").join(scanned.select("path"), "path", "left_anti")


def upsert_files(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored files with the new ones in place; a known path keeps its id, others get a hash of the path."""
    ids = stored.select("path", F.col("file_id").alias("old_id"))
    rows = new.drop("file_id").join(ids, "path", "left").withColumn("file_id", F.coalesce("old_id", F.abs(F.xxhash64("path")))).select(*stored.columns)
    return stored.join(new.select("path"), "path", "left_anti").select(*stored.columns).unionByName(rows)


def replace_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the new rows' keys replaced (chunks by file, postings by chunk)."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def delete_files(paths: DataFrame, files: DataFrame, chunks: DataFrame, posts: DataFrame | None = None, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files of the paths with their chunks, postings and vectors taken out; unknown paths change nothing."""
    gone_files = files.join(paths.select("path").distinct(), "path", "left_semi").select("file_id").distinct()
    gone_chunks = chunks.join(gone_files, "file_id", "left_semi").select("chunk_id").distinct()
    out = {"files": files.join(gone_files, "file_id", "left_anti"), "chunks": chunks.join(gone_files, "file_id", "left_anti")}
    if posts is not None:
        out["postings"] = posts.join(gone_chunks, "chunk_id", "left_anti")
    if vectors is not None:
        out["vectors"] = vectors.join(gone_chunks, "chunk_id", "left_anti")
    return out
