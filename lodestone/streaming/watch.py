"""File events: classification, filters, debounce by session, and their application to an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.scan import ignored, not_skipped

OPS = {"create": "Add", "add": "Add", "write": "Change", "change": "Change", "modify": "Change", "remove": "Remove", "delete": "Remove"}


def operation(op: Column) -> Column:
    """Add, Change or Remove; null for renames, attribute changes and unknown words."""
    table = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(op)))


def relevant(events: DataFrame, extensions: list[str] | None = None, rules: list[tuple[bool, str]] | None = None) -> DataFrame:
    """Events of files the index looks at; extensions match case, ignore rules don't hold for removals."""
    out = events.withColumn("op", operation(F.col("op"))).where(F.col("path").isNotNull() & F.col("op").isNotNull()).where(not_skipped(F.col("path")))
    if extensions is not None:
        out = out.where(F.regexp_extract("path", r"(\.[^./]*)$", 1).isin(extensions))
    return out.where((F.col("op") == "Remove") | ~ignored(F.col("path"), rules)) if rules else out


def debounce(events: DataFrame, gap: str, keys: list[str], ts: str = "ts", op: str = "op", order: list[str] | None = None) -> DataFrame:
    """Streaming or batch: one row per key and session of events less than ``gap`` apart, with its last op.

    ``keys`` must be real columns; on a stream set a watermark on ``ts`` first.
    """
    last = F.struct(*[F.col(c) for c in [ts, *(order or [])]])
    return (
        events.groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.max_by(op, last).alias(op), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
        .select(*keys, F.col("w.start").alias("first_ts"), "last_ts", op, "events")
    )


def debounce_batch(events: DataFrame, gap_seconds: int, keys: list[str], ts: str = "ts", op: str = "op", order: list[str] | None = None) -> DataFrame:
    """The same as gaps and islands over a finished table: two windows on one partitioning."""
    own = Window.partitionBy(*keys).orderBy(ts, *(order or []))
    apart = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(own).cast("timestamp"))
    islands = events.withColumn("fresh", (F.coalesce(apart, F.lit(1 << 60)) >= gap_seconds * 1_000_000).cast("int")).withColumn("island", F.sum("fresh").over(own))
    last = F.struct(*[F.col(c) for c in [ts, *(order or [])]])
    return (
        islands.groupBy(*keys, "island")
        .agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max_by(op, last).alias(op), F.count("*").alias("events"))
        .drop("island")
    )


def quiet_spells(events: DataFrame, gap_seconds: float, ts: str = "ts") -> DataFrame:
    """``slot, burst``: which burst each slot of time belongs to, when one timer for all paths ends a burst after a quiet gap.

    Events within a slot of the gap's length are never apart, so slots are what
    is ordered: within a day in parallel, and the days (a row each) after that.
    """
    gap = round(gap_seconds * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = events.select(F.floor(at / gap).alias("slot"), at.alias("at")).groupBy("slot").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    slots = slots.withColumn("day", F.floor(F.col("first") / 86_400_000_000))
    own = Window.partitionBy("day").orderBy("slot")
    slots = slots.withColumn("before", F.lag("last").over(own))
    fresh = (F.col("before").isNotNull() & (F.col("first") - F.col("before") >= gap)).cast("long")
    slots = slots.withColumn("inner", F.sum(fresh).over(own))
    days = slots.groupBy("day").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("inner").alias("inner"))
    order = Window.orderBy("day")  # a row per day
    apart = F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(True)).cast("long")
    days = days.withColumn("apart", apart).withColumn("start", F.sum(F.col("apart") + F.col("inner")).over(order) - F.col("inner"))
    return slots.join(days.select("day", "start"), "day").select("slot", (F.col("start") + F.col("inner")).alias("burst"))


def debounce_all(events: DataFrame, gap_seconds: float, ts: str = "ts", op: str = "op", order: list[str] | None = None) -> DataFrame:
    """``burst, path, op, last_ts, events``: each path's last operation in each burst, a burst ending when no path had an event for the gap."""
    gap = round(gap_seconds * 1_000_000)
    last = F.struct(*[F.col(c) for c in [ts, *(order or [])]])
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / gap).alias("slot")
    # map-side combined before the bursts are joined
    own = events.groupBy(slot, "path").agg(F.max_by(op, last).alias("op"), F.max(last).alias("last"), F.count("*").alias("events"))
    return (
        own.join(quiet_spells(events, gap_seconds, ts), "slot")
        .groupBy("burst", "path")
        .agg(F.max_by("op", "last").alias("op"), F.max("last")[ts].alias("last_ts"), F.sum("events").alias("events"))
    )


def debounce_root(events: DataFrame, gap: str, root: str = "root", ts: str = "ts", op: str = "op") -> DataFrame:
    """The same on a stream: a session window per watched root (a real column), then the last operation of each path in it.

    A burst's events meet in one row; what a root's watcher can see in a burst bounds them.
    """
    burst = events.groupBy(root, F.session_window(ts, gap).alias("w")).agg(F.collect_list(F.struct("path", ts, op)).alias("es"))
    paths = F.array_distinct(F.transform("es", lambda e: e["path"]))
    last = F.transform(paths, lambda p: F.array_max(F.transform(F.filter("es", lambda e: e["path"] == p), lambda e: F.struct(e[ts].alias("last_ts"), e[op].alias("op"), p.alias("path")))))
    return burst.select(root, F.col("w.start").alias("first_ts"), F.explode(last).alias("e")).select(root, "first_ts", "e.path", "e.op", "e.last_ts")


def final_state(events: DataFrame, order: list[str]) -> DataFrame:
    """``path, op``: each path's last operation, pre-aggregated before the shuffle."""
    return events.groupBy("path").agg(F.max_by("op", F.struct(*order)).alias("op"))


def apply_stream(events: DataFrame, store, read_paths, checkpoint: str):
    """A streaming query that applies each micro-batch of ``path, op, ts`` to an IndexStore.

    ``read_paths`` turns a table of paths into file rows. Batches are
    idempotent: a batch seen again after a failure gives the same index.
    """

    def batch(rows: DataFrame, _: int) -> None:
        last = final_state(relevant(rows), ["ts"]).persist()
        try:
            store.apply(read_paths(last.where("op <> 'Remove'").select("path")), last.where("op = 'Remove'").select("path"))
        finally:
            last.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
