"""Change feed: filter, debounce by session windows, incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import paths

KINDS = ["created", "modified", "deleted", "moved"]
GAP = "2 seconds"
LATE = "10 seconds"


def source(spark, folder: str) -> DataFrame:
    """Stream of change events (ts, type, path, dest) from JSON files."""
    return spark.readStream.schema("ts timestamp, type string, path string, dest string").json(folder)


def relevant(changes: DataFrame) -> DataFrame:
    """Events on source files outside ignored directories; a move reports its destination if either side qualifies."""
    ok = lambda c: paths.language(c).isNotNull() & ~paths.is_ignored(c)
    moved = F.col("type") == "moved"
    target = F.when(moved & F.col("dest").isNotNull(), F.col("dest")).otherwise(F.col("path"))
    keep = F.coalesce(ok("path"), F.lit(False)) | (moved & F.coalesce(ok("dest"), F.lit(False)))
    return changes.filter(F.col("type").isin(KINDS) & keep).withColumn("path", target).drop("dest")


def debounced(changes: DataFrame, gap: str = GAP, keys: list[str] | None = None) -> DataFrame:
    """One row per burst: its first and last event and the number of them. Works on streams and batches alike; a stream
    needs a watermark (with_watermark) and append mode."""
    window = F.session_window("ts", gap)
    # Streams take session windows only beside a key; without keys there is one feed.
    rows = changes.withColumn("_feed", F.lit(1)).groupBy(window.alias("w"), "_feed", *(keys or []))
    return rows.agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w", "_feed")


def with_watermark(changes: DataFrame, late: str = LATE) -> DataFrame:
    return changes.withWatermark("ts", late)


def refresh(changes: DataFrame, rebuild, checkpoint: str):
    """Start the query that hands the distinct changed paths of each micro-batch to rebuild(paths DataFrame)."""

    def each(batch: DataFrame, _: int) -> None:
        changed = relevant(batch).select("path", "type").distinct()
        if not changed.isEmpty():
            rebuild(changed)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_files(table: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table without the rows of changed files (column path), with their fresh rows: only what changed is parsed again."""
    return table.join(changed.select("path").distinct(), "path", "left_anti").unionByName(fresh)
