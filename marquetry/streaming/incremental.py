"""Incremental runs: change detection, batched ingestion, running counts, caches as tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_hash(sources: DataFrame, *, text_col: str = "source") -> DataFrame:
    """``sources`` plus ``content_hash`` (128 bits, so equal hashes mean equal texts)."""
    return sources.withColumn("content_hash", F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def detect_changes(cached: DataFrame, current: DataFrame, *, key: str = "file") -> DataFrame:
    """``(key, change)``: added, changed, deleted or same, by content hash.

    One full outer join on the key; a null key is a key of its own.
    """
    a = cached.select(F.col(key).alias("k0"), F.col("content_hash").alias("h0"), F.lit(True).alias("was"))
    b = current.select(F.col(key).alias("k1"), F.col("content_hash").alias("h1"), F.lit(True).alias("is"))
    joined = a.join(b, F.col("k0").eqNullSafe(F.col("k1")), "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("h0").eqNullSafe(F.col("h1")), "same").otherwise("changed")
    )
    return joined.select(F.coalesce("k1", "k0").alias(key), change.alias("change"))


def incremental(cached_rows: DataFrame, changes: DataFrame, fresh: Callable[[DataFrame], DataFrame], current: DataFrame, *, key: str = "file") -> DataFrame:
    """Rows of unchanged files from the cache, and ``fresh`` ones of added and changed files.

    All child tables are cached by file, calls included, so that nothing that crosses
    files is lost; resolution runs over the union.
    """
    open_ = changes.filter(F.col("change").isin("added", "changed")).select(key)
    same = changes.filter("change = 'same'").select(key)
    return cached_rows.join(same, key, "left_semi").unionByName(fresh(current.join(open_, key, "left_semi")))


def save_snapshot(rows: DataFrame, path: str, snapshot: str) -> None:
    """Replaces one snapshot of a table partitioned by ``snapshot_id``."""
    (
        rows.withColumn("snapshot_id", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_id").parquet(path)
    )


def load_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """One snapshot; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("snapshot_id") == snapshot).drop("snapshot_id")


def expire(cache: DataFrame, ttl_seconds: int, *, now: str | None = None) -> DataFrame:
    """Cache rows ``(..., ts)`` that are not older than the time to live."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return cache.filter(F.unix_timestamp("ts") >= F.unix_timestamp(at) - ttl_seconds)


def ingest(stream: DataFrame, extract: Callable[[DataFrame], dict[str, DataFrame]], out: str, checkpoint: str, *, available_now: bool = True):
    """Appends the tables that ``extract`` makes of each micro-batch to folders under ``out``.

    Each batch has a folder of its own that it overwrites, so a batch that is repeated after a
    failure leaves no double rows. Resolution across files runs afterwards, over all.
    """

    def batch(df: DataFrame, number: int) -> None:
        for name, rows in extract(df).items():
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_counts(stream: DataFrame, key: str, *, time_col: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by key; with a time column by tumbling window, state dropped after ``late``."""
    if time_col is None:
        return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    marked = stream.withWatermark(time_col, late)
    return marked.groupBy(F.window(time_col, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def session_counts(rows: DataFrame, key: str, time_col: str, gap: str) -> DataFrame:
    """Sessions of a key: ``(key, start, n)``, for batches and (with a watermark) streams."""
    return rows.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def diff_run(cached: DataFrame, current: DataFrame, edges: DataFrame, nodes: DataFrame, fresh: Callable[[DataFrame], DataFrame], rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a change leads to: ``(file, change)`` with callers' files as ``affected``, and the
    rows of the cache joined with new ones of added and changed files."""
    from marquetry.operators.resolve import affected_files

    changes = detect_changes(cached, current)
    touched = changes.filter("change in ('added', 'changed', 'deleted')").select("file")
    more = affected_files(nodes, edges, touched).join(touched, "file", "left_anti").select("file", F.lit("affected").alias("change"))
    return touched.join(changes, "file").unionByName(more), incremental(rows, changes, fresh, current)


class ResultCache:
    """Results by name and generation: ``get`` computes what is missing, older than
    ``max_age`` seconds, or of a former generation; ``bump`` starts a new one. Values are
    DataFrames, persisted while they are held."""

    def __init__(self, max_age: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.max_age, self.clock, self.generation, self.held = max_age, clock, 0, {}

    def bump(self) -> int:
        self.generation += 1
        return self.generation

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        now, found = self.clock(), self.held.get(name)
        if found is not None and found[0] == self.generation and now - found[1] <= self.max_age:
            return found[2]
        if found is not None:
            found[2].unpersist()
        value = make().persist()
        self.held[name] = (self.generation, now, value)
        return value
