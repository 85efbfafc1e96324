"""Session-level helpers: cutting lineage, checked broadcasts, private column names."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a narrow lookup table may be broadcast; counted before it is.
BROADCAST_ROWS = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables, from ``spark.checkpoint.dir``.

    Without that setting a local session, whose tasks all run on one machine, gets a
    temporary one. On a cluster it is an error: no other machine would see such a folder.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "marquetry-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files.

    Lost executors then cost a re-read, not a recomputation, and iterative plans
    stay small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(taken: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares without case)."""
    lowered = {x.lower() for x in taken}
    name = stem
    while name.lower() in lowered:
        name = "_" + name
    return name


def lookup_join(
    df: DataFrame, table: DataFrame, on: list[str], *, how: str = "left", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a wide ``df`` with a narrow table of one row per key.

    The table is written and counted first. Up to ``limit`` rows it is broadcast, so
    that ``df`` does not move; beyond, it is a plain shuffle join whose hot keys the
    adaptive planner splits (the written table has an exchange of its own).
    Null keys match null keys.
    """
    table = cut(table)
    small = table.limit(limit + 1).count() <= limit
    taken = [*df.columns, *table.columns]
    left = {k: fresh_name(taken, f"__key_{i}") for i, k in enumerate(on)}
    renamed = table.withColumnsRenamed(left)
    condition = None
    for k, name in left.items():
        same = df[k].eqNullSafe(renamed[name])
        condition = same if condition is None else condition & same
    return df.join(F.broadcast(renamed) if small else renamed, condition, how).drop(*left.values())


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` plus ``name``: the sum of ``value`` over all rows that come before in ``order``.

    Rows are dealt over ranges of the order and written; sums run inside a range, and only
    one total a range is summed in one task. Rows equal in ``order`` lie in one range.
    """
    part, own, low = (fresh_name([*df.columns, name], x) for x in ("__range", "__value", "__before"))
    dealt = cut(df.withColumn(own, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(F.sum(own).alias(own))
    starts = totals.select(part, F.coalesce(F.sum(own).over(ahead(Window.orderBy(part))), F.lit(0)).alias(low))
    inside = F.coalesce(F.sum(own).over(ahead(Window.partitionBy(part).orderBy(*order))), F.lit(0))
    return lookup_join(dealt.withColumn(name, inside), starts, [part]).withColumn(name, F.col(name) + F.col(low)).drop(part, own, low)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
