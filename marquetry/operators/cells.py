"""All pairs of rows of one group, compared in cells of bounded size over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.runtime import cut, lookup_join, running_total

#: Rows of a block; a cell holds two blocks at most.
CELL = 8192
#: Tasks that cells are dealt over at most.
TASKS = 2000


def compare_cells(rows: DataFrame, by: str, spread: str, compare: Callable, schema: str, *, cell: int | None = None) -> DataFrame:
    """Rows of ``compare(table, first)`` over each pair of rows that are equal in ``by``.

    A group is dealt over blocks by the hash of ``spread``, and each pair of its blocks is a
    cell. ``table`` holds the rows of a cell with the column ``block``; its rows from
    ``first`` on are the second block, which each row before meets (``first`` 0: one block,
    whose rows meet each other). Rows that are null in ``by`` meet none. The work grows
    with the square of a group, in cells of bounded size.
    """
    if {"block", "cell", "other", "blocks", "start"} & set(rows.columns):
        raise ValueError("block, cell, other, blocks and start are columns of the cells")
    cell = cell or CELL
    rows = cut(rows.filter(F.col(by).isNotNull()))
    blocks = F.ceil(F.col("n") / cell).cast("long")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(by, "n", blocks.alias("blocks"))
    sizes = cut(running_total(counts, [by], F.col("blocks") * F.col("blocks"), "start"))
    work = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    block = F.pmod(F.xxhash64(F.lit(3), spread), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    # Dealt anew before they are multiplied, as few files may hold all rows.
    even = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    spread_out = lookup_join(even, sizes.drop("n"), [by], how="inner").withColumn("block", block).withColumn("other", every)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = spread_out.withColumn("cell", F.col("start") + low * F.col("blocks") + high).drop("start", "blocks", "other")

    def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = table.column("block").to_numpy()
        yield from compare(table, int(np.searchsorted(block, block[-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, now]) if held is not None else now
            ids, begin = held.column("cell").to_numpy(), 0
            for end in (np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist():
                yield from close(held.slice(begin, end - begin))
                begin = end
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from close(held)

    # A set number of tasks: the planner would join cells by their bytes, not by their work.
    least = max(rows.sparkSession.sparkContext.defaultParallelism, 4 * (work[1] or 0) / cell**2)
    tasks = int(max(min(work[0] or 1, least, TASKS), 1))
    return dealt.repartition(tasks, "cell").sortWithinPartitions("cell", "block").mapInArrow(run, schema)
