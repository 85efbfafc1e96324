"""Token ids in Parquet: range-sorted files of list columns that allow selective reads.

Layout: ``doc_id`` (delta encoded, sorted in and across files), ``n_tokens`` and
``tokens`` (dictionary encoded list). Row groups and pages have set sizes and the
writer adds page indexes, so a reader of some ids skips pages, and one that needs no
tokens never touches their column. ``start`` is derived from ``n_tokens`` alone.

Edge cases: a null text counts as empty, so its document holds the end id only; rows
with equal ids stay in one file, ordered by their text (nulls first); null ids come
first; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.llm.tokenizer import codec, default_path, slices
from marquetry.runtime import ensure_checkpoint_dir, lookup_join, read_table


def write_token_files(
    docs: DataFrame, out: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Encode every whole text, append ``end_id`` and write, in ascending order of ids.

    Texts move once, to their range of ids; the encoding happens behind that shuffle,
    so token lists go straight from the encoder to the writer.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(path)
        for batch in batches:
            for part in slices(batch):
                flat, counts = words.encode_many(part.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = np.insert(flat.view("<i4"), ends[1:], end_id)
                tokens = pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts + 1), tokens], ["doc_id", "n_tokens", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, f"doc_id {kind}, n_tokens long, tokens array<int>")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .parquet(out)
    )


def document_starts(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``(file, row, doc_id, n_tokens, start)`` from the metadata columns alone, or with
    ``start`` added to ``rows(file, row, n_tokens, ...)`` of the same files.

    Sums run inside each file (narrow rows, and a file is as long as one writing task made
    it); one row a file is then summed over the files.
    """
    meta = files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens"
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (meta if rows is None else rows).withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    per_file = meta.groupBy("file").agg(
        F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"), F.bool_or(F.col("doc_id").isNull()).alias("nulls")
    )
    order = Window.orderBy(F.desc("nulls"), F.asc_nulls_first("low"), "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    started = lookup_join(placed, offsets, ["file"], how="inner").withColumn("start", F.col("before") + F.col("offset"))
    return started.drop("before", "offset")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def token_checksums(files: DataFrame) -> DataFrame:
    """``(file, row, doc_id, n_tokens, ids_crc32)`` of the stored tokens; these are counted
    again, not taken from the column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.asarray(lists.values, dtype="<u4")
            at = np.asarray(lists.offsets)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["file", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "doc_id", "tokens"
    ).mapInArrow(run, f"file string, row long, doc_id {kind}, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{ensure_checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), out, default_path())
    files = read_token_files(spark, out)
    return document_starts(files, token_checksums(files)).select("doc_id", "start", "n_tokens", "ids_crc32")
