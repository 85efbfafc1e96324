"""Embedding near-duplicates with randomised binary codes and exact verification.

Vectors are compared inside their label, each with each. Equal vectors are collapsed
first. Each vector has its binary code under a random rotation and the code's correction
factor ``f = <code, vector>``. The angle between two vectors is at least the difference of
their angles to the code, so a pair at the threshold ``t`` or above has ``<code, other> >=
t f - sqrt(1 - t^2) sqrt(1 - f^2)``. That bound holds for every pair and decides which
pairs are recomputed in double precision; they are linked by the recomputed cosine, so
no link is false and none is lost. (``bounds`` has the unbiased estimate ``<code, other> /
f`` and its error, ``EPS`` standard deviations, which a vanishing share of pairs exceeds.)

Labels are cut in cells of at most twice ``CELL`` rows: rows of a larger label are dealt
over blocks, and each pair of blocks is one cell, so nothing is dropped and no task
gathers a label. A cell returns a count and a root for each linked vector, never its
pairs. Work grows with the square of a label's distinct vectors.

Edge cases: null labels, null, zero or empty vectors, and null or non-finite components
link with nothing and form components of their own; vectors of different length are
not compared; a null id is kept, counted as a link of others and never names a
component; repeated rows count each; an empty table gives an empty result; other
columns are ignored; ids at or below -2^62 are reserved, as they stand in for null ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.components import connected_components
from marquetry.runtime import cut, lookup_join, read_table

THRESHOLD = 0.93
EPS = 4.5
CELL = 8192
_BLOCK = 1024
_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (dim, number) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([dim, number]).normal(size=(dim, dim)))
        _ROTATIONS[dim, number] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, number]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first so that squares stay finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def binary_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated rows, codes of length one, correction factors)."""
    turned = x @ rotation(x.shape[1], 0).T
    codes = np.where(turned >= 0, 1.0, -1.0) / np.sqrt(x.shape[1])
    return turned, codes, np.maximum((codes * turned).sum(axis=1), 1e-9)


def bounds(codes: np.ndarray, factors: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of coded rows with others, and the error's bound by row."""
    dim = codes.shape[1]
    error = EPS * np.sqrt(np.maximum(1 - factors**2, 0) / (factors**2 * max(dim - 1, 1)))
    return (codes @ others.T) / factors[:, None], error


def least_product(factors: np.ndarray) -> np.ndarray:
    """The least inner product of a code with any vector that links with the coded row."""
    spread = np.sqrt(np.maximum(1 - factors**2, 0)) * np.sqrt(1 - THRESHOLD**2)
    return THRESHOLD * factors - spread - 1e-7


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell at a time, out of rows sorted by cell."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        ids = held.column("cell").to_numpy()
        marks = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        begin = 0
        for end in marks.tolist():
            yield held.slice(begin, end - begin)
            begin = end
        held = held.slice(begin)
    if held is not None and held.num_rows:
        yield held


def link_cell(x: np.ndarray, weight: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of each row and its lowest linked row number, of rows sorted by block; pairs
    of equal blocks count only in a cell of one block. The third value counts recomputed
    pairs."""
    n = len(x)
    links, root, exact = np.zeros(n, np.int64), np.arange(n), 0
    turned, codes, factors = binary_codes(x)
    least = least_product(factors)
    first = int(np.searchsorted(block, block[-1]))  # 0 in a cell of one block
    for i in range(0, first or n, _BLOCK):
        for j in range(first or i, n, _BLOCK):
            a, b = slice(i, min(i + _BLOCK, first or n)), slice(j, j + _BLOCK)
            maybe = codes[a] @ turned[b].T >= least[a][:, None]
            if i == j:
                maybe = np.triu(maybe, 1)
            p, q = np.nonzero(maybe)
            p, q = p + i, q + j
            exact += len(p)
            for at in range(0, len(p), 65_536):
                u, v = p[at : at + 65_536], q[at : at + 65_536]
                true = np.einsum("ij,ij->i", x[u], x[v]) >= THRESHOLD
                u, v = u[true], v[true]
                np.add.at(links, u, weight[v])
                np.add.at(links, v, weight[u])
                while True:  # hang both under the lower root until all agree
                    low = np.minimum(root[u], root[v])
                    if (low == root[u]).all() and (low == root[v]).all():
                        break
                    np.minimum.at(root, root[u], low)
                    np.minimum.at(root, root[v], low)
                    np.minimum.at(root, u, low)
                    np.minimum.at(root, v, low)
                    while (root[root] != root).any():
                        root = root[root]
    return links, root, exact


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "links", "root"]
    for cell in _cells(batches):
        if cell.num_rows < 2:
            continue
        node, weight = cell.column("node").to_numpy(), cell.column("n").to_numpy()
        vecs = cell.column("vec").combine_chunks()
        x = unit(np.asarray(vecs.flatten(), dtype=np.float64).reshape(cell.num_rows, -1))
        links, root, _ = link_cell(x, weight, cell.column("block").to_numpy())
        hit = np.flatnonzero(links)
        if len(hit):
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[root[hit]])], names)


def cell_links(nodes: DataFrame) -> DataFrame:
    """``(node, vec, n, label)`` of distinct vectors -> ``(node, links, root)`` by cell."""
    rows = nodes.select("node", "vec", "n", F.xxhash64("label", F.size("vec")).alias("cell0"))
    # Labels above CELL rows: at most one row in CELL is in that list.
    large = (
        rows.groupBy("cell0").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CELL)
        .select("cell0", F.ceil(F.col("size") / CELL).cast("long").alias("blocks"))
    )
    dealt = lookup_join(rows, large, ["cell0"]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn(
        "cell", F.xxhash64("cell0", F.least("block", "other"), F.greatest("block", "other"))
    ).select("cell", "node", "vec", "n", "block")
    return spread.repartition("cell").sortWithinPartitions("cell", "block").mapInArrow(_link, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = (
        F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(F.exists("vec", bad), F.lit(True))
        & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    )
    marked = rows.withColumn("h1", F.when(valid, F.xxhash64("label", "vec"))).withColumn(
        "h2", F.when(valid, F.xxhash64("vec", F.lit(5), "label"))
    )
    classes = cut(
        marked.filter(valid).groupBy("h1", "h2").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"), F.first("label").alias("label")
        ).withColumn("node", F.coalesce("rep", -F.lit(2**62) - F.abs(F.shiftright("h1", 2))))
    )
    found = cut(cell_links(classes))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    joined = (
        classes.select("h1", "h2", "node", "n").join(counts, "node", "left").join(comps, F.col("node") == F.col("id"), "left")
        .select("h1", "h2", "node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    named = joined.filter(F.col("node") > -(2**62)).groupBy("component").agg(F.min("node").alias("component_id"))
    linked = cut(
        joined.filter("n_links > 0").join(named, "component", "left")
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_links", "component_id")
    )
    ids = marked.select("vec_id", "h1", "h2")
    out = ids.join(linked, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.when(F.col("k1").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
