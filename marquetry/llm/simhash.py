"""SimHash near-duplicates: blocked candidates, pivot distance tables, exact checks.

Two 64-bit fingerprints within ``MAX_BITS`` = 4 of each other agree on at least two of
six blocks (four changed bits spoil at most four), so the 15 pairs of blocks, 20 to 22
bits each, give complete candidates by an equi-key. Within a key, each fingerprint has
its row of a table of Hamming distances to 16 fixed pivots; by the triangle inequality
a pair whose rows differ by more than 4 in any coordinate is discarded, and survivors
are checked on the fingerprints. A key's members are linked by a search that compares
each frontier member with the unreached ones only, and gives one edge per member
reached: no key gives all its pairs, however many copies it holds. Keys with very many
distinct fingerprints are cut in cells, so that none is gathered in one task.

Equal fingerprints are collapsed first (one row a fingerprint moves on), and the
components of what is left are found on fingerprints' smallest ids.

Edge cases: a null or empty text has fingerprint zero and links like any other; a
document with a null id is returned with the component of its fingerprint (null when
no other id is reached) and never names one; repeated rows stay repeated; an empty
table gives an empty result; other columns are ignored; ids at or below -2^62 are
reserved, as they stand in for null ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm.tokenizer import slices, text_slices
from marquetry.operators.components import connected_components
from marquetry.runtime import cut, fresh_name, lookup_join, read_table

MAX_BITS = 4
SEED = 42
#: (shift, width) of the six blocks, from the low end.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The signed 64-bit SimHash of a text over word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` for each row; one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = [fingerprint(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _keys() -> F.Column:
    """The 15 block pairs of ``fp`` as longs; the table's number is in the top bits."""
    out = []
    for k, ((s1, w1), (s2, w2)) in enumerate(itertools.combinations(BLOCKS, 2)):
        a = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1))
        b = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
        out.append(F.lit(k << 40) + F.shiftleft(a, 12) + b)
    return F.array(*out)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def close(one: int, fps: np.ndarray, table: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` lie within MAX_BITS of ``one`` (all are row numbers)."""
    near = np.abs(table[others] - table[one]).max(axis=1) <= MAX_BITS
    left = others[near]
    return left[np.bitwise_count(fps[left] ^ fps[one]) <= MAX_BITS]


def _link_small(key: np.ndarray, fps: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal keys at a distance of 1 to ``most - 1`` rows, all at once."""
    left, right = [], []
    rows = np.arange(len(key))
    for step in range(1, most):
        rows = rows[rows + step < len(key)]
        rows = rows[key[rows] == key[rows + step]]
        if not len(rows):
            break
        near = rows[np.abs(table[rows] - table[rows + step]).max(axis=1) <= MAX_BITS]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= MAX_BITS]
        left.append(near)
        right.append(near + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (rows[:0], rows[:0])


def _link_large(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one key's members: (reached from, reached)."""
    table = pivot_table(fps)
    open_, left, right = np.arange(len(fps)), [], []
    while len(open_):
        root, open_ = int(open_[0]), open_[1:]
        frontier = [root]
        while frontier and len(open_):
            found = close(frontier.pop(), fps, table, open_)
            if len(found):
                left.append(np.full(len(found), root))
                right.append(found)
                frontier += found.tolist()
                open_ = np.setdiff1d(open_, found, assume_unique=True)
    empty = np.array([], np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fp, rep) of rows sorted by key; a key's rows are never parted."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [np.asarray(batch.column(i)) for i in range(3)]
        if held is not None:
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
        first = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = [x[first:] for x in now]
        if first:
            yield tuple(x[:first] for x in now)
    if held is not None and len(held[0]):
        yield tuple(held)


SMALL = 8
#: Distinct fingerprints of one key in a cell; rows of larger keys are dealt over blocks.
CELL = 16_384


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, fp, rep in _runs(batches):
        fps = fp.view(np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        pairs = []
        for b, n in zip(begins[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            one, two = _link_large(fps[b : b + n])
            pairs.append((one + b, two + b))
        rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        if len(rows):
            one, two = _link_small(key[rows], fps[rows], pivot_table(fps[rows]), SMALL)
            pairs.append((rows[one], rows[two]))
        if pairs:
            a = np.concatenate([p[0] for p in pairs])
            b = np.concatenate([p[1] for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """``(fp, rep)`` of distinct fingerprints -> ``(a, b)`` that connect all that link.

    Keys with more than ``cell`` fingerprints are counted first. Their rows are dealt over
    blocks, and each pair of blocks is a cell of its own, so every pair still meets and no
    task gathers such a key.
    """
    keyed = distinct.select(F.explode(_keys()).alias("key"), "fp", "rep")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > cell)
    large = cut(counts.select("key", F.ceil(F.col("size") / cell).cast("long").alias("blocks")))
    if large.limit(1).count():
        dealt = lookup_join(keyed, large, ["key"])
        block = F.pmod(F.xxhash64(F.lit(3), "fp"), F.coalesce("blocks", F.lit(1)))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
        spread = dealt.withColumn("block", block).withColumn("other", others)
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        keyed = spread.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(pair).alias("key"), "fp", "rep")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each document."""
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # A group of null ids only still links others, so it stands in by a key below all ids.
    nodes = groups.select("fp", F.coalesce("rep", F.lit(None).cast("long")).alias("rep"), "n")
    lost = nodes.filter("rep is null")
    if lost.limit(1).count():
        nodes = nodes.withColumn("rep", F.coalesce("rep", F.lit(-(2**62)) - F.abs(F.shiftright(F.xxhash64("fp"), 2))))
    comps = connected_components(links(nodes.select("fp", "rep")))
    joined = nodes.join(comps, nodes.rep == comps.id, "left").select(
        "fp", "rep", F.coalesce("component", "rep").alias("component"), "n"
    )
    # Stand-ins of null ids must not name a component: the smallest true id does.
    named = joined.filter(F.col("rep") > -(2**62)).groupBy("component").agg(F.min("rep").alias("component_id"))
    table = cut(
        joined.join(named, "component", "left").filter("n > 1 or component_id is distinct from rep")
        .select(F.col("fp").alias("member"), "component_id")
    )
    found = F.col("member").isNotNull()
    return prints.join(table, F.col("fp") == F.col("member"), "left").select(
        "doc_id", "fp", F.when(found, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of fingerprints.

    Rows are told apart by id and fingerprint: the smallest id stays (a null id only where
    the component has no other), then the smallest fingerprint; of rows equal in both, the
    first by text, then by the other columns.
    """
    prints = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    lost = F.col("doc_id").isNull().alias("lost")
    groups = cut(prints.groupBy("fp").agg(F.min(F.struct(lost, "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")))
    comps = connected_components(links(groups.select("fp", F.col("fp").alias("rep"))))
    linked = cut(
        groups.join(comps, F.col("fp") == F.col("id"), "left").filter("n > 1 or id is not null")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    best = linked.groupBy("component").agg(F.min(F.struct("first.lost", "first.doc_id", "fp")).alias("best"))
    judged = lookup_join(prints, linked.join(best, "component").select("fp", "best"), ["fp"]).filter("best is not null")
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("fp") == F.col("best.fp"))
    rows = cut(judged.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"), F.min(wins).alias("wins")))

    mark = fresh_name(docs.columns, "__fp")
    flag = fresh_name([*docs.columns, mark], "__repeated")
    names = {"doc_id": id_col, "fp": mark}
    on = [id_col, mark]

    @F.arrow_udf("long")
    def printed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t) for part in text_slices(texts) for t in part.to_pylist()], pa.int64())

    kept = lookup_join(
        docs.withColumn(mark, printed(docs[text_col])), rows.filter("not wins").select("doc_id", "fp").withColumnsRenamed(names),
        on, how="left_anti",
    )
    repeated = rows.filter("wins and n > 1").select("doc_id", "fp").withColumnsRenamed(names).withColumn(flag, F.lit(True))
    if repeated.limit(1).count():
        kept = lookup_join(kept, repeated, on)
        plain = [c for c, kind in docs.dtypes if c != text_col and "map<" not in kind and "variant" not in kind]
        order = F.struct(*[F.col(f"`{c}`") for c in [text_col, *plain]])
        row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(flag)
        kept = kept.filter(F.col(flag).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]).union(
            kept.filter(flag).groupBy(*on).agg(row).select(f"{flag}.*")
        )
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
