"""Mixing sources to target weights by Poisson replication.

Each document is written ``k`` times, ``k`` drawn from a Poisson distribution whose
mean is its source's target repetition rate: target weight times all characters over
the source's own. The draw inverts the distribution at a number in [0, 1) taken from
a hash of seed, id and text, so it is the same on every run, retry and partitioning.
Copies are then dealt over all partitions by a hash of their own and sorted by it
there, which shuffles the corpus globally without a single ordering task.

Rates come from one aggregate with a row a source, counted before it is broadcast.
A hot source never gathers: documents move by the hash of their copies.

Edge cases: null and empty texts count no characters and are replicated like others;
a null source is a source; a source without characters has rate one; repeated rows
draw equally, so each repeat has the same number of copies; an empty table gives an
empty result; other columns pass through, but for one named like ``copy_col``, which
is replaced; names that clash with inner ones do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.runtime import cut, fresh_name, lookup_join, read_table

SEED = 17
#: Characters wanted from each source, for one of the corpus, when no weights are given:
#: shares go down to this power, which lifts small sources and lowers large ones.
POWER = 0.7
#: Means above this are split in whole copies and a remainder, which keeps the table short.
MOST_MEAN = 8.0
TERMS = 48


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) with 52 bits from an md5 of the parts."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u: one for each term of the distribution at most u."""
    step = lambda acc, k: F.struct(
        (acc["term"] * mean / k).alias("term"), (acc["below"] + acc["term"] * mean / k).alias("below"),
        (acc["n"] + (u >= acc["below"] + acc["term"] * mean / k).cast("int")).alias("n"),
    )
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("below"), (u >= first).cast("int").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["n"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, *, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, rate)``: wanted characters over those there, one row a source."""
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    if weights is None:
        wanted = F.pow(F.col("chars").cast("double"), F.lit(POWER))
    else:
        wanted = F.lit(0.0)
        for name, weight in weights.items():
            wanted = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(wanted)
    shares = cut(sums.withColumn("wanted", wanted))  # texts are read once, not for the totals too
    totals = shares.agg(F.sum("chars").alias("all_chars"), F.sum("wanted").alias("all_wanted")).first()
    every, goal = totals["all_chars"] or 0, totals["all_wanted"] or 0.0
    if not every or not goal:
        return shares.select("source", F.lit(1.0).alias("rate"))
    # Rates are rounded so that the order of the sums above does not show.
    rate = F.round(F.col("wanted") / F.lit(goal) * F.lit(float(every)) / F.col("chars"), 9)
    return shares.select("source", F.when(F.col("chars") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", copy_col: str | None = "copy", seed: int = SEED,
) -> DataFrame:
    """``docs`` with each row as often as drawn, in a global random order.

    ``copy_col`` numbers a row's copies from 0, in place of a column of that name; None
    leaves it out.
    """
    rates = repetition_rates(docs, weights, source_col=source_col, text_col=text_col)
    taken = docs.columns
    rate, key, copy, order = (fresh_name(taken, f"__mix_{x}") for x in ("rate", "source", "copy", "order"))
    # Both are named apart, then the source is joined by a private copy of its column.
    table = rates.select(F.col("source").alias(key), F.col("rate").alias(rate))
    rated = lookup_join(docs.withColumn(key, docs[source_col]), table, [key])
    mean = F.coalesce(F.col(rate), F.lit(0.0))
    # A sum of independent draws of at most MOST_MEAN each is Poisson with the whole mean.
    parts = F.greatest(F.ceil(mean / F.lit(MOST_MEAN)).cast("int"), F.lit(1))
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    draws = F.aggregate(
        F.sequence(F.lit(1), parts), F.lit(0),
        lambda acc, i: acc + poisson(uniform(F.col(id_col), mark, i, seed=seed), mean / parts),
    )
    drawn = rated.withColumn(rate, draws)  # the name is free again: only the draw goes on
    copies = drawn.withColumn(copy, F.explode(F.slice(F.sequence(F.lit(0), F.col(rate)), F.lit(1), F.col(rate))))
    shuffled = (
        copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy)))
        .repartition(F.col(order)).sortWithinPartitions(order)
    )
    names = [F.col(f"`{c}`") for c in taken if copy_col is None or c.lower() != copy_col.lower()]
    if copy_col is not None:
        names.append(F.col(copy).cast("long").alias(copy_col))
    return shuffled.select(*names)


def check_mean(rate: float) -> float:
    """P(X > TERMS) at the largest mean of one draw; what the table leaves out."""
    term = below = math.exp(-rate)
    for k in range(1, TERMS + 1):
        term *= rate / k
        below += term
    return 1 - below


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix_sources(docs)


#: DuckDB SQL of op10_mix_sources.
OP10_SQL = f"""
WITH s AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source),
g AS (SELECT sum(chars)::DOUBLE AS every, sum(pow(chars::DOUBLE, {POWER})) AS goal FROM s),
r AS (SELECT source, round(pow(chars::DOUBLE, {POWER}) / goal * every / chars, 9) AS rate FROM s, g),
p AS (SELECT source, rate, greatest(ceil(rate / {MOST_MEAN})::INT, 1) AS parts FROM r),
m AS (SELECT source, parts, rate / parts AS mean FROM p),
t AS (SELECT source, mean, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS term
      FROM m, (SELECT unnest(range(0, {TERMS + 1})) AS k)),
c AS (SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS below FROM t),
d AS (SELECT doc_id, text, lang, d.source, n_chars, unnest(range(1, parts + 1)) AS i FROM documents d JOIN m ON d.source = m.source),
u AS (SELECT *, ('0x' || substr(md5('{SEED}' || chr(31) || doc_id || chr(31) || md5(text) || chr(31) || i), 1, 13))::BIGINT / pow(2, 52) AS u FROM d),
n AS (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars,
      sum((SELECT count(*) FROM c WHERE c.source = u.source AND u.u >= c.below)) AS n FROM u GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n::BIGINT)) AS copy FROM n
"""
