"""Quality rules with thresholds taken from mergeable quantile sketches.

Every document gets five base measures. Three ratios (symbols, repeated lines and
repeated words, in thousandths) go into one sketch for each language and source: a
histogram with buckets of one thousandth, so sketches merge by adding counts, in any
order and always to the same result, and never exceed 1,001 buckets. A document fails
when a ratio lies beyond the upper fence of its group, ``q75 + FENCE * max(q75 - q25,
SPREAD)``; groups with under ``LEAST`` documents take the fence of their language's
merged sketches. Thresholds join the documents as one small row a group.

Main path: DataFrame functions only.

Edge cases: a null text has no words and fails the base rule; null languages and
sources form groups of their own; documents without words stay out of the sketches;
repeated rows count each; an empty table gives an empty result; other columns are
ignored; words are compared in a text by a 64-bit chained hash of eight words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.runtime import cut, lookup_join, read_table

WINDOW = 8
FENCE = 6
SPREAD = 20
LEAST = 30
RATIOS = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
_BLANK = r"[\x20\x09-\x0D]+"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _tokens(text: Column) -> Column:
    """Words of a text; blanks at either end leave empty strings, which go."""
    return F.array_remove(F.split(text, _BLANK), "")


def base_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the group keys and the measures; one pass, no shuffle, no Python."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shaped = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)],
        _tokens(text).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    hashed = shaped.select(
        "doc_id", *[f"key_{i}" for i in range(len(keys))], "n_symbols",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("codes"),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("codes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("codes", i, WINDOW))
    )
    windowed = hashed.withColumn("windows", F.when(F.col("codes").isNotNull(), windows)).drop("codes")
    repeated = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    return windowed.withColumn(
        "n_repeat_words", F.when(repeated, _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long")
    ).drop("windows")


def _covered(windows: Column) -> Column:
    """Words that lie in a window which occurs twice or more.

    (hash, position) pairs are sorted, those with an equal neighbour kept, their
    positions sorted; each then covers the words up to the next one, eight at most.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def doubled(all_: Column) -> Column:
        last = F.size(all_)
        return F.transform(
            F.filter(
                F.transform(
                    all_,
                    lambda p, k: F.when(
                        ((k > 0) & (F.get(all_, k - 1)["h"] == p["h"])) | ((k + 1 < last) & (F.get(all_, k + 1)["h"] == p["h"])),
                        p["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            ),
            lambda x: x,
        )

    def cover(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda acc, x: acc + x,
        )

    # A one-element array names a value once, so that it is computed once.
    return F.transform(
        F.transform(F.array(pairs), lambda x: F.sort_array(doubled(x))), cover
    )[0]


def sketches(measures: DataFrame, n_keys: int) -> DataFrame:
    """Mergeable sketch rows ``(keys, ratio, bucket, n)``."""
    keys = [f"key_{i}" for i in range(n_keys)]
    rated = measures.filter("n_words > 0").select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("ratio"), _bucket(a, b).alias("bucket"))
                    for name, (a, b) in RATIOS.items()
                ]
            )
        ).alias("r"),
    )
    return rated.groupBy(*keys, "r.ratio", "r.bucket").agg(F.count(F.lit(1)).alias("n"))


def _bucket(part: str, whole: str) -> Column:
    return F.least(F.expr(f"(1000 * {part}) div greatest({whole}, 1)"), F.lit(1000)).cast("long")


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, total, fence by ratio)``: quantiles by running counts over the buckets."""
    group = Window.partitionBy(*keys, "ratio")
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    q = run.groupBy(*keys, "ratio").agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q25"),
        F.min(F.when(F.col("upto") * 4 >= 3 * F.col("total"), F.col("bucket"))).alias("q75"),
        F.max("total").alias("total"),
    )
    fence = F.col("q75") + FENCE * F.greatest(F.col("q75") - F.col("q25"), F.lit(SPREAD))
    return q.groupBy(*keys).agg(
        F.max("total").alias("total"), *[F.max(F.when(F.col("ratio") == r, fence)).alias(f"fence_{r}") for r in RATIOS]
    )


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    measures = cut(base_measures(docs, id_col=id_col, text_col=text_col, keys=keys))
    names = [f"key_{i}" for i in range(len(keys))]
    sketch = cut(sketches(measures, len(keys)))
    fine = fences(sketch, names)
    coarse = fences(sketch, names[:1]).select(names[0], *[F.col(f"fence_{r}").alias(f"wide_{r}") for r in RATIOS])
    table = fine.join(coarse, fine[names[0]].eqNullSafe(coarse[names[0]])).select(
        *[fine[k] for k in names],
        *[F.when(F.col("total") >= LEAST, F.col(f"fence_{r}")).otherwise(F.col(f"wide_{r}")).alias(f"fence_{r}") for r in RATIOS],
    )
    judged = lookup_join(measures, table, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for r, (a, b) in RATIOS.items():
        within = within & (_bucket(a, b) <= F.coalesce(F.col(f"fence_{r}"), F.lit(1000)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL of op5_quality_rules.
OP5_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
d AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM
      (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM d) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words,
      length(array_to_string(words, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON c.rid = w.rid),
r AS (SELECT *, least(1000, (1000 * n_symbols) // greatest(word_chars, 1)) AS b_symbols,
      least(1000, (1000 * n_dup_lines) // greatest(n_lines, 1)) AS b_lines,
      least(1000, (1000 * n_repeat_words) // greatest(n_words, 1)) AS b_repeats FROM m),
u AS (SELECT lang, source, 'symbols' AS ratio, b_symbols AS b FROM r WHERE n_words > 0
      UNION ALL SELECT lang, source, 'lines', b_lines FROM r WHERE n_words > 0
      UNION ALL SELECT lang, source, 'repeats', b_repeats FROM r WHERE n_words > 0),
q AS (SELECT lang, source, ratio, count(*) AS total, quantile_disc(b, 0.25) AS q25, quantile_disc(b, 0.75) AS q75
      FROM u GROUP BY ALL),
ql AS (SELECT lang, ratio, quantile_disc(b, 0.25) AS q25, quantile_disc(b, 0.75) AS q75 FROM u GROUP BY ALL),
f AS (SELECT q.lang, q.source, q.ratio, CASE WHEN q.total >= {LEAST}
      THEN q.q75 + {FENCE} * greatest(q.q75 - q.q25, {SPREAD})
      ELSE ql.q75 + {FENCE} * greatest(ql.q75 - ql.q25, {SPREAD}) END AS fence
      FROM q JOIN ql ON q.ratio = ql.ratio AND q.lang IS NOT DISTINCT FROM ql.lang),
p AS (SELECT lang, source, max(fence) FILTER (WHERE ratio = 'symbols') AS fs, max(fence) FILTER (WHERE ratio = 'lines') AS fl,
      max(fence) FILTER (WHERE ratio = 'repeats') AS fr FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND b_symbols <= coalesce(fs, 1000) AND b_lines <= coalesce(fl, 1000) AND b_repeats <= coalesce(fr, 1000) AS kept
FROM r LEFT JOIN p ON p.lang IS NOT DISTINCT FROM r.lang AND p.source IS NOT DISTINCT FROM r.source
"""
