"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the densities (hits per thousand words, with ``SMOOTH`` words added) of
words and word beginnings of four to seven letters. Of those in a bounded sample of
labelled rows, the ``MOST_FEATURES`` that tell toxic from clean best are selected by a
grouped aggregate, by a margin that falls with the best one's: few labels can't reach a
fixed one. Grades of the sample: 0 for clean; toxic ones 1, 2 or 3 by terciles
of the total density of the selected features. The model is ``P(grade <= k) =
sigmoid(theta_k - w . x)``: one weight vector for all ordered thresholds, fitted by
gradient steps on the driver, where only the sparse rows of the sample are. The result
is the expected severity, ``sum_k P(grade >= k)``, and the most likely grade.

Scoring is one pass without a shuffle; the distinct words of some texts are scored once.

Edge cases: a null text counts as empty and scores as the model scores no features;
without labels of both kinds severity is zero for all, and when no feature tells them
apart, with a warning; repeated rows get equal scores;
an empty table gives an empty result; other columns pass through, but for those
named like an output, which it replaces.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm.quality_bayes import labelled_sample
from marquetry.llm.tokenizer import text_slices
from marquetry.runtime import cut, fresh_name, read_table

#: Bounds of the fitting sample and of the features selected from it; both documented.
MOST_LABELS = 20_000
MOST_FEATURES = 600
#: Toxic documents with a feature, or a quarter of all of them if that is fewer.
LEAST_DOCUMENTS = 5
#: A feature's z must exceed the lesser of this and ``MARGIN_SHARE`` of the best z, which is
#: near sqrt(share of toxic rows * clean rows) and so has no fixed height; and its mean
#: density among toxic rows must be at least ``LEAST_RATIO`` times that among clean ones.
MARGIN = 6
MARGIN_SHARE = 0.75
LEAST_RATIO = 2
SMOOTH = 100
GRADES = 3
TOXIC_AT = 0.5
OUTPUTS = ("expected_severity", "grade", "p_toxic", "toxic", "kept")
_EDGES = ".,!?%$&*#|\"'()[]:;"


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings; the number before a colon tells them apart."""
    bare = word.strip(_EDGES).lower()
    if not bare:
        return []
    return [f"w:{bare}", *[f"{n}:{bare[:n]}" for n in range(4, 8) if len(bare) >= n]]


def densities(text: str | None) -> dict[str, float]:
    words = (text or "").split()
    hits: dict[str, int] = {}
    for word in words:
        for f in word_features(word):
            hits[f] = hits.get(f, 0) + 1
    return {f: 1000 * n / (len(words) + SMOOTH) for f, n in hits.items()}


def select_features(sample: DataFrame, most: int = MOST_FEATURES) -> list[str]:
    """Features whose mean density differs most between toxic and clean, in units of
    its standard error; toxic ones only."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (y, feature, density) of some texts at a time, so that memory stays small."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ys, fs, ds = [], [], []
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = densities(text)
                    ys += [y] * len(found)
                    fs += found.keys()
                    ds += found.values()
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(fs, pa.string()), pa.array(ds, pa.float64())], ["y", "f", "d"])

    totals = sample.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    toxic = totals["toxic"] or 0
    clean = totals["all"] - toxic
    if not toxic or not clean:
        return []
    hit = F.col("y") == 1
    stats = (
        sample.select("text", "y").mapInArrow(split, "y int, f string, d double").groupBy("f").agg(
            F.count(F.when(hit, 1)).alias("n"), F.sum(F.when(hit, F.col("d")).otherwise(0.0)).alias("t"),
            F.sum(F.when(hit, 0.0).otherwise(F.col("d"))).alias("c"), F.sum(F.col("d") * F.col("d")).alias("q"),
        ).filter(F.col("n") >= min(LEAST_DOCUMENTS, (toxic + 3) // 4))
    )
    gap = F.col("t") / toxic - F.col("c") / clean
    score = F.round(gap / F.sqrt(F.col("q") / (toxic + clean) * (1 / toxic + 1 / clean)), 6)
    effect = F.col("t") / toxic >= LEAST_RATIO * F.col("c") / clean
    best = stats.filter(effect).select("f", score.alias("z")).filter("z > 0").orderBy(F.desc("z"), "f").limit(most).collect()
    if not best:
        warnings.warn(f"no feature tells {toxic} toxic from {clean} clean rows: severity is zero for all", stacklevel=2)
        return []
    least = min(MARGIN, MARGIN_SHARE * best[0].z)
    return sorted(r.f for r in best if r.z > least)


class OrdinalModel:
    """Weights by feature and ordered thresholds."""

    def __init__(self, names: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.weights = dict(zip(names, weights.tolist(), strict=True))
        self.thresholds = thresholds.tolist()
        # Every feature of four letters and more begins with one of these, so most words are
        # settled by one look at their first letters.
        self._heads = {f.partition(":")[2][:4] for f in self.weights}

    def _word(self, word: str) -> float:
        bare = word.strip(_EDGES).lower()
        return sum(self.weights.get(f, 0.0) for f in word_features(bare)) if bare[:4] in self._heads else 0.0

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of many texts; their words are told apart first, and each is scored once."""
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
        coded = lists.values.dictionary_encode()
        each = np.fromiter(map(self._word, coded.dictionary.to_pylist()), float, len(coded.dictionary))
        ends = np.asarray(lists.offsets)
        # Not one running sum over all texts: a text's score must not hang on those before it.
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        sums = np.bincount(text, each[coded.indices.to_numpy()], len(texts))
        return 1000 * sums / (np.diff(ends) + SMOOTH)

    def severity(self, score: float) -> tuple[float, int, float]:
        """(expected severity, most likely grade, P(grade >= 1))."""
        above = [1 / (1 + np.exp(np.clip(t - score, -30, 30))) for t in self.thresholds]
        each = -np.diff([1.0, *above, 0.0])
        return float(sum(above)), int(np.argmax(each)), float(above[0])


def fit_ordinal(rows: list[tuple[dict[int, float], int]], n_features: int, grades: int = GRADES, rounds: int = 400, ridge: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by Adam on the mean log likelihood."""
    row = np.concatenate([np.full(len(x), i) for i, (x, _) in enumerate(rows)] or [np.array([])]).astype(int)
    col = np.array([k for x, _ in rows for k in x], int)
    val = np.array([v for x, _ in rows for v in x.values()], float)
    y, n = np.array([g for _, g in rows]), len(rows)
    scale = np.sqrt(np.bincount(col, val**2, n_features) / n + 1e-6)
    val = val / scale[col]
    params = np.concatenate([np.zeros(n_features), [1.0], np.zeros(grades - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, rounds + 1):
        w, first, gaps = params[:n_features], params[n_features], np.exp(params[n_features + 1 :])
        theta = first + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, w[col] * val, n)
        # P(y = g) = F(theta_g - s) - F(theta_{g-1} - s)
        hi = np.where(y < grades, sigmoid(theta[np.minimum(y, grades - 1)] - s), 1.0)
        lo = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = np.where(y < grades, hi * (1 - hi), 0) / p, np.where(y > 0, lo * (1 - lo), 0) / p
        ds = (dhi - dlo) / n
        dtheta = -np.bincount(np.minimum(y, grades - 1), dhi * (y < grades), grades) / n
        dtheta += np.bincount(np.maximum(y - 1, 0), dlo * (y > 0), grades) / n
        tail = np.cumsum(dtheta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(col, ds[row] * val, n_features) + ridge * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    gaps = np.exp(params[n_features + 1 :])
    theta = params[n_features] + np.concatenate([[0], np.cumsum(gaps)])
    return np.round(params[:n_features] / scale, 9), np.round(theta, 9)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> OrdinalModel:
    """Selects features, grades the sample and fits; None-like (all zero) without labels."""
    sample = cut(labelled_sample(docs, labels, "toxic", id_col=id_col, text_col=text_col, most=most).select("text", F.col("y").cast("int").alias("y")))
    names = select_features(sample)
    if not names:
        return OrdinalModel([], np.zeros(0), np.full(GRADES, 20.0))
    index = {f: i for i, f in enumerate(names)}

    @F.arrow_udf("string")
    def sparse(texts: pa.Array) -> pa.Array:
        rows = [
            {index[f]: d for f, d in densities(t).items() if f in index} for part in text_slices(texts) for t in part.to_pylist()
        ]
        return pa.array([" ".join(f"{k}:{v:.9g}" for k, v in sorted(r.items())) for r in rows], pa.string())

    got = sorted((r.x, r.y) for r in sample.select(sparse("text").alias("x"), "y").collect())  # `most` rows at most
    rows = [({int(k): float(v) for k, v in (p.split(":") for p in x.split())}, y) for x, y in got]
    totals = [sum(v for k, v in x.items() if names[k][0] == "w" or names[k][0] == "5") for x, _ in rows]
    some = np.array([t for t, (_, y) in zip(totals, rows, strict=True) if y]) if rows else np.zeros(1)
    cuts = np.quantile(some, [1 / 3, 2 / 3])
    graded = [(x, 0 if not y else 1 + int(np.searchsorted(cuts, t, side="right"))) for t, (x, y) in zip(totals, rows, strict=True)]
    weights, theta = fit_ordinal(graded, len(names))
    return OrdinalModel(names, weights, theta)


def severity(text: Column, model: OrdinalModel) -> Column:
    """``struct(expected, grade, p_toxic)`` of a text."""

    @F.arrow_udf("struct<expected:double,grade:int,p_toxic:double>")
    def rate(texts: pa.Array) -> pa.Array:
        rows = [model.severity(x) for part in text_slices(texts) for x in model.scores(part).tolist()]
        kinds = (pa.float64(), pa.int32(), pa.float64())
        parts = [pa.array([round(r[i], 6) for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(parts, ["expected", "grade", "p_toxic"])

    return rate(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: OrdinalModel | None = None) -> DataFrame:
    """``docs`` plus ``expected_severity``, ``grade``, ``p_toxic``, ``toxic`` and ``kept``."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    name = fresh_name(docs.columns, "__severity")
    rated = docs.withColumn(name, severity(docs[text_col], model))
    toxic = F.col(f"{name}.p_toxic") >= TOXIC_AT
    return rated.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUTS], F.col(f"{name}.expected").alias("expected_severity"),
        F.col(f"{name}.grade").alias("grade"), F.col(f"{name}.p_toxic").alias("p_toxic"), toxic.alias("toxic"), (~toxic).alias("kept"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, without toxic documents."""
    mine = {c: fresh_name(docs.columns, f"__in_{i}") for i, c in enumerate(docs.columns)}
    inner = docs.withColumnsRenamed(mine)
    judged = classify_toxicity(inner, labels, id_col=mine[id_col], text_col=mine[text_col])
    return judged.filter("kept").select(*[F.col(new).alias(old) for old, new in mine.items()])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_toxicity(docs, read_table(spark, sf_dir, "labels")).drop("text")
