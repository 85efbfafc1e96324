"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Evidence: a logistic regression on a dozen shares of each whole text (symbols, capitals,
digits, bars, exclamation marks, distinct words, word length, and so on), fitted on a
bounded sample of labelled rows, gives each document a probability of being good.

Sites: these probabilities are summed by host and by path of a host (two small grouped
aggregates). Shares of hosts are beta distributed around the corpus's, shares of paths
around their host's; both concentrations come from the data by moments, so a sparse
host is drawn to the corpus and a sparse path to its host, and a rich one keeps its own
share. A document is left out of its own site's counts, so it never testifies twice.

Verdict: the evidence's log odds plus ``SITE_WEIGHT`` times the site's log odds over
the corpus's. A document is kept when the posterior reaches ``KEEP``.

Edge cases: a null text counts as empty (all shares zero, evidence as the model says);
null hosts and paths are values of their own; without labels of both kinds the evidence
is one half for all and everything is kept; repeated rows each count and get the same
verdict; an empty table gives an empty result; other columns pass through, but for
those named like an output, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm.tokenizer import text_slices
from marquetry.runtime import cut, fresh_name, lookup_join, read_table

#: Labelled rows that the document model is fitted on, at most (the first by a hash).
MOST_LABELS = 20_000
SITE_WEIGHT = 0.5
KEEP = 0.5
OUTPUTS = ("document_p", "site_p", "quality_p", "kept")
N_FEATURES = 12


def features(text: str | None) -> np.ndarray:
    """Shares of a whole text, each between 0 and 1 or so; zeros for an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(N_FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[192:].sum()))
    solid = max(1, len(data) - int(count[[9, 10, 11, 12, 13, 32]].sum()))
    symbols = int(count[[35, 36, 37, 38, 42, 60, 62]].sum())
    n = len(words)
    return np.array(
        [
            min(1.0, 5 * symbols / solid), min(1.0, 5 * count[124] / solid), min(1.0, 5 * count[33] / solid),
            count[65:91].sum() / letters, min(1.0, 5 * count[48:58].sum() / solid),
            len(set(words)) / n, min(1.0, n / 200) * (1 - len(set(words)) / n),
            min(2.0, solid / n / 10), min(1.0, n / 20), np.log1p(n) / 10,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1.0,
        ]
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights by damped Newton steps; deterministic."""
    w = np.zeros(x.shape[1])
    eye = np.eye(x.shape[1]) * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + eye
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, *, id_col: str, text_col: str, most: int) -> DataFrame:
    """``(id, text, y)`` of at most ``most`` labelled documents, picked by a hash of their id;
    of rows that share an id the text with the smallest hash stands for all."""
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
        .groupBy("doc_id").agg(F.max(target).alias("y"))
        .orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(most)
    )
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # At most `most` rows of two integers: safe to broadcast.
    joined = named.join(F.broadcast(picked), F.col("id") == F.col("doc_id"))
    return joined.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"), F.max("y").alias("y")).select("id", "m.text", "y")


def fit_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELS) -> np.ndarray | None:
    """Weights of the document model; None when labels of both kinds are missing."""
    sample = labelled_sample(docs, labels, "quality", id_col=id_col, text_col=text_col, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tolist() for part in text_slices(batch.column(1)) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column(2)], ["id", "x", "y"])

    rows = sample.select(F.col("id").cast("string").alias("id"), "text", F.col("y").cast("int").alias("y")).mapInArrow(
        run, "id string, x array<double>, y int"
    ).collect()  # one short row a labelled document, `most` at most
    rows.sort(key=lambda r: (r.id or "", r.x))
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    return fit_logistic(np.array([r.x for r in rows]), y)


def evidence(text: Column, weights: np.ndarray | None) -> Column:
    """The document model's log odds of a text; zero without a model."""
    if weights is None:
        return F.lit(0.0)
    w = weights.tolist()

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        rows = [float(np.clip(features(t) @ np.array(w), -12, 12)) for part in text_slices(texts) for t in part.to_pylist()]
        return pa.array(np.round(rows, 9) if rows else [], pa.float64())

    return logit(text)


def concentration(sums: DataFrame, share: Column, prior: Column) -> float:
    """Beta concentration of the sites' shares around their priors, by moments.

    The spread of shares, weighted by documents, less what sampling explains.
    """
    # sums: n (documents), and shares and priors as columns
    row = sums.select("n", share.alias("s"), prior.alias("m")).agg(
        F.sum("n").alias("docs"), F.count(F.lit(1)).alias("sites"),
        F.sum(F.col("n") * F.pow(F.col("s") - F.col("m"), F.lit(2.0))).alias("spread"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("sampled"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("base"),
    ).first()
    if not row["docs"]:
        return 1.0
    between = max(row["spread"] - row["sampled"], 0.0) / row["docs"]
    base = row["base"] / row["docs"]
    if between <= base * 1e-4:
        return 1e4  # the sites do not differ: shrink all the way
    return float(min(1e4, max(1.0, base / between - 1)))


def site_posteriors(rated: DataFrame) -> tuple[DataFrame, float]:
    """``(host, path, p)`` rows of any number -> one row a path with what its verdicts
    need (``host, path, site_n, site_sum, site_prior, site_k``), and the corpus's share."""
    paths = cut(rated.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        return paths.select("host", "path", F.col("n").alias("site_n"), F.col("s").alias("site_sum"), F.lit(0.5).alias("site_prior"), F.lit(1.0).alias("site_k")), 0.5
    mean = min(max(round(total["s"] / total["n"], 9), 1e-6), 1 - 1e-6)
    hosts = cut(hosts)
    k_host = concentration(hosts.withColumnRenamed("host_n", "n"), F.col("host_s") / F.col("n"), F.lit(mean))
    shrunk = hosts.withColumn("site_prior", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).withColumnRenamed("host", "h")
    joined = paths.join(shrunk, paths["host"].eqNullSafe(shrunk["h"]))
    k_path = concentration(joined, F.col("s") / F.col("n"), F.col("site_prior"))
    return joined.select(
        "host", "path", F.col("n").alias("site_n"), F.col("s").alias("site_sum"), "site_prior", F.lit(k_path).alias("site_k")
    ), mean


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    host: Column | None = None, path: Column | None = None, most_labels: int = MOST_LABELS,
) -> DataFrame:
    """``docs`` plus ``document_p``, ``site_p``, ``quality_p`` and ``kept``.

    Texts are read twice (for the sites, for the verdicts) and never move; only a row
    a path does. ``host`` and ``path`` default to the source and the language.
    """
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    weights = fit_documents(docs, labels, id_col=id_col, text_col=text_col, most=most_labels)
    names = {n: fresh_name(docs.columns, f"__q_{n}") for n in ("host", "path", "logit", "p", "site")}
    logit = evidence(docs[text_col], weights)
    p = 1 / (1 + F.exp(-F.col("l")))
    rated = docs.select(host.alias("host"), path.alias("path"), logit.alias("l")).select("host", "path", p.alias("p"))
    table, mean = site_posteriors(rated)
    table = table.withColumnsRenamed({"host": names["host"], "path": names["path"]})
    extra = {c: fresh_name(docs.columns, f"__q_{c}") for c in ("site_n", "site_sum", "site_prior", "site_k")}
    table = table.withColumnsRenamed(extra)
    own = docs.withColumns({names["host"]: host, names["path"]: path, names["logit"]: logit})
    joined = lookup_join(own, table, [names["host"], names["path"]])
    n, s, m, k = (F.col(extra[c]) for c in ("site_n", "site_sum", "site_prior", "site_k"))
    own_p = 1 / (1 + F.exp(-F.col(names["logit"])))
    site = F.coalesce((s - own_p + k * m) / (n - 1 + k), F.lit(mean))
    site = F.least(F.greatest(site, F.lit(1e-6)), F.lit(1 - 1e-6))
    final = F.col(names["logit"]) + SITE_WEIGHT * (F.log(site / (1 - site)) - float(np.log(mean / (1 - mean))))
    posterior = 1 / (1 + F.exp(-final))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUTPUTS], F.round(own_p, 6).alias("document_p"), F.round(site, 6).alias("site_p"),
        F.round(posterior, 6).alias("quality_p"), (F.round(posterior, 6) >= KEEP).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, without the documents that the classifier rejects."""
    mine = {c: fresh_name(docs.columns, f"__in_{i}") for i, c in enumerate(docs.columns)}
    inner = docs.withColumnsRenamed(mine)
    cols = {"id_col": mine[options.pop("id_col", "doc_id")], "text_col": mine[options.pop("text_col", "text")]}
    host = options.pop("host_col", "source")
    path = options.pop("path_col", "lang")
    judged = classify_quality(inner, labels, host=inner[mine[host]], path=inner[mine[path]], **cols, **options)
    return judged.filter("kept").select(*[F.col(new).alias(old) for old, new in mine.items()])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return classify_quality(docs, read_table(spark, sf_dir, "labels")).drop("text", "lang", "source")
