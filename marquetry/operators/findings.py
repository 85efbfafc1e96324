"""Findings: classification, scores, filters, thresholds, order and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.runtime import running_total

CONFIDENCE = {"certain": 1.0, "high": 0.8, "medium": 0.6, "low": 0.3}
SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
RANK = {"low": 0, "medium": 1, "high": 2, "certain": 3}
CALLABLE = ("function", "async_function", "lambda", "closure", "static_method", "method", "async_method", "constructor")
DYNAMIC = r"dynamic|reflect|eval|getattr"


def lookup(values: dict, column: Column) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items()])


def confidence_of(value: Column) -> Column:
    return F.when(value >= 0.9, "certain").when(value >= 0.7, "high").when(value >= 0.45, "medium").otherwise("low")


def severity_of(value: Column) -> Column:
    return (
        F.when(value >= 0.9, "critical").when(value >= 0.7, "high").when(value >= 0.5, "medium").when(value >= 0.3, "low").otherwise("info")
    )


def classify_dead(nodes: DataFrame, *, p90: float | None = None) -> DataFrame:
    """Findings for unreachable ``nodes`` with ``has_callers``, ``test_only``, ``markers``
    (a count), ``centrality`` (nullable) and the node columns."""
    kind, seen = F.col("kind"), F.col("visibility")
    found = (
        F.when(F.col("test_only"), "test_only_code").when(kind.isin(*CALLABLE), "dead_function").when(kind == "import", "unused_import")
        .when(kind == "export", "unused_export").when(kind == "variable", "unused_variable").when(kind == "parameter", "unused_parameter")
        .otherwise("unreachable")
    )
    dynamic = F.exists("attributes", lambda a: a.rlike(DYNAMIC))
    plain = F.when(seen == "private", "certain").when(seen.isin("internal", "protected"), "high").otherwise("medium")
    central = F.lit(False) if p90 is None else F.coalesce(F.col("centrality") >= p90, F.lit(False))
    lower = F.when(seen == "private", "high").when(seen.isin("internal", "protected"), "medium").otherwise("low")
    confidence = (
        F.when(F.col("has_callers") | F.coalesce(dynamic, F.lit(False)) | (F.col("markers") > 0), "low").when(central, lower).otherwise(plain)
    )
    rated = nodes.withColumn("finding_type", found).withColumn("confidence", confidence)
    severity = (
        F.when(F.col("confidence") == "certain", F.when(F.col("loc") > 50, "high").otherwise("medium"))
        .when(F.col("confidence") == "high", "medium").when(F.col("confidence") == "medium", "low").otherwise("info")
    )
    impact = (
        F.when(F.col("test_only"), "risks_breakage").when(F.col("confidence") == "certain", "safe")
        .when(F.col("documentation").isNotNull(), "has_documentation").when(seen == "public", "risks_breakage").otherwise("safe")
    )
    reason = (
        F.when(F.col("finding_type") == "test_only_code", F.format_string("%s `%s` is reached from tests only", kind, F.col("name")))
        .when(F.col("finding_type") == "unused_import", F.format_string("import `%s` has no use", F.col("name")))
        .when(F.col("finding_type") == "unused_export", F.format_string("export `%s` has no consumer", F.col("name")))
        .when(F.col("finding_type") == "dead_function", F.format_string("%s `%s` has no caller (%s)", kind, F.col("name"), F.col("confidence")))
        .otherwise(F.format_string("%s `%s` can't be reached (%s)", kind, F.col("name"), F.col("confidence")))
    )
    return rated.withColumn("severity", severity).withColumn("removal_impact", impact).withColumn("reason", reason)


def p90_threshold(scores: DataFrame) -> float | None:
    """The element at place floor(0.9 n) of the sorted scores; counts of distinct scores
    are run over, so rows with equal scores cost one row."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    place = F.floor(F.lit(scores.count()) * 0.9)
    placed = running_total(counts, ["score"], F.col("n"), "below")
    row = placed.filter(F.col("below") + F.col("n") > place).agg(F.min("score").alias("s")).first()
    return row["s"] if row else None


def priority(findings: DataFrame) -> DataFrame:
    """``score`` and adjusted levels from base levels and the signal columns that exist."""
    has = set(findings.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in has else F.lit(False)
    conf, sev = lookup(CONFIDENCE, F.col("confidence")), lookup(SEVERITY, F.col("severity"))
    conf = F.when(flag("is_placeholder") | flag("known_fp"), conf * 0.3).otherwise(conf)
    conf = F.when(flag("in_comment"), conf * 0.1).otherwise(conf)
    sev = F.when(flag("in_test_file"), sev * 0.5).otherwise(sev)
    conf = F.when(flag("user_input_nearby"), F.least(conf * 1.3, F.lit(1.0))).otherwise(conf)
    conf = F.when(flag("dynamic_dispatch"), conf * 0.5).otherwise(conf)
    if "sibling_findings" in has:
        conf = F.when(F.col("sibling_findings") > 5, conf * 0.8).otherwise(conf)
    sev = F.when(flag("is_entry_point"), F.least(sev * 1.2, F.lit(1.0))).otherwise(sev)
    if "pagerank" in has:
        sev = F.when(F.col("pagerank") > 0.05, F.least(sev * 1.1, F.lit(1.0))).otherwise(sev)
    if {"visibility", "in_degree"} <= has:
        alone = (F.col("visibility") == "private") & (F.col("in_degree") == 0)
        conf = F.when(alone, F.least(conf * 1.2, F.lit(1.0))).otherwise(conf)
    sev = F.when(flag("is_test"), sev * 0.5).otherwise(sev)
    return findings.withColumn("score", (sev * 0.6 + conf * 0.4) * 10).withColumn("adjusted_severity", severity_of(sev)).withColumn("adjusted_confidence", confidence_of(conf))


def adjust_dead_confidence(base: Column, visibility: Column, in_degree: Column, entry: Column, pagerank: Column, loc: Column) -> Column:
    c = lookup(CONFIDENCE, base)
    c = F.when((visibility == "private") & (in_degree == 0) & ~entry, F.least(c * 1.3, F.lit(1.0))).otherwise(c)
    c = F.when(visibility == "public", c * 0.6).otherwise(c)
    c = F.when(F.coalesce(pagerank > 0.05, F.lit(False)), c * 0.5).otherwise(c)
    return confidence_of(F.when(loc > 100, F.least(c * 1.1, F.lit(1.0))).otherwise(c))


def adjust_security_confidence(base: Column, placeholder: Column, user_input: Column, comment: Column, test_file: Column) -> Column:
    c = lookup(CONFIDENCE, base)
    c = F.when(placeholder, c * 0.3).otherwise(c)
    c = F.when(user_input, F.least(c * 1.3, F.lit(1.0))).otherwise(c)
    c = F.when(comment, c * 0.1).otherwise(c)
    return confidence_of(F.when(test_file, c * 0.5).otherwise(c))


def clone_confidence(similarity: Column, lines: Column) -> Column:
    base = F.when(similarity > 0.95, 1.0).when(similarity > 0.8, 0.8).when(similarity > 0.6, 0.6).otherwise(0.4)
    size = F.when(lines > 50, 1.1).when(lines > 20, 1.0).when(lines > 10, 0.9).otherwise(0.7)
    return confidence_of(F.least(base * size, F.lit(1.0)))


def filter_findings(
    findings: DataFrame, *, min_confidence: str | None = None, min_lines: int = 0, languages: list[str] | None = None,
    drop_shell: bool = True, drop_tests: bool = False, drop_test_only: bool = True, known_languages: set[str] | None = None,
) -> DataFrame:
    """The post filters; unknown languages are an error."""
    keep = F.col("loc") >= min_lines
    if min_confidence is not None:
        keep &= lookup(RANK, F.col("confidence")) >= RANK[min_confidence]
    if languages:
        wrong = set(languages) - (known_languages or set(languages))
        if wrong:
            raise ValueError(f"unknown languages: {', '.join(sorted(wrong))}")
        keep &= F.col("language").isin(*languages)
    if drop_shell:
        keep &= ~F.col("file").rlike(r"\.(sh|bash)$")
    if drop_tests:
        keep &= ~is_test_file(F.col("file"))
    if drop_test_only:
        keep &= F.col("finding_type") != "test_only_code"
    return findings.filter(keep)


TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "testing", "e2e", "integration", "fixtures", "mocks", "__mocks__")


def is_test_file(path: Column) -> Column:
    """A test folder on the path, or a file name that says test or spec."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in TEST_DIRS])) | stem.rlike(r"(^test_)|([_.-](test|tests|spec)$)|(^conftest$)")


def suppress_lines(findings: DataFrame, flags: DataFrame) -> DataFrame:
    """Drop findings that start on a line of ``flags(file, line)``."""
    return findings.join(flags.select("file", F.col("line").alias("line_start")).distinct(), ["file", "line_start"], "left_anti")


def diff_filter(findings: DataFrame, changed: DataFrame, *, most_changed: int = 10_000) -> DataFrame:
    """Findings in ``changed(path)``: equal paths, or one a suffix of the other at a folder.

    All suffixes of both sides are made once and joined by equality.
    """
    suffix = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, 1000), "/"))
    paths = changed.select(F.col("path").alias("p")).distinct()
    long = findings.select("file").distinct().select("file", F.explode(suffix(F.col("file"))).alias("s"))
    hit = long.join(paths, F.col("s") == F.col("p")).select("file")
    back = paths.select(F.explode(suffix(F.col("p"))).alias("file"))
    return findings.join(hit.union(back).distinct(), "file", "left_semi")


def threshold_violations(counts: DataFrame, limits: dict[str, int], *, fail_on: tuple[str, ...] = ()) -> DataFrame:
    """``counts(category, actual)`` -> rows whose count exceeds the limit (strictly)."""
    found = []
    for category, limit in [*limits.items(), *((c, 0) for c in fail_on)]:
        over = counts.filter((F.col("category") == category) & (F.col("actual") > limit))
        found.append(over.select("category", F.lit(limit).cast("long").alias("threshold"), "actual", F.format_string("%s: %d is more than %d", "category", "actual", F.lit(limit)).alias("message")))
    return reduce(DataFrame.unionByName, found)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(lookup(RANK, F.col("confidence")).desc(), "file", "line_start")


def page(rows: DataFrame, order: list, *, offset: int = 0, limit: int = 100) -> tuple[DataFrame, bool]:
    """A page and whether more rows follow; only ``offset + limit + 1`` rows are sorted out."""
    more = rows.orderBy(*order).offset(offset + limit).limit(1).count() > 0
    return rows.orderBy(*order).offset(offset).limit(limit), more


def hotspots(findings: DataFrame, key: str, k: int = 10) -> DataFrame:
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def quality_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of pairs ``(a, b)`` in any order against ``truth(a, b, is_clone)``."""
    key = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    said = predicted.select(*key).distinct().withColumn("said", F.lit(1))
    joined = truth.select(*key, "is_clone").join(said, ["x", "y"], "left")
    hit = F.col("said").isNotNull()
    row = joined.agg(
        F.count(F.when(hit & F.col("is_clone"), 1)).alias("tp"), F.count(F.when(hit & ~F.col("is_clone"), 1)).alias("fp"),
        F.count(F.when(~hit & F.col("is_clone"), 1)).alias("fn"),
    )
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return row.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """``pairs(score, is_clone)`` -> precision and recall at each threshold, in one pass."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = pairs.select("is_clone", "score", F.explode(marks).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(
        F.count(F.when(hit & F.col("is_clone"), 1)).alias("tp"), F.count(F.when(hit & ~F.col("is_clone"), 1)).alias("fp"), F.count(F.when(~hit & F.col("is_clone"), 1)).alias("fn")
    )
    return out.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))


def rules_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    schema = "id string, name string, severity string, confidence string, languages array<string>, pattern string, pattern_type string, cwe string, tags array<string>, enabled boolean"
    keys = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], schema)
