"""Reports: JSON lines, SARIF 2.1.0, text, annotations and summaries.

Per-finding parts are column expressions written by executors. SARIF is one document,
so its results are rendered as JSON rows in parallel and streamed into the file by the
driver one row at a time; they are never held together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.operators.findings import lookup

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SECURITY = {"critical": "9.0", "high": "7.0", "medium": "4.0", "low": "2.0", "info": "0.0"}


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON text a finding."""
    return findings.select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """``findings(rule_id, severity, title, file, line_start, line_end)`` as SARIF results;
    with ``related(array<struct<file, line_start, line_end>>)`` their places, with ``fix`` a
    suggested change in words."""
    spot = lambda f, a, z: F.struct(
        F.struct(F.struct(f.alias("uri")).alias("artifactLocation"), F.struct(a.alias("startLine"), F.coalesce(z, a).alias("endLine")).alias("region")).alias("physicalLocation")
    )
    more = []
    if "related" in findings.columns:
        more.append(F.transform("related", lambda x: spot(x["file"], x["line_start"], x["line_end"])).alias("relatedLocations"))
    if "fix" in findings.columns:
        more.append(F.when(F.col("fix").isNotNull(), F.array(F.struct(F.struct(F.col("fix").alias("text")).alias("description")))).alias("fixes"))
    region = F.struct(F.col("line_start").alias("startLine"), F.coalesce("line_end", "line_start").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), lookup(LEVELS, F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(place).alias("locations"), *more, F.struct(lookup(SECURITY, F.col("severity")).alias("security-severity")).alias("properties"),
    )
    return findings.select(F.to_json(result).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule a distinct ``rule_id``; its severity is the worst found."""
    rank = {k: i for i, k in enumerate(reversed(LEVELS))}
    worst = findings.groupBy("rule_id").agg(F.max_by("severity", lookup(rank, F.col("severity"))).alias("severity"))
    return worst.select(
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"), F.struct(lookup(LEVELS, F.col("severity")).alias("level")).alias("defaultConfiguration"),
                F.struct(lookup(SECURITY, F.col("severity")).alias("security-severity")).alias("properties"),
            )
        ).alias("value")
    )


def sarif(findings: DataFrame, *, tool: str, version: str = "1.0.0", invocation: dict | None = None) -> Iterator[str]:
    """Pieces of one SARIF document, results in order of place."""
    rules = ",".join(r.value for r in sarif_rules(findings).orderBy("value").toLocalIterator())
    yield '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":'
    yield f'{json.dumps(tool)},"version":{json.dumps(version)},"rules":[{rules}]}}}},'
    if invocation is not None:
        yield f'"invocations":[{json.dumps(invocation)}],'
    yield '"results":['
    first = True
    for row in sarif_results(findings.orderBy("file", "line_start", "rule_id")).toLocalIterator():
        yield row.value if first else "," + row.value
        first = False
    yield "]}]}"


def text_line() -> Column:
    return F.format_string("[%s] %s:%d %s (%s)", F.upper("severity"), F.col("file"), F.col("line_start").cast("long"), F.col("title"), F.col("rule_id"))


def annotation() -> Column:
    """A workflow annotation command for each finding."""
    level = lookup({"critical": "error", "high": "error", "medium": "warning", "low": "notice", "info": "notice"}, F.col("severity"))
    clean = F.replace(F.replace(F.replace(F.col("title"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("::"), level, F.lit(" file="), F.col("file"), F.lit(",line="), F.col("line_start").cast("string"), F.lit("::"), clean)


def summary(findings: DataFrame) -> DataFrame:
    """``(severity, confidence, n, files)``."""
    return findings.groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


def check_report(violations: DataFrame) -> tuple[bool, list[str]]:
    """Whether a check passed and its lines; one a category, and those are fixed in number."""
    rows = violations.orderBy("category").collect()
    return not rows, [r["message"] for r in rows]
