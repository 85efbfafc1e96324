"""Entry points joined to nodes: where a program starts, or what something outside calls.

Sources of entries are names and attributes (``textrules.entry_points``), files that
configuration names, names that a package re-exports, functions that attributes name, and
methods that implement a trait or interface. Each is a relation of its own; ``detect``
unites them with the reason, so that a user sees why code counts as alive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.resolve import import_targets
from marquetry.operators.textrules import entry_points


def _suffixes(path) -> F.Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def file_entries(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """``(id)`` of nodes whose file is one of ``entries(path)``, or ends with it, or is an
    ending of it, at a folder's border. Joins are by equality on the endings."""
    files = nodes.select("file").distinct()
    paths = entries.select(F.regexp_replace("path", r"^(?:\./)+", "").alias("path")).filter("path <> ''").distinct()
    longer = files.select("file", F.explode(_suffixes(F.col("file"))).alias("path")).join(paths, "path").select("file")
    shorter = paths.select(F.explode(_suffixes(F.col("path"))).alias("file")).join(files, "file").select("file")
    hit = longer.union(shorter).distinct()
    return nodes.join(hit, "file", "left_semi").select("id")


#: Attribute keys whose value is the path of a function that generated code calls.
CALLED_BY_ATTRIBUTES = ("default", "with", "serialize_with", "deserialize_with", "skip_serializing_if")


def named_by_attributes(nodes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """``(id)`` of functions that a ``key = "path::to::name"`` attribute names: one of a node,
    or with ``facts`` any attribute, those of types and fields included."""
    pattern = rf"\b(?:{'|'.join(CALLED_BY_ATTRIBUTES)})\s*=\s*\"([^\"]+)\""
    marks = nodes.select(F.explode("attributes").alias("mark"))
    if facts is not None:
        marks = marks.union(facts.filter("tag = 'attribute'").select("name"))
    names = marks.select(F.explode(F.regexp_extract_all("mark", F.lit(pattern), F.lit(1))).alias("path"))
    last = names.select(F.regexp_extract("path", r"(\w+)$", 1).alias("name")).filter("name <> ''").distinct()
    return nodes.join(last, "name", "left_semi").select("id")


def reexported(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``(id)`` of nodes that a package's ``__init__`` imports, or that ``__all__`` lists."""
    package = F.col("file").rlike(r"(^|/)__init__\.py$")
    taken = import_targets(facts).filter(package).select(F.col("module_file").alias("file"), F.col("imported").alias("name"))
    listed = facts.filter("tag = 'export'").select("file", "name")
    wanted = taken.union(listed).distinct()
    return nodes.join(wanted, ["file", "name"], "left_semi").select("id")


def implementations(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(id)`` of methods inside a block that implements a trait, and of overriding or
    special methods. ``blocks(file, trait, type, line_start, line_end)``; a null trait is
    a type's own block and makes nothing alive."""
    told = blocks.filter("trait is not null").select(F.col("file").alias("f"), F.col("line_start").alias("a"), F.col("line_end").alias("z"))
    inside = nodes.join(told, (F.col("file") == F.col("f")) & F.col("line_start").between(F.col("a"), F.col("z")), "left_semi").select("id")
    marked = nodes.filter(F.exists("attributes", lambda a: a.rlike(r"^@Override\b")) | F.col("name").rlike(r"^__\w+__$")).select("id")
    return inside.union(marked).distinct()


def detect(
    nodes: DataFrame, facts: DataFrame | None = None, *, paths: DataFrame | None = None, blocks: DataFrame | None = None,
    exact: list[str] | None = None, prefixes: list[str] | None = None, functions: list[str] | None = None,
) -> DataFrame:
    """``(id, reason)``: one row an entry, with the first reason of a fixed order."""
    found = entry_points(nodes, exact=exact, prefixes=prefixes, functions=functions).filter("is_entry").select("id", F.lit("1 rule").alias("why"))
    parts = [
        (paths, lambda: file_entries(nodes, paths), "2 configuration"), (facts, lambda: reexported(nodes, facts), "3 re-export"),
        (nodes, lambda: named_by_attributes(nodes, facts), "4 attribute"), (blocks, lambda: implementations(nodes, blocks), "5 implementation"),
    ]
    for given, make, why in parts:
        if given is not None:
            found = found.unionByName(make().select("id", F.lit(why).alias("why")))
    return found.groupBy("id").agg(F.substring(F.min("why"), 3, 40).alias("reason"))
