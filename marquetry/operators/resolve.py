"""From facts to a call graph: name resolution by ranked candidates, imports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.functions.text import lang_group

LEVELS = {0: "certain", 1: "certain", 2: "high", 3: "high", 4: "possible", 5: "possible", 6: "possible"}


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def module_files(files: DataFrame) -> DataFrame:
    """``(module, module_file)``: each name under which a file may be imported: all suffixes
    of its path without extension, dotted; package markers stand for their folder."""
    bare = F.regexp_replace(F.regexp_replace("file", r"\.[^./]+$", ""), r"/(__init__|index|mod)$", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return files.select(F.col("file").alias("module_file"), F.explode(suffixes).alias("module")).distinct()


#: Marks that a language puts before or after a module's path, taken off before it is dotted.
_SCRIPT = r"\.(?:[cm]?[jt]sx?|vue|svelte)$|^(?:@/|~/|src/)"
MODULE_MARKS = {
    "javascript": _SCRIPT, "typescript": _SCRIPT, "rust": r"^(?:crate|self|super)::(?:super::)*", "go": r"^(?:[\w-]+\.)+[a-z]+/[^/]+/[^/]+/",
    "java": r"\.\*$", "kotlin": r"\.\*$", "scala": r"\._$", "c": r"\.h(?:h|pp|xx)?$", "cpp": r"\.h(?:h|pp|xx)?$", "ruby": r"\.rb$", "php": r"\.php$|^\\+",
}


def parent_folder(path: Column, levels: Column) -> Column:
    """A path's folder, so many levels up."""
    parts = F.split(folder(path), "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "/")


def normalise_module(module: Column, language: Column | None = None, file: Column | None = None) -> Column:
    """Dots for separators; relative marks, extensions and the marks of the language off.

    With ``file``, a path that begins with ``.`` is placed in the importing file's folder:
    ``./x`` beside it, each ``../`` (or further dot of Python) one folder up.
    """
    if language is None:
        pattern = F.lit("|".join(dict.fromkeys(MODULE_MARKS.values())))
    else:
        pattern = F.coalesce(*[F.when(language == k, F.lit(p)) for k, p in MODULE_MARKS.items()], F.lit("$^"))
    bare = F.regexp_replace(module, pattern, F.lit(""))
    relative = module.rlike(r"^\.")
    tail = F.regexp_replace(bare, r"^[./]+", "")
    if file is not None:
        ups = F.when(module.rlike(r"^\.+/"), F.regexp_count(module, F.lit(r"\.\./"))).otherwise(F.length(F.regexp_extract(module, r"^(\.*)", 1)) - 1)
        tail = F.when(relative, F.concat_ws("/", F.nullif(parent_folder(file, F.greatest(ups, F.lit(0))), F.lit("")), F.nullif(tail, F.lit("")))).otherwise(tail)
    return F.regexp_replace(F.regexp_replace(tail, r"/|::|\\\\", "."), r"\.(?:__init__|index|mod)$", "")


def import_targets(facts: DataFrame) -> DataFrame:
    """``(file, local, imported, module_file)`` of imports that lead to known files."""
    rows = facts.filter("tag = 'import'").select(
        "file", F.coalesce("detail", "name").alias("local"), F.col("name").alias("imported"),
        normalise_module(F.get("items", F.lit(0)), F.col("language"), F.col("file")).alias("module"),
    )
    either = rows.withColumn("module", F.explode(F.array_distinct(F.array("module", F.concat_ws(".", "module", "imported")))))
    known = module_files(facts.select("file").distinct())
    direct = either.join(known, "module").filter("file <> module_file").select("file", "local", "imported", "module_file").distinct()
    return chase_barrels(direct, facts)


def reexports(facts: DataFrame) -> DataFrame:
    """``(barrel, name, source)``: names that a file hands on from another, or ``*``."""
    known = module_files(facts.select("file").distinct())
    rows = facts.filter("tag = 'reexport'").select(
        F.col("file").alias("barrel"), "name", F.coalesce("detail", "name").alias("shown"),
        normalise_module(F.get("items", F.lit(0)), F.col("language"), F.col("file")).alias("module"),
    )
    return rows.join(known, "module").filter("barrel <> module_file").select("barrel", "name", "shown", F.col("module_file").alias("source")).distinct()


def chase_barrels(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """Imports of a name that the imported file only hands on lead to where it comes from:
    one hop, a name of its own before ``*``; the barrel itself stays a target."""
    hand = reexports(facts)
    joined = targets.join(hand, targets.module_file == hand.barrel)
    kind = F.when(F.col("shown") == F.col("imported"), 0).when(F.col("shown") == "*", 1)
    held = joined.withColumn("kind", kind).filter("kind is not null")
    best = held.groupBy("file", "local", "imported", "module_file").agg(F.min("kind").alias("best"))
    kept = held.join(best, ["file", "local", "imported", "module_file"]).filter("kind = best")
    original = F.when(F.col("kind") == 0, F.col("name")).otherwise(F.col("imported"))
    return targets.union(kept.select("file", "local", original.alias("imported"), F.col("source").alias("module_file"))).distinct()


def import_links(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """``(name, importer, exporter)``: each import of a name and the first file that exports it."""
    first = exports.groupBy("name").agg(F.min("file").alias("exporter"))
    return imports.select("name", F.col("file").alias("importer")).distinct().join(first, "name")


def resolve_calls(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst, confidence)`` edges. Candidates of a call share its last name and its
    language group and are ranked: same file and scope, same file, imported by name, same
    folder, folders of one parent, all. The best rank present wins; ties at the last are ``possible``.

    Calls belong to the innermost function around them (the scope their fact names).
    Distinct calls are resolved once, and a name with many definitions is met by its
    distinct callers only.
    """
    calls = facts.filter("tag = 'call'").select(
        "file", lang_group(F.col("language")).alias("g"), "owner", F.regexp_extract("name", r"(\w+)$", 1).alias("callee"),
        F.regexp_extract("name", r"^(.*)\.\w+$", 1).alias("receiver"),
    ).distinct()
    owners = nodes.select(F.col("file"), F.col("full_name").alias("owner"), F.col("id").alias("src"))
    placed = calls.join(owners, ["file", "owner"])
    targets = nodes.select(
        F.col("id").alias("dst"), F.col("name").alias("callee"), lang_group(F.col("language")).alias("g"), F.col("file").alias("to"), F.col("owner").alias("scope")
    )
    imports = import_targets(facts).select("file", F.col("local").alias("i_name"), F.col("module_file").alias("to"), F.lit(True).alias("by_import")).distinct()
    pairs = placed.join(targets, ["callee", "g"]).join(
        imports, ["file", "to"], "left"
    )
    linked = F.coalesce(F.col("by_import") & ((F.col("i_name") == F.col("callee")) | (F.col("i_name") == F.regexp_extract("receiver", r"^(\w+)", 1)) | (F.col("i_name") == "*")), F.lit(False))
    own = F.regexp_extract("owner", r"^(.*)\.\w+$", 1)
    rank = (
        F.when((F.col("file") == F.col("to")) & (F.col("scope") == own) & F.col("receiver").isin("self", "this", ""), 0)
        .when(F.col("file") == F.col("to"), 1).when(linked, 2)
        .when(folder(F.col("file")) == folder(F.col("to")), 4)
        .when(folder(folder(F.col("file"))) == folder(folder(F.col("to"))), 5).otherwise(6)
    )
    ranked = pairs.groupBy("src", "callee", "receiver", "dst").agg(F.min(rank).alias("rank"))
    best = ranked.groupBy("src", "callee", "receiver").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n"))
    kept = ranked.join(best, ["src", "callee", "receiver"]).filter("rank = best")
    level = F.when((F.col("n") == 1) & (F.col("rank") > 2), 3).otherwise(F.col("rank"))
    named = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVELS.items()])
    order = F.create_map(*[F.lit(x) for kv in {"certain": 0, "high": 1, "possible": 2}.items() for x in kv])
    return kept.select("src", "dst", named.alias("confidence")).groupBy("src", "dst").agg(F.min_by("confidence", order[F.col("confidence")]).alias("confidence"))


def dispatch_edges(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``(src, dst)`` from a parent's method to the method of the same name in a child."""
    link = facts.filter("tag = 'class'").select(F.concat_ws(".", F.nullif("owner", F.lit("")), "name").alias("child"), F.explode("items").alias("parent"))
    methods = nodes.filter("kind = 'method'").select("id", "name", F.col("owner").alias("class"))
    base = methods.select(F.col("id").alias("src"), "name", F.regexp_extract("class", r"(\w+)$", 1).alias("parent"))
    over = methods.select(F.col("id").alias("dst"), "name", F.col("class").alias("child"))
    return base.join(link.withColumn("parent", F.regexp_extract("parent", r"(\w+)$", 1)), "parent").join(over, ["child", "name"]).select("src", "dst").distinct()


def symbol_table(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``exports(name, file)`` (declared, else public top-level names) and ``imports``."""
    told = facts.filter("tag = 'export'").select("name", "file")
    open_ = facts.filter("tag in ('function', 'class') and owner = '' and detail = 'public'").select("name", "file")
    silent = open_.join(told.select("file").distinct(), "file", "left_anti").select("name", "file")
    imports = facts.filter("tag = 'import'").select("name", "file", F.coalesce("detail", "name").alias("local"), "line")
    return told.union(silent).distinct(), imports


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    return exports.join(imports.select("name").distinct(), "name", "left_anti")


def unresolved_imports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    return imports.join(exports.select("name").distinct(), "name", "left_anti")


def unused_imports(facts: DataFrame) -> DataFrame:
    """Imports whose local name no reference or call in the file starts with."""
    used = facts.filter("tag in ('ref', 'call')").select("file", F.regexp_extract("name", r"^(\w+)", 1).alias("head")).distinct()
    _, imports = symbol_table(facts)
    heads = imports.withColumn("head", F.regexp_extract("local", r"^(\w+)", 1))
    return heads.join(used, ["file", "head"], "left_anti").select("file", "name", "local", "line")


def affected_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed(file)`` and the files with callers of what is in them."""
    inside = nodes.join(changed.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("dst"))
    callers = edges.join(inside, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.join(callers, "id", "left_semi").select("file").union(changed.select("file")).distinct()


def virtual_facts(facts: DataFrame) -> dict[str, DataFrame]:
    """Relations for rapid and variable type analysis: which function instantiates which
    class, and which calls have a receiver."""
    classes = facts.filter("tag = 'class'").select(F.col("name").alias("class")).distinct()
    calls = facts.filter("tag = 'call'").select("file", "owner", F.col("name").alias("callee"))
    made = calls.join(classes, F.regexp_extract("callee", r"(\w+)$", 1) == F.col("class")).select("file", "owner", "class").distinct()
    virtual = calls.filter("callee like '%.%'").select(
        "file", "owner", F.regexp_extract("callee", r"^(.*)\.\w+$", 1).alias("receiver"), F.regexp_extract("callee", r"(\w+)$", 1).alias("method")
    ).distinct()
    return {"instantiates": made, "virtual_calls": virtual}


def resolve_one(targets: DataFrame, instantiated: DataFrame, receivers: DataFrame | None = None) -> DataFrame:
    """Hierarchy targets ``(call_id, owner, target)`` cut to what types allow: owners that
    are instantiated, and with ``receivers(call_id, class)`` those a receiver may have.
    A call whose receiver has no known class keeps all instantiated owners."""
    live = targets.join(instantiated.select(F.col("class").alias("owner")).distinct(), "owner", "left_semi")
    if receivers is None:
        return live.select("call_id", "owner", "target")
    known = receivers.select("call_id", F.col("class").alias("owner"), F.lit(True).alias("fits")).distinct()
    asked = receivers.select("call_id", F.lit(True).alias("asked")).distinct()
    rated = live.join(known, ["call_id", "owner"], "left").join(asked, "call_id", "left")
    return rated.filter("fits or asked is null").select("call_id", "owner", "target")


def call_priority(calls: DataFrame) -> DataFrame:
    """``priority`` of unresolved calls: 200 where the caller is reached, 100 with a source
    module, 10 without an alias; for the order of a worklist only."""
    score = (
        F.when(F.col("reachable"), 200).otherwise(0) + F.when(F.col("source_module").isNotNull(), 100).otherwise(0)
        + F.when(F.col("imported_as").isNull(), 10).otherwise(0)
    )
    return calls.withColumn("priority", score).orderBy(F.desc("priority"), "caller_id", "callee_name")


def node_lookup(nodes: DataFrame, *, name: str | None = None, file: str | None = None, language: str | None = None) -> DataFrame:
    """Nodes by name or full name, by an ending of their file's path, by language."""
    out = nodes
    if name is not None:
        out = out.filter((F.col("name") == name) | (F.col("full_name") == name))
    if file is not None:
        out = out.filter((F.col("file") == file) | F.col("file").endswith("/" + file))
    return out if language is None else out.filter(F.col("language") == language)
