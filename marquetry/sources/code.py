"""Source files and the facts in them.

``scan`` lists a tree; ``extract`` turns each file into rows of facts in one pass, a file
at a time. Python goes through its own grammar; other languages through line patterns and
brace, ``end`` or indentation scopes, which see declarations, calls, imports and class
heads but no expressions (a documented loss against a full grammar). A file that does not
parse gives the facts that the line patterns find.

``FACTS`` rows: ``tag`` says what a row is, ``owner`` the qualified name around it.

- function: name, visibility in ``detail``, attributes in ``items``; class: parents in ``items``
- call, ref: the name used; import: alias in ``detail``, module in ``items[0]``
- reexport: a name handed on (or ``*``), the name it is shown by in ``detail``, module in ``items[0]``
- attribute: the text of an attribute or annotation, wherever it stands
- impl: the type in ``name``, the trait in ``detail`` (null: the type's own block)
- cfg_block, cfg_edge: ``line`` and ``line_end`` are block numbers, ``detail`` the kind
- def, use: variable ``name`` in block ``line`` at statement ``line_end``
"""

from __future__ import annotations

import ast
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.text import language_of, stable_id

PRUNED = ("node_modules", "target", "build", "dist", "vendor", "__pycache__", "venv", "env", "out")
MOST_BYTES = 1 << 20
FACTS = "file string, language string, tag string, name string, owner string, line int, line_end int, detail string, items array<string>"


#: Files that tell a virtual environment, whatever its folder is called.
ENVIRONMENTS = r"(^|/)(pyvenv\.cfg|conda-meta/history)$"


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """One line of an ignore file as ``(pattern over paths, negated)``; None for no rule.

    ``**`` is any folders, ``*`` and ``?`` stay in a name, a slash inside or before fixes
    the pattern to its folder, one at the end means folders only.
    """
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    text = text[1:] if text.startswith("\\") else text
    folders_only, fixed = text.endswith("/"), "/" in text.rstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*$|\*|\?|\[[^\]]*\])", text.strip("/")):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") and part.endswith("]") else re.escape(part))
    base = re.escape(folder) + "/" if folder else ""
    return f"^{base}{'' if fixed else '(?:.*/)?'}{out}{'/.*' if folders_only else '(?:/.*)?'}$", negated


def ignore_files_of(spark: SparkSession, root: str, most_depth: int = 8) -> list[tuple[str, str]]:
    """``(folder, text)`` of the ignore files under ``root``, outer ones first. Readers skip
    hidden files, so these are listed and read by the driver, through the same file system."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found = fs.makeQualified(top).toUri().getPath().rstrip("/"), []
    for depth in range(most_depth + 1):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * depth + "/.gitignore")) or []:
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((status.getPath().getParent().toUri().getPath()[len(base) + 1 :], text))
    return found


def _ignored(files: list[tuple[str, str]]) -> Column:
    """Whether ignore files leave a path out: the last rule that fits decides."""
    verdict = F.lit(False)
    for folder, text in files:
        for line in text.split("\n"):
            rule = ignore_pattern(line, folder)
            if rule:
                verdict = F.when(F.col("file").rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return verdict


def scan(spark: SparkSession, root: str, *, pruned: tuple[str, ...] = PRUNED, most_bytes: int = MOST_BYTES, ignore_files: bool = True) -> DataFrame:
    """``(file, language, size, source)`` of known languages under ``root``; hidden and
    pruned folders, virtual environments, what ignore files name, empty and oversized files
    are left out before any content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = root.split("://")[-1].split(":", 1)[-1].rstrip("/")
    inside = F.expr("substring(p, locate(b, p) + length(b) + 1)")
    rows = raw.filter(F.col("length").between(1, most_bytes)).withColumns({"p": tail, "b": F.lit(base)}).withColumn("file", inside)
    skip = r"(^|/)(\.[^/]*|" + "|".join(map(re.escape, pruned)) + r")(/|$)"
    homes = [
        r.home for r in rows.filter(F.col("file").rlike(ENVIRONMENTS)).select(F.regexp_replace("file", ENVIRONMENTS, "").alias("home")).distinct().toLocalIterator()
    ]
    for home in homes:  # one a virtual environment
        rows = rows.filter(~F.col("file").startswith(home + "/")) if home else rows
    if ignore_files:
        rows = rows.filter(~_ignored(ignore_files_of(spark, root)))
    named = rows.filter(~F.col("file").rlike(skip)).withColumn("language", language_of(F.col("file"))).filter("language is not null")
    return named.select("file", "language", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("source"))


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


class _Python(ast.NodeVisitor):
    """Collects the facts of one module."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.scope: list[str] = []

    def put(self, tag, name, line, end, detail=None, items=()):
        self.rows.append((tag, name, ".".join(self.scope), line, end, detail, list(items)))

    def _inside(self, name: str, body: list[ast.AST]) -> None:
        self.scope.append(name)
        for x in body:
            self.visit(x)
        self.scope.pop()

    def _function(self, node) -> None:
        marks = [ast.unparse(d) for d in node.decorator_list]
        seen = "public" if not node.name.startswith("_") or node.name.endswith("__") else "private"
        self.put("function", node.name, node.lineno, node.end_lineno, seen, marks)
        for d in node.decorator_list:
            self.visit(d)
        self._inside(node.name, node.body)
        self.scope.append(node.name)
        _Flow(self).function(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.put("class", node.name, node.lineno, node.end_lineno, "public" if node.name[0] != "_" else "private", [ast.unparse(b) for b in node.bases])
        self._inside(node.name, node.body)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.put("call", ast.unparse(node.func), node.lineno, node.end_lineno)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.put("ref", node.id, node.lineno, node.lineno)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.put("import", a.name, node.lineno, node.lineno, a.asname, [a.name])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            module = "." * node.level + (node.module or "")
            self.put("import", a.name, node.lineno, node.lineno, a.asname, [module])
            if not self.scope:  # a module hands on what it imports at its top
                self.put("reexport", a.name, node.lineno, node.lineno, a.asname, [module])

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.scope and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            for x in node.value.elts:
                if isinstance(x, ast.Constant):
                    self.put("export", str(x.value), node.lineno, node.lineno)
        self.generic_visit(node)


class _Flow:
    """Blocks, edges, definitions and uses of one function; block 0 is the entry, 1 the exit."""

    def __init__(self, facts: _Python):
        self.facts, self.blocks, self.loops, self.statements = facts, 2, [], 0

    def edge(self, a, b, kind="next"):
        if a is not None:
            self.facts.put("cfg_edge", None, a, b, kind)

    def block(self, label: str) -> int:
        self.blocks += 1
        self.facts.put("cfg_block", None, self.blocks - 1, self.blocks - 1, label)
        return self.blocks - 1

    def names(self, node, block: int) -> None:
        self.statements += 1
        for x in ast.walk(node):
            if isinstance(x, ast.Name):
                stores = [] if isinstance(x.ctx, ast.Load) else ["def"]
                kinds = stores or ["use"]
                if stores and isinstance(node, ast.AugAssign) and x is node.target:
                    kinds = ["use", "def"]
                for kind in kinds:
                    # uses of a statement come before its definitions
                    self.facts.put(kind, x.id, block, 2 * self.statements + (kind == "def"), str(x.lineno))

    def function(self, node) -> None:
        self.facts.put("cfg_block", None, 0, 0, "entry")
        self.facts.put("cfg_block", None, 1, 1, "exit")
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
            self.facts.put("def", a.arg, 0, 1, str(node.lineno))
        self.edge(self.run(node.body, 0), 1)

    def run(self, body: list[ast.stmt], at: int | None) -> int | None:
        for s in body:
            if at is None:
                at = self.block("unreachable")
            at = self.step(s, at)
        return at

    def step(self, s: ast.stmt, at: int) -> int | None:
        if isinstance(s, ast.If):
            self.names(s.test, at)
            yes, after = self.block("if_true"), None
            self.edge(at, yes, "true")
            ends = [self.run(s.body, yes)]
            if s.orelse:
                no = self.block("if_false")
                self.edge(at, no, "false")
                ends.append(self.run(s.orelse, no))
            if s.orelse and all(e is None for e in ends):
                return None
            after = self.block("after_if")
            for e in ends:
                self.edge(e, after)
            if not s.orelse:
                self.edge(at, after, "false")
            return after
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            head, body, after = self.block("loop"), self.block("loop_body"), self.block("after_loop")
            self.edge(at, head)
            self.names(s.test if isinstance(s, ast.While) else s.iter, head)
            if not isinstance(s, ast.While):
                self.names(s.target, head)
            self.edge(head, body, "true")
            self.loops.append((head, after))
            self.edge(self.run(s.body, body), head, "back")
            self.loops.pop()
            self.edge(self.run(s.orelse, head) if s.orelse else head, after, "false")
            return after
        if isinstance(s, (ast.Try, ast.TryStar)):
            body = self.block("try")
            self.edge(at, body)
            ends = [self.run([*s.body, *s.orelse], body)]
            for h in s.handlers:
                catch = self.block("catch")
                self.edge(body, catch, "exception")
                ends.append(self.run(h.body, catch))
            if all(e is None for e in ends) and not s.finalbody:
                return None
            after = self.block("finally" if s.finalbody else "after_try")
            for e in ends:
                self.edge(e, after)
            if all(e is None for e in ends):
                self.edge(body, after, "exception")
            return self.run(s.finalbody, after)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            for item in s.items:
                self.names(item, at)
            return self.run(s.body, at)
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return at
        self.names(s, at)
        if isinstance(s, (ast.Return, ast.Raise)):
            self.edge(at, 1, "return" if isinstance(s, ast.Return) else "exception")
            return None
        if isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            head, after = self.loops[-1]
            self.edge(at, after if isinstance(s, ast.Break) else head, "break" if isinstance(s, ast.Break) else "continue")
            return None
        return at


#: What opens a function, by language family; the first group is the name.
FUNCTIONS = {
    "javascript": r"(?:\bfunction\s*\*?\s*(\w+)\s*\()|(?:\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)|(?:^\s*(?:async\s+|static\s+|get\s+|set\s+)*(\w+)\s*\([^;{}()]*\)\s*\{)",
    "go": r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "rust": r"\bfn\s+(\w+)", "ruby": r"^\s*def\s+(?:self\.)?([\w?!=]+)",
    "php": r"\bfunction\s+(\w+)\s*\(", "swift": r"\bfunc\s+(\w+)", "kotlin": r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(",
    "scala": r"\bdef\s+(\w+)", "r": r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(", "bash": r"^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{", "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "c": r"^[A-Za-z_][\w\s*&:<>,~]*?\b(\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{", "java": r"^\s*(?:@\w+\s+)*(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{",
}
_SAME = {"typescript": "javascript", "cpp": "c", "csharp": "java", "dart": "java"}
_CLASS = re.compile(r"\b(?:class|interface|struct|trait|enum|protocol)\s+(\w+)(?:\s*\(([^)]*)\)|\s*<\s*(\w+)|\s*(?:extends|implements|:)\s*([\w\s,.<>]+))?(?:\s*implements\s*([\w\s,.<>]+))?")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*(?:(?:\.|::|->)\w+)*)\s*\(")
_IMPORTS = [
    re.compile(p) for p in (
        r"^\s*import\s+(?:static\s+)?(?P<m>[\w.]+?)\.(?P<n>\w+|\*)\s*;", r"^\s*import\s+(?:type\s+)?(?P<n>[\w*{}\s,$]+?)\s+from\s+['\"](?P<m>[^'\"]+)['\"]",
        r"\b(?:const|let|var)\s+(?P<n>[\w{}\s,:]+?)\s*=\s*require\(\s*['\"](?P<m>[^'\"]+)['\"]", r"^\s*use\s+(?P<m>[\w:]+)::(?P<n>\{[^}]*\}|\w+|\*)",
        r"^\s*#\s*include\s*[<\"](?P<m>[^>\"]+)[>\"](?P<n>)", r"^\s*require(?:_relative)?\s+['\"](?P<m>[^'\"]+)['\"](?P<n>)", r"^\s*(?:import\s+)?(?P<n>\w+\s+)?\"(?P<m>[\w./-]+)\"\s*$",
    )
]
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s+)?(?:!?(?P<trait>[\w:]+)(?:<.*?>)?\s+for\s+)?&?(?P<type>[\w:]+)")
_REEXPORTS = [
    re.compile(p) for p in (
        r"^\s*export\s+(?:type\s+)?\{(?P<n>[^}]*)\}\s*from\s*['\"](?P<m>[^'\"]+)['\"]", r"^\s*export\s+(?P<n>\*)(?:\s+as\s+\w+)?\s+from\s*['\"](?P<m>[^'\"]+)['\"]",
        r"^\s*pub\s+use\s+(?P<m>[\w:]+)::(?P<n>\{[^}]*\}|\w+|\*)",
    )
]
_EXPORT = re.compile(r"^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum)\s+(\w+)|^\s*(?:module\.)?exports\.(\w+)\s*=")
_NOT_CALLS = frozenset("if for while switch catch return function fn func def match sizeof typeof new class elif with and or not in is lambda do else when".split())


def scope_end(lines: list[str], at: int, language: str) -> int:
    """Number of the last line of what opens on line ``at`` (from 0)."""
    if language == "ruby":
        indent = len(lines[at]) - len(lines[at].lstrip())
        return next((i for i in range(at + 1, len(lines)) if lines[i].strip() == "end" and len(lines[i]) - len(lines[i].lstrip()) <= indent), at)
    if language == "python":
        indent, last = len(lines[at]) - len(lines[at].lstrip()), at
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= indent:
                    break
                last = i
        return last
    depth, opened = 0, False
    for i in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i])
        depth += bare.count("{") - bare.count("}")
        opened |= "{" in bare
        if opened and depth <= 0:
            return i
        if not opened and bare.rstrip().endswith(";"):
            return i
    return len(lines) - 1 if opened else at


def marks_above(lines: list[str], at: int) -> list[str]:
    """Attributes, annotations and decorators of what opens on line ``at``: all that stand
    right above it, over several lines too, comments between them left out. Those of one line
    with the head count as well."""
    out, held, i = [], "", at - 1
    while i >= 0:
        text = lines[i].strip()
        if held or text.endswith((")", "]")) and not re.match(r"(?:@[\w.]|#!?\[)", text):
            held = f"{text} {held}".strip()
            if re.match(r"(?:@[\w.]|#!?\[)", text):
                out.append(held)
                held = ""
            elif not text or text.endswith(("{", "}", ";")):
                break
        elif re.match(r"(?:@[\w.]|#!?\[)", text):
            out.append(text)
        elif not re.match(r"//|/\*|\*", text):
            break
        i -= 1
    return [*reversed(out), *re.findall(r"^\s*(@\w+(?:\([^)]*\))?)", lines[at])]


def _by_patterns(source: str, language: str) -> list[tuple]:
    family = _SAME.get(language, language)
    lines, rows, spans, owners = source.split("\n"), [], [], []  # owners: what methods belong to
    opens = re.compile(FUNCTIONS.get(family, r"\b(?:function|func|fn|def|fun)\s+(\w+)"))
    for i, line in enumerate(lines):
        if re.match(r"\s*(?:@[\w.]+|#!?\[)", line):
            rows.append(("attribute", line.strip(), "", i + 1, i + 1, None, []))
        if re.match(r"\s*(?://|#(?!\s*include)|\*|/\*)", line):
            continue
        c = _CLASS.search(line)
        if c:
            parents = [p.strip().split("<")[0].split()[-1] for g in c.groups()[1:] if g for p in re.split(r",|\bimplements\b", g) if p.strip()]
            spans.append((i, scope_end(lines, i, language), c[1], "class", "public", parents))
        f = opens.search(line)
        if f and not c:
            name = next(g for g in f.groups() if g)
            if name not in _NOT_CALLS:
                hidden = re.search(r"\bprivate\b|\bstatic\b.*\bvoid\b", line) and family in ("java", "c") or family == "rust" and "pub" not in line or family == "go" and name[0].islower()
                marks = marks_above(lines, i)
                spans.append((i, scope_end(lines, i, language), name, "function", "private" if hidden else "public", marks))
        m = _IMPL.match(line) if family == "rust" else None
        if m:
            held = m["trait"] and m["trait"].split("::")[-1]
            end = scope_end(lines, i, language)
            rows.append(("impl", m["type"].split("::")[-1], "", i + 1, end + 1, held, []))
            owners.append((i, end, m["type"].split("::")[-1]))
        if family == "javascript" and (m := _EXPORT.match(line)):
            rows.append(("export", m[1] or m[2], "", i + 1, i + 1, None, []))
        for pattern in _REEXPORTS:
            if m := pattern.match(line):
                for part in re.sub(r"[{}]", "", m["n"]).split(","):
                    name, _, shown = part.strip().partition(" as ")
                    if name:
                        rows.append(("reexport", name.strip(), "", i + 1, i + 1, shown.strip() or None, [m["m"]]))
    for a, b, name, tag, seen, items in spans:
        around = [s for s in [*spans, *owners] if s[0] < a and b <= s[1]]
        rows.append((tag, name, ".".join(s[2] for s in sorted(around, key=lambda s: s[:3])), a + 1, b + 1, seen, items))
    for i, line in enumerate(lines):
        inside = ".".join(s[2] for s in sorted((s for s in [*spans, *owners] if s[0] <= i <= s[1]), key=lambda s: s[:3]))
        heads = {s[2] for s in spans if s[0] == i}
        for m in _CALL.finditer(line):
            name = re.sub(r"::|->", ".", m[1])
            if name not in _NOT_CALLS and name not in heads:
                rows.append(("call", name, inside, i + 1, i + 1, None, []))
        for pattern in _IMPORTS:
            m = pattern.search(line)
            if m:
                for part in re.sub(r"[{}]", "", m["n"] or "").split(",") or [""]:
                    name, _, alias = part.replace(":", " as ").partition(" as ")
                    rows.append(("import", name.strip() or m["m"], "", i + 1, i + 1, alias.strip() or None, [m["m"]]))
                break
    return rows


def facts_of(source: str | None, language: str) -> list[tuple]:
    """Facts of one file, without file and language."""
    if language == "python":
        visitor = _Python()
        try:
            visitor.visit(ast.parse(source or ""))
            return visitor.rows
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return _by_patterns(source or "", language)


def extract(sources: DataFrame) -> DataFrame:
    """``(file, language, source)`` -> FACTS; one pass, a file at a time, no shuffle."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, language, source in frame.itertuples(index=False):
                rows = [(file, language, *r) for r in facts_of(source, language)]
                if rows:
                    out = pd.DataFrame(rows, columns=names)
                    yield out.astype({"line": "int32", "line_end": "int32"})

    return sources.select("file", "language", "source").mapInPandas(run, FACTS)


def code_nodes(facts: DataFrame) -> DataFrame:
    """Functions, methods and classes with ids that come from their place and name."""
    rows = facts.filter("tag in ('function', 'class')")
    full = F.concat_ws(".", F.nullif("owner", F.lit("")), "name")
    kind = F.when(F.col("tag") == "class", "class").when(F.col("owner") != "", "method").otherwise("function")
    return rows.select(
        stable_id(F.col("file"), full, F.col("line")).alias("id"), "name", full.alias("full_name"), kind.alias("kind"), "file", F.col("line").alias("line_start"),
        "line_end", "language", F.col("detail").alias("visibility"), (F.col("line_end") - F.col("line") + 1).alias("loc"), F.col("items").alias("attributes"),
        F.lower("name").rlike(r"^test").alias("is_test"), F.col("owner"),
    )


def flow_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """``blocks``, ``edges``, ``defs`` and ``uses`` as the flow operators take them."""
    func = F.concat_ws(":", "file", "owner").alias("func")
    var = facts.select(func, F.col("line").alias("block"), F.col("line_end").alias("stmt"), F.col("name").alias("var"), "tag")
    return {
        "blocks": facts.filter("tag = 'cfg_block'").select(func, F.col("line").alias("block"), F.col("detail").alias("label"), (F.col("line") == 0).alias("is_entry"), (F.col("line") == 1).alias("is_exit")),
        "edges": facts.filter("tag = 'cfg_edge'").select(func, F.col("line").alias("src"), F.col("line_end").alias("dst"), F.col("detail").alias("kind")),
        "defs": var.filter("tag = 'def'").drop("tag"), "uses": var.filter("tag = 'use'").drop("tag"),
    }


def impl_blocks(facts: DataFrame) -> DataFrame:
    """``(file, trait, type, line_start, line_end)`` of Rust ``impl`` blocks."""
    rows = facts.filter("tag = 'impl'")
    return rows.select("file", F.col("detail").alias("trait"), F.col("name").alias("type"), F.col("line").alias("line_start"), "line_end")


def project_root(paths: list[str], exists, markers: tuple[str, ...] = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", ".git")) -> str:
    """The folder that all ``paths`` share, or the first one above it that holds a marker;
    ``exists(path)`` tells what is there."""
    common = "/".join(p for p, *_ in itertools.takewhile(lambda c: len(set(c)) == 1, ([*x] for x in zip(*(p.split("/")[:-1] for p in paths), strict=False)))) if paths else ""
    at = common
    while at:
        if any(exists(f"{at}/{m}") for m in markers):
            return at
        at = at.rpartition("/")[0]
    return common
