"""Code clones: fingerprints, signatures over code tokens, subtrees, blocks, trees, meaning.

Candidates always come from equality joins (bands, hashes, quantised features), and what
survives is verified exactly. Functions are rows ``(id, file, name, language, line_start,
line_end, source)``.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.text import KEYWORDS, code_tokens, hamming, normalise_token
from marquetry.operators.cells import compare_cells
from marquetry.operators.similarity import cross_language_pairs, hash_groups, interval_overlaps, lsh_pairs, minhash
from marquetry.runtime import cut
from marquetry.sources.code import scope_end as _scope_end


def normal_tokens(source: Column) -> Column:
    """Code tokens with names, numbers and strings made alike."""
    return F.transform(code_tokens(source), normalise_token)


def function_signatures(functions: DataFrame, *, n: int = 128, k: int = 3) -> DataFrame:
    """``(doc_id, sig)`` MinHash signatures over normalised token shingles."""
    text = functions.select(F.col("id").alias("doc_id"), F.array_join(F.transform(normal_tokens(F.col("source")), lambda t: F.hex(t)), " ").alias("text"))
    return minhash(text, n=n, k=k)


def code_simhash(functions: DataFrame) -> DataFrame:
    """``(id, simhash, line_count)``: keywords weigh 3, placeholders 1, other tokens 2."""
    from xxhash import xxh64_intdigest

    words = frozenset(KEYWORDS)

    @F.arrow_udf("long")
    def sketch(tokens: pa.Array) -> pa.Array:
        out = []
        for row in tokens.to_pylist():
            if not row:
                out.append(0)
                continue
            kinds, counts = np.unique(np.array(row, object).astype(str), return_counts=True)
            weight = np.array([3 if t in words else 1 if t[0] == "$" and len(t) > 1 else 2 for t in kinds]) * counts
            hashes = np.array([xxh64_intdigest(t) for t in kinds], np.uint64)
            bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            total = ((2 * bits.astype(np.int64) - 1) * weight[:, None]).sum(axis=0)
            value = sum(1 << i for i in range(64) if total[i] > 0)
            out.append(value - (1 << 64) if value >> 63 else value)
        return pa.array(out, pa.int64())

    rows = functions.select("id", normal_tokens(F.col("source")).alias("t"), F.size(F.split("source", "\n")).alias("line_count"))
    return rows.select("id", sketch("t").alias("simhash"), "line_count")


#: Bits up to which pigeonhole blocks are ten bits long at least, so that they select.
PIGEONHOLE_BITS = 5


def hamming_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """Pairs ``(a, b, distance)`` of ``(id, simhash)`` at most ``bits`` apart, exactly.

    Equal prints are collapsed before and come back as pairs with their smallest id. Up to
    5 bits, of ``bits + 1`` blocks one is equal (pigeonhole). Above, such blocks are too
    short to select much (at 15 bits the blocks alone make every pair): each pair of blocks
    of rows is a cell whose distances are counted eight bytes at a time. That work grows
    with the square of the distinct prints, in cells of bounded size.
    """
    groups = prints.groupBy("simhash").agg(F.min("id").alias("rep"))
    same = prints.join(groups, "simhash").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    far = _hamming_cells(groups, bits) if bits > PIGEONHOLE_BITS else _hamming_blocks(groups, bits)
    return far.unionByName(same)


def _hamming_blocks(groups: DataFrame, bits: int) -> DataFrame:
    edges = np.linspace(0, 64, bits + 2).astype(int)
    keys = [
        F.xxhash64(F.lit(i), F.shiftrightunsigned("simhash", int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1 if b - a < 64 else -1)))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    keyed = groups.select("rep", "simhash", F.explode(F.array(*keys)).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    apart = hamming(F.col("x.simhash"), F.col("y.simhash"))
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (apart <= bits)).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), apart.alias("distance")
    ).distinct()


def _hamming_cells(groups: DataFrame, bits: int) -> DataFrame:
    def close(rows: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        rep, prints = rows.column("rep").to_numpy(), rows.column("simhash").to_numpy().view(np.uint64)
        found = []
        for i in range(first or len(prints)):
            begin = first or i + 1
            apart = np.bitwise_count(prints[begin:] ^ prints[i])
            hit = np.flatnonzero(apart <= bits)
            found.append((np.full(len(hit), i), hit + begin, apart[hit]))
        one, two, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.minimum(rep[one], rep[two]), np.maximum(rep[one], rep[two])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32))], ["a", "b", "distance"])

    rows = groups.filter("rep is not null and simhash is not null").select(F.lit(0).alias("all"), "rep", "simhash")
    return compare_cells(rows, "all", "rep", close, "a long, b long, distance int")


def file_clones(files: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """Near-equal files: candidates by their fingerprints' distance, exactly, then the
    similarity that their signatures estimate."""
    most = int(np.ceil(64 * (1 - max(0.0, threshold - 0.1))))
    signatures = cut(function_signatures(files).filter("sig is not null"))
    pairs = hamming_pairs(code_simhash(files).select("id", "simhash"), most)
    a, b = signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("s")), signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("t"))
    same = F.aggregate(F.zip_with("s", "t", lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v) / F.size("s")
    return pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("similarity")).filter(F.col("similarity") >= threshold)


#: Line kinds that all languages share, in order of precedence.
IR = {
    "define": r"^\s*(?:pub\s+|export\s+|public\s+|private\s+|protected\s+|static\s+|async\s+)*(?:def|fn|func|function|fun)\b", "class": r"\b(?:class|struct|interface|trait)\s+\w",
    "elif": r"\b(?:elif|else\s+if)\b", "if": r"\bif\b", "else": r"\belse\b", "for": r"\bfor\b", "while": r"\b(?:while|loop)\b", "switch": r"\b(?:switch|match)\b", "case": r"^\s*(?:case\b|default:)",
    "try": r"\btry\b", "catch": r"\b(?:catch|except|rescue)\b", "finally": r"\bfinally\b", "throw": r"\b(?:throw|raise|panic!?)\b", "return": r"\breturn\b", "break": r"\bbreak\b",
    "continue": r"\bcontinue\b", "import": r"^\s*(?:import|use|require|#include)\b", "compare": r"[=!<>]=|\s[<>]\s", "assign": r"[^=!<>]=[^=>]", "call": r"\w\s*\(", "index": r"\w\[",
}


def ir_tokens(source: Column) -> Column:
    """One token for each kind that a line shows, lines in order."""
    return F.flatten(
        F.transform(F.split(source, "\n"), lambda line: F.filter(F.array(*[F.when(line.rlike(p), F.lit(k)) for k, p in IR.items()]), lambda x: x.isNotNull()))
    )


def cross_language_clones(functions: DataFrame, *, threshold: float = 0.8, least: int = 8) -> DataFrame:
    """Pairs of functions in different languages with alike line kinds (4-shingles)."""
    rows = functions.select("id", ir_tokens(F.col("source")).alias("t")).filter(F.size("t") >= least)
    signatures = minhash(rows.select(F.col("id").alias("doc_id"), F.array_join("t", " ").alias("text")), k=4)
    return cross_language_pairs(lsh_pairs(signatures, threshold=threshold), functions.select(F.col("id").alias("doc_id"), "language"))


def subtrees(sources: DataFrame, *, least_lines: int = 3, least_children: int = 2) -> DataFrame:
    """Python subtrees ``(id, file, line_start, line_end, exact, shape)``: hashes with and
    without names and constants, made bottom up."""

    def walk(node: ast.AST) -> tuple[bytes, bytes, list]:
        exact, shape, found, children = hashlib.md5(), hashlib.md5(), [], 0
        for h in (exact, shape):
            h.update(type(node).__name__.encode())
        for field, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST):
                    children += 1
                    e, s, below = walk(x)
                    exact.update(e)
                    shape.update(s)
                    found += below
                elif field not in ("ctx", "type_comment", "kind"):
                    exact.update(repr(x).encode())
        e, s = exact.digest(), shape.digest()
        lines = getattr(node, "end_lineno", None) and node.end_lineno - node.lineno + 1
        if lines and lines >= least_lines and children >= least_children:
            found.append((node.lineno, node.end_lineno, e.hex(), s.hex()))
        return e, s, found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, source in frame.itertuples(index=False):
                try:
                    rows = walk(ast.parse(source or ""))[2]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                if rows:
                    out = pd.DataFrame([(file, *r) for r in rows], columns=["file", "line_start", "line_end", "exact", "shape"])
                    yield out.astype({"line_start": "int32", "line_end": "int32"})

    rows = sources.filter("language = 'python'").select("file", "source").mapInPandas(run, "file string, line_start int, line_end int, exact string, shape string")
    return rows.distinct().withColumn("id", F.xxhash64("file", "line_start", "line_end", "exact"))


def subtree_clones(trees: DataFrame) -> DataFrame:
    """``(key, clone_type, n, first_id)``: equal subtrees (type 1) and renamed ones (type 2).

    A type 2 group that has the same members as a type 1 group is left out.
    """
    one = hash_groups(trees, "exact").select(F.col("exact").alias("key"), F.lit("type1").alias("clone_type"), "n", "first_id")
    two = hash_groups(trees, "shape").select(F.col("shape").alias("key"), F.lit("type2").alias("clone_type"), "n", "first_id")
    told = one.select("n", "first_id")
    return one.unionByName(two.join(told, ["n", "first_id"], "left_anti"))


_OPENS = r"^\s*(?:\}\s*)?(?:if|else|elif|for|while|loop|do|switch|match|case|try|catch|except|finally|with|def|fn|func|function|class)\b"


def blocks(sources: DataFrame, *, least_lines: int = 4) -> DataFrame:
    """``(id, file, language, line_start, line_end, source)`` of blocks that a keyword opens."""
    import re

    opens = re.compile(_OPENS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, language, source in frame.itertuples(index=False):
                lines, rows = (source or "").split("\n"), []
                for i, line in enumerate(lines):
                    if opens.match(line):
                        end = _scope_end(lines, i, language)
                        if end - i + 1 >= least_lines:
                            rows.append((file, language, i + 1, end + 1, "\n".join(lines[i : end + 1])))
                if rows:
                    out = pd.DataFrame(rows, columns=["file", "language", "line_start", "line_end", "source"])
                    yield out.astype({"line_start": "int32", "line_end": "int32"})

    schema = "file string, language string, line_start int, line_end int, source string"
    return sources.select("file", "language", "source").mapInPandas(run, schema).withColumn("id", F.xxhash64("file", "line_start", "line_end"))


def block_clones(rows: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """``(a, b, similarity, clone_type)``: type 1 where the trimmed texts are equal."""
    pairs = lsh_pairs(function_signatures(rows), threshold=threshold)
    text = rows.select("id", F.md5(F.regexp_replace("source", r"\s+", " ")).alias("h"))
    both = pairs.join(text.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(text.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", "similarity", F.when(F.col("ha") == F.col("hb"), "type1").otherwise("type3").alias("clone_type"))


def merge_adjacent(spans: DataFrame, *, gap: int = 2) -> DataFrame:
    """Spans ``(id, file, start, end, similarity)`` of a file at most ``gap`` lines apart become
    one: islands over the running end, in one window a file; the least similarity stays."""
    order = Window.partitionBy("file").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", F.when(F.col("start") - upto <= gap, 0).otherwise(1))
    run = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("similarity").alias("similarity"), F.count(F.lit(1)).alias("n"))


def overlapping_instances(spans: DataFrame) -> DataFrame:
    """Pairs of clone instances that share lines, for clustering."""
    return interval_overlaps(spans)


def clone_filters(instances: DataFrame) -> DataFrame:
    """Groups worth telling: not all in tests, not all trait implementations of one name, not
    all of at most five lines without control flow. ``instances(group_id, name, lines,
    has_control, in_test, is_impl)``."""
    g = instances.groupBy("group_id").agg(
        F.bool_or(~F.col("in_test")).alias("real"), F.bool_and("is_impl").alias("impl"), F.countDistinct("name").alias("names"),
        F.bool_or((F.col("lines") > 5) | F.col("has_control")).alias("solid"),
    )
    keep = g.filter("real and solid and not (impl and names = 1)").select("group_id")
    return instances.join(keep, "group_id", "left_semi")


FEATURES = ("cyclomatic_complexity", "num_params", "num_returns", "num_branches", "num_loops", "nesting_depth", "lines_of_code", "num_calls")


def semantic_features(functions: DataFrame) -> DataFrame:
    """``id`` and eight counts of each function, from its lines."""
    rows = functions.select("id", F.posexplode(F.split("source", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    code = rows.filter("line <> ''").filter(~F.col("line").rlike(r"^(?://|#|/\*|\*)"))
    count = lambda p: F.regexp_count("line", F.lit(p))
    w = Window.partitionBy("id").orderBy("pos")
    level = F.sum(count(r"\{") - count(r"\}")).over(w) + count(r"\}")
    indent = F.floor((F.length("raw") - F.length(F.ltrim("raw"))) / 4) + 1
    branch = F.col("line").rlike(r"^(?:\} )?(?:if[ (]|else if|elif |switch[ (]|match |case |default:)").cast("int")
    loop = F.col("line").rlike(r"^(?:for[ (]|while[ (]|loop(?:$|[ {])|do ?\{)").cast("int")
    calls = F.when(F.col("line").rlike(r"^(?:pub )?(?:async )?(?:def|fn|func|function) "), 0).otherwise(count(r"\w\("))
    logic = count(r"&&|\|\||\b(?:and|or)\b")
    per = code.select(
        "id", branch.alias("br"), loop.alias("lo"), logic.alias("lg"), calls.alias("ca"), F.col("line").rlike(r"^return(?:[ ;]|$)").cast("int").alias("re"),
        F.greatest(level, F.when(F.col("line").endswith(":") & ~F.col("line").contains("{"), indent).otherwise(0)).alias("de"),
    )
    sums = per.groupBy("id").agg(
        (1 + F.sum(F.col("br") + F.col("lo") + F.col("lg"))).cast("int").alias("cyclomatic_complexity"), F.sum("re").cast("int").alias("num_returns"), F.sum("br").cast("int").alias("num_branches"),
        F.sum("lo").cast("int").alias("num_loops"), F.max("de").cast("int").alias("nesting_depth"), F.count(F.lit(1)).cast("int").alias("lines_of_code"), F.sum("ca").cast("int").alias("num_calls"),
    )
    inside = F.regexp_extract("source", r"\(([^()]*)\)", 1)
    params = functions.select("id", F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ","))).alias("num_params"))
    return sums.join(params, "id").select("id", *FEATURES)


def feature_distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance over the larger length, at most one; zero for two zeros."""
    norm = lambda v: F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    gap = norm([x - y for x, y in zip(a, b, strict=True)])
    top = F.greatest(norm(a), norm(b))
    return F.when(top > 0, F.least(gap / top, F.lit(1.0))).otherwise(F.lit(0.0))


def semantic_pairs(features: DataFrame, *, most: float = 0.3) -> DataFrame:
    """Pairs with a feature distance of at most ``most``, exactly.

    Lengths of such vectors differ by a factor of at most ``1 / (1 - most)``, so vectors
    are put in rings of that width and meet those of the same and the next ring only.
    """
    cols = [F.col(c).cast("double") for c in FEATURES]
    length = F.sqrt(sum((c * c for c in cols), F.lit(0.0)))
    ring = F.floor(F.log(F.greatest(length, F.lit(1.0))) / F.lit(float(-np.log(1 - most)))).cast("long")
    v = features.withColumn("ring", ring)
    x = v.withColumn("meet", F.explode(F.array("ring", F.col("ring") + 1, F.col("ring") - 1))).alias("x")
    y = v.alias("y")
    d = feature_distance([F.col(f"x.{c}").cast("double") for c in FEATURES], [F.col(f"y.{c}").cast("double") for c in FEATURES])
    return x.join(y, (F.col("x.meet") == F.col("y.ring")) & (F.col("x.id") < F.col("y.id"))).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.alias("distance")
    ).filter(F.col("distance") <= most)


def tree_of(source: str) -> tuple[list[str], list[int]]:
    """Labels and leftmost leaves in post-order: Python's grammar, else nesting by indent."""
    labels, left = [], []

    def add(label: str, kids: list) -> None:
        first = len(labels)
        for k in kids:
            k()
        labels.append(label)
        left.append(left[first] if kids else len(labels) - 1)

    def python(node: ast.AST):
        return lambda: add(type(node).__name__, [python(c) for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator))])

    try:
        python(ast.parse(source))()
        return labels, left
    except (SyntaxError, ValueError, RecursionError):
        labels.clear()
        left.clear()
    stack: list[tuple[int, str, list]] = [(-1, "root", [])]
    for line in source.split("\n"):
        if line.strip():
            depth = len(line) - len(line.lstrip())
            while stack[-1][0] >= depth:
                stack.pop()
            node = (depth, line.split()[0].strip("(){};:"), [])
            stack[-1][2].append(node)
            stack.append(node)

    def plain(node):
        return lambda: add(node[1], [plain(k) for k in node[2]])

    plain(stack[0])()
    return labels, left


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Least number of node insertions, deletions and renames; rows of the inner table at once."""
    (la, ka), (lb, kb) = a, b
    n, m = len(la), len(lb)
    if not n or not m:
        return max(n, m)
    roots = lambda k: [i for i in range(len(k)) if k[i] not in k[i + 1 :]]
    done = np.zeros((n, m), int)
    for i in roots(ka):
        for j in roots(kb):
            x, y = ka[i], kb[j]
            f = np.zeros((i - x + 2, j - y + 2), int)
            f[:, 0], f[0, :] = np.arange(i - x + 2), np.arange(j - y + 2)
            for p in range(x, i + 1):
                for q in range(y, j + 1):
                    r, c = p - x + 1, q - y + 1
                    best = min(f[r - 1, c], f[r, c - 1]) + 1
                    if ka[p] == x and kb[q] == y:
                        f[r, c] = done[p, q] = min(best, f[r - 1, c - 1] + (la[p] != lb[q]))
                    else:
                        f[r, c] = min(best, f[ka[p] - x, kb[q] - y] + done[p, q])
    return int(done[-1, -1])


def tree_pairs(pairs: DataFrame, functions: DataFrame, *, most: float = 0.4) -> DataFrame:
    """Candidate pairs ``(a, b)`` whose tree distance over the larger size is at most ``most``."""

    @F.arrow_udf("double")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(x.to_pylist(), y.to_pylist(), strict=True):
            a, b = tree_of(s or ""), tree_of(t or "")
            out.append(tree_distance(a, b) / max(len(a[0]), len(b[0]), 1))
        return pa.array(out, pa.float64())

    text = functions.select("id", "source")
    both = pairs.select("a", "b").join(text.select(F.col("id").alias("a"), F.col("source").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("source").alias("y")), "b")
    return both.select("a", "b", apart("x", "y").alias("distance")).filter(F.col("distance") <= most)


def svd_embeddings(weights: DataFrame, *, dim: int = 64, rounds: int = 2, seed: int = 42) -> DataFrame:
    """``(doc_id, term, weight)`` -> ``(doc_id, embedding)``: randomised truncated SVD.

    Only tables of ``dim`` values a term or a document are made; the ``dim`` square Gram
    matrix is all that reaches the driver. Signs are fixed by the largest component.
    """
    def times(basis: DataFrame, key: str, other: str) -> DataFrame:
        cells = weights.join(basis, key).select(other, F.posexplode(F.transform("v", lambda x: x * F.col("weight"))).alias("k", "x"))
        sums = cells.groupBy(other, "k").agg(F.sum("x").alias("x"))
        return sums.groupBy(other).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))

    def gram(rows: DataFrame) -> np.ndarray:
        grid = F.flatten(F.transform("v", lambda x: F.transform("v", lambda y: x * y)))
        cells = rows.select(F.posexplode(grid).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        return np.array([r.x for r in sorted(cells, key=lambda r: r.k)]).reshape(dim, dim)

    def turn(rows: DataFrame, matrix: np.ndarray, key: str) -> DataFrame:
        columns = [F.array(*[F.lit(float(x)) for x in matrix[:, j]]) for j in range(matrix.shape[1])]
        dot = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return rows.select(key, F.array(*[dot(c) for c in columns]).alias("v"))

    def whiten(rows: DataFrame, key: str) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(rows))
        return turn(rows, vectors / np.sqrt(np.maximum(values, 1e-12)), key)

    from marquetry.runtime import cut

    unit = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "term", F.lit(str(i)))), 1, 8), 16, 10).cast("double") / 2.0**31 - 1
    terms = weights.select("term").distinct().select("term", F.array(*[unit(i) for i in range(dim)]).alias("v"))
    for _ in range(rounds):
        docs = cut(whiten(cut(times(terms, "term", "doc_id")), "doc_id"))
        terms = cut(times(docs, "doc_id", "term"))
    basis = cut(whiten(terms, "term"))
    return times(basis, "term", "doc_id").withColumnRenamed("v", "embedding")


def functions_of(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions with their source text, cut out of the files by line."""
    lines = sources.select("file", F.split("source", "\n").alias("all_lines"))
    rows = nodes.filter("kind in ('function', 'method')").select("id", "file", "name", "language", "line_start", "line_end")
    text = F.array_join(F.slice("all_lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    return rows.join(lines, "file").select("id", "file", "name", "language", "line_start", "line_end", text.alias("source"))


def cfg_block_spans(blocks: DataFrame, statements: DataFrame, functions: DataFrame, *, least: int = 4) -> DataFrame:
    """``(func, block, line_start, line_end)``: the lines of control-flow blocks of at least
    ``least`` lines; a function without such facts gives its own span as block -1.
    ``statements(func, block, line)``; ``functions(func, line_start, line_end)``."""
    spans = statements.groupBy("func", "block").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"))
    long = spans.join(blocks.select("func", "block").distinct(), ["func", "block"]).filter(F.col("line_end") - F.col("line_start") + 1 >= least)
    bare = functions.join(statements.select("func").distinct(), "func", "left_anti").filter(F.col("line_end") - F.col("line_start") + 1 >= least)
    return long.select("func", "block", "line_start", "line_end").unionByName(bare.select("func", F.lit(-1).alias("block"), "line_start", "line_end"))


def is_implementation(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``functions`` plus ``is_impl``: inside a block that implements a trait, overriding, or
    a special method (what the trait filter of clone groups needs)."""
    from marquetry.operators.entries import implementations

    alive = implementations(functions, blocks).withColumn("is_impl", F.lit(True))
    return functions.join(alive, "id", "left").withColumn("is_impl", F.coalesce("is_impl", F.lit(False)))
