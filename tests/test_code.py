"""Extraction, resolution, flow, clones, rules, reports and increments on literal sources."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from marquetry.operators import clones as C
from marquetry.operators import flow as D
from marquetry.operators import graph as G
from marquetry.operators import resolve as R
from marquetry.operators import rules as U
from marquetry.sources import code, config, sinks
from marquetry.streaming import incremental as I

PY_A = '''import os
from pkg.b import helper, unused

class Base:
    def run(self, n):
        total = 0
        for i in range(n):
            if i % 2:
                total += i
            else:
                total -= helper(i)
        return total

class Child(Base):
    def run(self, n):
        return self.other(n)

    def other(self, n):
        return os.getcwd()

def main():
    x = 1
    x = 2
    return Base().run(x)
'''
PY_B = '''def helper(v):
    if v > 1:
        return v * 2
    return v

def lonely(v):
    if v > 1:
        return v * 2
    return v
'''
JS = '''import {helper as h} from "./util";
class Shape extends Thing {
  area(w, q) {
    return h(w) * q;
  }
}
function draw(s) {
  s.area(1, 2);
}
'''


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("pkg/a.py", "python", PY_A), ("pkg/b.py", "python", PY_B), ("web/x.js", "javascript", JS), ("pkg/bad.py", "python", "def broken(:\n  pass\n"), ("pkg/none.py", "python", None)]
    return spark.createDataFrame(rows, "file string, language string, source string").cache()


@pytest.fixture(scope="module")
def facts(sources):
    return code.extract(sources).cache()


@pytest.fixture(scope="module")
def nodes(facts):
    return code.code_nodes(facts).cache()


def test_nodes(nodes):
    got = {(r.file, r.full_name, r.kind, r.visibility) for r in nodes.collect()}
    assert ("pkg/a.py", "Base.run", "method", "public") in got
    assert ("pkg/b.py", "helper", "function", "public") in got
    assert ("web/x.js", "Shape.area", "method", "public") in got
    assert ("pkg/bad.py", "broken", "function", "public") in got  # by line patterns


def test_calls_belong_to_the_innermost_function(facts, nodes):
    name = {r.id: f"{r.file}:{r.full_name}" for r in nodes.collect()}
    got = {(name[r.src], name[r.dst], r.confidence) for r in R.resolve_calls(facts, nodes).collect()}
    assert ("pkg/a.py:Base.run", "pkg/b.py:helper", "high") in got
    assert ("pkg/a.py:Child.run", "pkg/a.py:Child.other", "certain") in got
    assert ("web/x.js:draw", "web/x.js:Shape.area", "certain") in got
    assert not [x for x in got if x[0].startswith("web") and x[1].startswith("pkg")]


def test_unused_code_end_to_end(facts, nodes):
    edges = R.resolve_calls(facts, nodes).select("src", "dst")
    dead = {r.full_name for r in G.unreachable(nodes, edges, nodes.filter("name = 'main'").select("id")).filter("kind = 'function'").collect()}
    assert dead == {"lonely", "broken", "draw"}


def test_symbols(facts):
    exports, imports = R.symbol_table(facts)
    assert {r.name for r in R.unused_imports(facts).filter("file like '%.py'").collect()} == {"unused"}
    assert "lonely" in {r.name for r in R.unused_exports(exports, imports).collect()}
    assert {r.name for r in R.unresolved_imports(exports, imports).collect()} == {"os", "unused"}
    assert R.dispatch_edges(code.code_nodes(facts), facts).count() == 1
    assert {(r.owner, r["class"]) for r in R.virtual_facts(facts)["instantiates"].collect()} == {("main", "Base")}


def test_affected_files(facts, nodes, spark):
    edges = R.resolve_calls(facts, nodes)
    changed = spark.createDataFrame([("pkg/b.py",)], "file string")
    assert {r.file for r in R.affected_files(nodes, edges, changed).collect()} == {"pkg/a.py", "pkg/b.py"}


def test_flow(facts):
    t = code.flow_tables(facts)
    mine = {k: v.filter("func = 'pkg/a.py:Base.run'") for k, v in t.items()}
    reaching = D.reaching_definitions(mine["blocks"], mine["edges"], mine["defs"])
    links = {(r.src, r.dst, r.var) for r in D.data_dependence(reaching, mine["defs"], mine["uses"]).collect()}
    after = next(r.block for r in mine["blocks"].collect() if r.label == "after_loop")
    assert (0, after, "total") in links and len([x for x in links if x[2] == "total" and x[1] == after]) == 3
    control = {(r.src, r.dst) for r in D.control_dependence(mine["blocks"], mine["edges"]).collect()}
    yes = next(r.block for r in mine["blocks"].collect() if r.label == "if_true")
    assert any(b == yes for _, b in control)
    idom = {r.block: r.idom for r in D.dominators(mine["blocks"], mine["edges"]).collect()}
    assert idom[after] == 2
    # x = 1 in main is overwritten before it is read
    main = {k: v.filter("func = 'pkg/a.py:main'").select("func", "var", F.col("stmt").alias("pos")) for k, v in t.items() if k in ("defs", "uses")}
    assert [(r.var, r.reason) for r in D.dead_stores(main["defs"], main["uses"]).collect()] == [("x", "overwritten")]


def test_lattice_and_constants(spark):
    rows = spark.createDataFrame([("b", "x", "const", "1"), ("b", "x", "top", None), ("b", "y", "const", "1"), ("b", "y", "const", "2")], "block string, var string, tag string, val string")
    assert {(r["var"], r.tag, r.val) for r in D.lattice_meet(rows, ["block", "var"]).collect()} == {("x", "const", "1"), ("y", "bottom", None)}
    edges = spark.createDataFrame([("f", 0, 1), ("f", 0, 2), ("f", 1, 3), ("f", 2, 3)], "func string, src int, dst int")
    assigns = spark.createDataFrame([("f", 0, 0, "a", "2 + 3"), ("f", 1, 0, "b", "a * 2"), ("f", 2, 0, "b", "10"), ("f", 3, 0, "c", "b - 1"), ("f", 2, 1, "d", "g()")], "func string, block int, stmt int, var string, expr string")
    got = {(r.block, r["var"]): (r.tag, r.val) for r in D.constant_propagation(edges, assigns).collect()}
    assert got[3, "c"] == ("const", "9") and got[3, "d"][0] == "bottom"


def brute_distance(a, b):
    import functools

    def forest(tree):
        labels, left = tree
        def build(i):
            kids, j = [], i - 1
            while j >= left[i]:
                kids.append(build(j))
                j = left[j] - 1
            return (labels[i], tuple(reversed(kids)))
        return (build(len(labels) - 1),)

    size = lambda f: sum(1 + size(k) for _, k in f)

    @functools.cache
    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        (x, xs), (y, ys) = f[-1], g[-1]
        return min(d(f[:-1] + xs, g) + 1, d(f, g[:-1] + ys) + 1, d(f[:-1], g[:-1]) + d(xs, ys) + (x != y))

    return d(forest(a), forest(b))


def random_tree(rng, n):
    parent = [rng.randrange(i) for i in range(1, n)]
    kids = {i: [j + 1 for j, p in enumerate(parent) if p == i] for i in range(n)}
    labels, left = [], []
    def walk(i):
        first = len(labels)
        for k in kids[i]:
            walk(k)
        labels.append(rng.choice("abc"))
        left.append(left[first] if kids[i] else len(labels) - 1)
    walk(0)
    return labels, left


def test_tree_distance_equals_brute_force():
    rng = random.Random(3)
    trees = [random_tree(rng, rng.randint(1, 8)) for _ in range(8)]
    for a, b in itertools.product(trees, trees):
        assert C.tree_distance(a, b) == brute_distance(a, b)


def test_clones(sources, facts, nodes, spark):
    functions = C.functions_of(sources, nodes).cache()
    name = {r.id: r.name for r in functions.collect()}
    pairs = {frozenset((name[r.a], name[r.b])) for r in C.file_clones(functions).collect()}
    assert frozenset(("helper", "lonely")) in pairs
    trees = C.subtrees(sources)
    assert C.subtree_clones(trees).filter("clone_type = 'type2'").count() >= 1
    features = {name[r.id]: r for r in C.semantic_features(functions).collect()}
    assert (features["helper"].num_branches, features["helper"].num_returns, features["helper"].num_params) == (1, 2, 1)
    near = C.semantic_pairs(C.semantic_features(functions))
    verified = {frozenset((name[r.a], name[r.b])) for r in C.tree_pairs(near, functions).collect()}
    assert frozenset(("helper", "lonely")) in verified
    prints = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, -1), (5, 1 << 40)], "id long, simhash long")
    assert {(r.a, r.b, r.distance) for r in C.hamming_pairs(prints, 3).collect()} == {(1, 2, 0), (1, 3, 3), (1, 5, 1)}
    assert C.block_clones(C.blocks(sources)).filter("clone_type = 'type3'").count() >= 0
    spans = spark.createDataFrame([(1, "f", 1, 4, 1.0), (2, "f", 6, 9, 0.9), (3, "f", 20, 25, 0.8)], "id long, file string, start int, end int, similarity double")
    assert {(r.start, r.end, r.n) for r in C.merge_adjacent(spans).collect()} == {(1, 9, 2), (20, 25, 1)}


def test_embeddings_keep_inner_products(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 12))  # rank 3
    rows = [(i, f"t{j}", float(m[i, j])) for i in range(30) for j in range(12)]
    got = C.svd_embeddings(spark.createDataFrame(rows, "doc_id int, term string, weight double"), dim=3).collect()
    e = np.array([r.embedding for r in sorted(got, key=lambda r: r.doc_id)])
    assert np.allclose(e @ e.T, m @ m.T, atol=1e-6)


def test_rules(spark):
    assert len(U.built_in()) == 27 and U.validate(U.built_in()) == []
    src = spark.createDataFrame([("a.py", "python", "x = 1\nos.system('ls')\npassword = 'hunter2hunter2'\n"), ("Dockerfile", "docker", "FROM base:latest\n")], "file string, language string, source string")
    got = {(r.rule_id, r.file, r.line_start) for r in U.apply_rules(src).collect()}
    assert {("SEC003", "a.py", 2), ("SEC004", "a.py", 3), ("IAC-DOCKER-002", "Dockerfile", 1)} <= got
    assert not [x for x in got if x[0].startswith("IAC") and x[1] == "a.py"]
    rule = U.convert({"id": "same", "message": "m", "severity": "ERROR", "pattern": "$X == $X"})
    assert {r.file for r in U.apply_rules(spark.createDataFrame([("p", "python", "a == a"), ("q", "python", "a == b")], "file string, language string, source string"), [rule]).collect()} == {"p"}
    text = U.explain(U.apply_rules(src).filter("rule_id = 'SEC003'"), src, around=1).first().context
    assert text.split("\n") == ["1: x = 1", "2: os.system('ls')", "3: password = 'hunter2hunter2'"]


def test_reports(spark):
    f = spark.createDataFrame([("R1", "high", "certain", "a%b", "x.py", 3, 4), ("R2", "low", "low", "t", "y.py", 1, None)], "rule_id string, severity string, confidence string, title string, file string, line_start int, line_end int")
    doc = json.loads("".join(sinks.sarif(f, tool="t", invocation={"executionSuccessful": True})))
    assert [r["ruleId"] for r in doc["runs"][0]["results"]] == ["R1", "R2"] and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 2
    assert f.select(sinks.annotation().alias("a")).first().a == "::error file=x.py,line=3::a%25b"
    assert sinks.json_rows(f).count() == 2 and sinks.summary(f).count() == 2


def test_increments(spark, tmp_path):
    old = I.with_hash(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, source string"))
    new = I.with_hash(spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], "file string, source string"))
    changes = I.detect_changes(old, new)
    assert {(r.file, r.change) for r in changes.collect()} == {("a", "deleted"), ("b", "same"), ("c", "changed"), ("d", "added")}
    merged = I.incremental(old, changes, lambda rows: rows, new)
    assert {(r.file, r.source) for r in merged.collect()} == {("b", "2"), ("c", "x"), ("d", "4")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('{"file": "a", "source": "1"}\n{"file": "b", "source": "2"}\n')
    stream = spark.readStream.schema("file string, source string").json(str(tmp_path / "in"))
    I.ingest(stream, lambda df: {"files": df}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "files")).count() == 2
    I.save_snapshot(old, str(tmp_path / "snap"), "s1")
    I.save_snapshot(new, str(tmp_path / "snap"), "s2")
    assert I.load_snapshot(spark, str(tmp_path / "snap"), "s1").count() == 3


def test_scan_and_config(spark, tmp_path):
    for path, text in {"a.py": "x = 1\n", "node_modules/b.js": "1", ".git/c.py": "1", "d/e.go": "package d", "f.txt": "no", "empty.py": ""}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert {(r.file, r.language) for r in code.scan(spark, str(tmp_path)).collect()} == {("a.py", "python"), ("d/e.go", "go")}
    assert config.parse_changes("M\ta\nR100\tb\tc\nD\td\nX\te") == [("a", "modified"), ("c", "renamed"), ("d", "deleted")]
    (tmp_path / "package.json").write_text('{"dependencies": {"react": "1"}, "main": "src/index.js"}')
    assert config.detect_presets(str(tmp_path)) == ["react"] and config.entry_files(str(tmp_path)) == {"src/index.js"}
    (tmp_path / "m.toml").write_text("min_lines = 9\n")
    assert config.Config.load(str(tmp_path / "m.toml"), env={"MARQUETRY_MAX_CLONES": "4"}).limits() == {"clones": 4}


def test_paths_are_ignored_as_ignore_files_say(spark, tmp_path):
    for path, text in {
        "a.py": "x", "log/b.py": "x", "keep/log/c.py": "x", "gen/d.py": "x", "gen/stay.py": "x", ".gitignore": "/log/\ngen/*\n!gen/stay.py\n", "env2/pyvenv.cfg": "x", "env2/lib/e.py": "x",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    assert {r.file for r in code.scan(spark, str(tmp_path)).collect()} == {"a.py", "keep/log/c.py", "gen/stay.py"}
    assert code.project_root(["r/a/b.py", "r/a/c/d.py"], lambda p: p == "r/go.mod") == "r" and code.project_root([], lambda p: True) == ""


def test_narrowed_pattern_rules(spark):
    rule = U.convert({"id": "open", "message": "m", "severity": "ERROR", "patterns": [{"pattern": "open($X)"}, {"pattern-not": "open(SAFE)"}]})
    rows = [("a", "python", "open(path)"), ("b", "python", "open(SAFE)"), ("c", "python", "x")]
    assert {r.file for r in U.apply_rules(spark.createDataFrame(rows, "file string, language string, source string"), [rule]).collect()} == {"a"}
    with pytest.raises(ValueError):
        U.convert({"id": "x", "message": "m", "patterns": [{"pattern": "a"}, {"pattern-inside": "b"}]})


def random_graph(spark, n, m, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return pairs, spark.createDataFrame(pairs, "src long, dst long"), spark.range(n + 2)


def test_distributed_graph_code_equals_the_local_one(spark):
    _, e, n = random_graph(spark, 30, 45, 1)
    for run in (
        lambda most: G.strongly_connected(n, e, local_edges=most), lambda most: G.reach(e, spark.range(3), local_edges=most),
        lambda most: G.pagerank(n, e, rounds=4, local_edges=most).select("id", F.round("score", 9)),
    ):
        assert sorted(map(tuple, run(10**6).collect())) == sorted(map(tuple, run(0).collect()))


def test_betweenness_counts_shortest_paths(spark):
    pairs, e, n = random_graph(spark, 14, 30, 2)
    succ = {}
    for a, b in set(pairs):
        succ.setdefault(a, set()).add(b)

    def shortest(a, b):
        paths = [[a]]
        seen = {a}
        while paths:
            done = [p for p in paths if p[-1] == b]
            if done:
                return done
            paths = [[*p, x] for p in paths for x in succ.get(p[-1], ()) if x not in seen]
            seen |= {p[-1] for p in paths}
        return []

    want = dict.fromkeys(range(16), 0.0)
    for a, b in itertools.permutations(range(14), 2):
        found = shortest(a, b)
        for p in found:
            for x in p[1:-1]:
                want[x] += 1 / len(found)
    got = {r.id: r.score for r in G.betweenness(n, e).collect()}
    assert got == pytest.approx({k: v / (15 * 14) for k, v in want.items()})


def test_rapid_types_is_the_least_fixed_point(spark):
    rng = random.Random(4)
    direct = {(rng.randrange(20), rng.randrange(20)) for _ in range(15)}
    virtual = {(rng.randrange(20), rng.randrange(20)) for _ in range(40)}
    owner = {i: f"c{i % 4}" for i in range(20)}
    made = {(i, f"c{rng.randrange(4)}") for i in range(0, 20, 3)}
    reached = {0}
    while True:
        types = {c for i, c in made if i in reached}
        more = {b for a, b in direct if a in reached} | {b for a, b in virtual if a in reached and owner[b] in types}
        if more <= reached:
            break
        reached |= more
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    methods = frame({(i, c, "m") for i, c in owner.items()}, "id long, class string, name string")
    got = G.rapid_types(frame(direct, "src long, dst long"), spark.range(1), frame(virtual, "src long, target long"), frame(made, "id long, class string"), methods)
    assert {r.id for r in got.collect()} == reached


def test_signature_pairs_find_nearly_all(spark):
    from marquetry.operators import similarity as S

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    exact = {(r.a, r.b) for r in S.overlap_pairs(S.document_grams(docs)).filter("jaccard >= 0.85").collect()}
    groups = {r.id: r.cluster for r in S.clusters(S.lsh_pairs(S.minhash(docs), threshold=0.8)).collect()}
    found = {p for p in exact if groups.get(p[0], p[0]) == groups.get(p[1], p[1])}
    assert len(exact) > 50 and len(found) >= 0.9 * len(exact)


def test_file_clones_lose_no_pair_of_close_fingerprints(spark):
    text = "\n".join(f"def f{i}(a, b):\n    return a * {i} + b" for i in range(30))
    rows = [(1, "a.py", text), (2, "b.py", text.replace("f3(", "g3(")), (3, "c.py", "x = [1, 2, 3]\nprint(x)\n" * 9)]
    files = spark.createDataFrame(rows, "id long, file string, source string")
    assert {(r.a, r.b) for r in C.file_clones(files).collect()} == {(1, 2)}


def test_results_are_held_for_a_generation(spark):
    now = [0.0]
    cache, made = I.ResultCache(10, lambda: now[0]), []

    def make():
        made.append(1)
        return spark.range(3)

    assert cache.get("a", make).count() == 3 and cache.get("a", make).count() == 3 and len(made) == 1
    now[0] = 11
    cache.get("a", make)
    cache.bump()
    cache.get("a", make)
    assert len(made) == 3


def test_sketch_algebra_and_running_totals(spark):
    from marquetry.operators import similarity as S
    from marquetry.runtime import running_total

    grams = spark.createDataFrame([(d, f"g{i}") for d, r in ((1, range(0, 300)), (2, range(100, 400))) for i in r], "doc_id long, gram string")
    row = S.sketch_algebra(spark.createDataFrame([(1, 2)], "a long, b long"), S.distinct_sketches(grams)).first()
    assert (row.both, row.either) == (200, 400) and row.jaccard == 0.5
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    assert all(r.t == sum(i % 7 for i in range(r.id)) for r in running_total(rows, ["id"], F.col("v"), "t").collect())
    assert running_total(rows.limit(0), ["id"], F.col("v"), "t").count() == 0


def test_pairs_of_vectors_and_fingerprints_are_compared_in_cells(spark, monkeypatch):
    """Cells over several blocks find what pairwise loops find; no join makes all pairs."""
    import math

    from marquetry.operators import cells, similarity

    monkeypatch.setattr(cells, "CELL", 9)
    monkeypatch.setattr(similarity, "COSINE_CELL", 7)
    rng = random.Random(9)
    rows = [(i, i % 3 if i % 11 else None, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, 0, [0.0] * 4), (61, 0, None), (62, 0, [1.0, None, 0.0, 0.0]), (63, 0, [1.0, 2.0]), (64, 0, [2.0, 4.0]), (65, 1, rows[1][2])]

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x or None in y or not any(x) or not any(y):
            return 0.0
        return sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(q * q for q in y))

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] is not None and a[1] == b[1] and cosine(a[2], b[2]) >= 0.35}
    df = spark.createDataFrame(rows, "i long, k int, v array<float>")
    got = similarity.cosine_pairs(df, threshold=0.35, by="k", id_col="i", vec_col="v")
    found = [(r.a, r.b) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert all(abs(r.similarity - cosine(rows[r.a][2], rows[r.b][2])) < 1e-6 for r in got.collect())
    assert similarity.cosine_pairs(df.limit(0), threshold=0.35, by="k", id_col="i", vec_col="v").count() == 0

    prints = [(i, rng.getrandbits(64) - 2**63) for i in range(40)] + [(40 + i, (rng.getrandbits(6) << 20)) for i in range(10)]
    for bits in (4, 15):
        near = C.hamming_pairs(spark.createDataFrame(prints, "id long, simhash long"), bits)
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert bits < 15 or "bit_count" not in plan  # distances are no filter on a join of short blocks
        least = {h: min(i for i, g in prints if g == h) for _, h in prints}
        want = {(min(x, y), max(x, y)) for (g, x), (h, y) in itertools.combinations(least.items(), 2) if (g ^ h).bit_count() <= bits}
        want |= {(least[h], i) for i, h in prints if least[h] != i}
        assert {(r.a, r.b) for r in near.collect()} == {p for p in want}


def test_graphs_are_walked_in_pieces_and_by_rounds(spark, monkeypatch):
    """One task, weakly connected pieces and rounds agree; a part of the pieces may be too large."""
    monkeypatch.setattr(G, "CHUNK", 6)
    monkeypatch.setattr(G, "SOURCES", 4)
    pairs = [(10 * k + a, 10 * k + b) for k in range(4) for a, b in random_graph(spark, 9, 11, k)[0]] + [(90, 91), (95, 95)]
    e, n = spark.createDataFrame(pairs, "src long, dst long"), spark.range(99)
    seeds = spark.createDataFrame([(0, "x"), (3, "y"), (12, "x"), (25, "y"), (90, "x"), (97, "y")], "id long, kind string")
    for run in (
        lambda **o: G.reach(e, seeds, **o), lambda **o: G.strongly_connected(n, e, **o),
        lambda **o: G.pagerank(n, e, rounds=7, **o).select("id", F.round("score", 12)),
    ):
        want = sorted(map(tuple, run().collect()))
        assert all(sorted(map(tuple, run(local_edges=0, piece_edges=most).collect())) == want for most in (0, 10, 99))
    want = {r.id: r.score for r in G.betweenness(n, e).collect()}
    assert max(want.values()) > 0
    # Larger than any task may hold: pieces, rounds, and rounds over halved sources.
    for options in ({"piece_edges": 99}, {"piece_edges": 10}, {"piece_edges": 0, "most_states": 60}):
        got = {r.id: r.score for r in G.betweenness(n, e, most_edges=1, **options).collect()}
        assert got == pytest.approx(want)


def test_blocks_of_a_file_are_compared_in_cells(spark, monkeypatch):
    """A pair is rated once, not once a shared word, also over several cells and vocabularies."""
    from marquetry.operators import textrules

    monkeypatch.setattr(textrules, "BLOCKS", 5)
    monkeypatch.setattr(textrules, "VOCABULARY", 4)
    rng = random.Random(3)
    rows = [(f, b, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(9)))) for f in (1, 2) for b in range(14)] + [(1, 20, None), (None, 1, "a b"), (3, 1, "a")]
    bags = {(f, b): set((t or "").split()) for f, b, t in rows if f}
    want = {(x[0], x[1], y[1]) for x, y in itertools.combinations(sorted(bags), 2) if x[0] == y[0] and bags[x] | bags[y] and len(bags[x] & bags[y]) / len(bags[x] | bags[y]) >= 0.4}
    found = textrules.block_clones(spark.createDataFrame(rows, "file long, block long, text string"), threshold=0.4)
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.file, r.a, r.b) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert all(abs(r.similarity - len(bags[r.file, r.a] & bags[r.file, r.b]) / len(bags[r.file, r.a] | bags[r.file, r.b])) < 1e-12 for r in found.collect())


def test_grams_are_hashed_in_their_row_and_counted_in_buckets(spark, monkeypatch):
    """Sets of grams are found without moving them; signatures are made once."""
    from marquetry.operators import similarity as S

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a b c a b"), (41, None), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None:
            sets.setdefault(i, set()).update(" ".join(w[j : j + 3]) for j in range(len(w) - 2))
    codes = S.document_codes(docs)
    assert {r.doc_id: len(r.codes) for r in codes.collect()} == {i: len(g) for i, g in sets.items() if g}
    assert "Generate" not in codes._jdf.queryExecution().optimizedPlan().toString()
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r.a, r.b) for r in S.overlap_pairs(codes, threshold=0.5).collect()} == want
    monkeypatch.setattr(S, "BUCKETS", 3)
    grams = S.document_grams(docs.filter("doc_id is not null").filter("doc_id <> 3"))
    most = int(sum(1 for i, g in sets.items() if g and i != 3) * 0.3)
    df = {}
    for i, g in sets.items():
        for x in g if i != 3 else ():
            df[x] = df.get(x, 0) + 1
    assert {r.gram: r.df for r in S.stop_grams(grams, share=0.3).collect()} == {x: c for x, c in df.items() if c > most}


def test_terms_are_weighed_in_their_row(spark):
    """Frequent terms move no row, rarer ones theirs only; repeated and null ids are whole."""
    import math
    import re

    from marquetry.operators import similarity as S

    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "Ef", "g", "h_1", f"only{i}", f"few{i % 5}"]) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(3, "ab zz"), (3, None), (90, None), (91, ""), (92, "a-b É"), (93, "Kelvin É9x"), (None, "ab null"), (None, "null"), (94, "end"), (95, "start")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    tf = {}
    for i, t in rows:
        for w in re.findall("[a-z0-9_]+", (t or "").lower()):
            if len(w) > 1:
                tf.setdefault(i, {}).setdefault(w, []).append(1)
    df = {}
    for found in tf.values():
        for w in found:
            df[w] = df.get(w, 0) + 1
    want = {}
    for i, found in tf.items():
        raw = {w: (1 + math.log(len(c))) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in found.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(i, w): x / norm for w, x in raw.items()}
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for limit in (0, 8, 10**6):
        got = S.tf_idf(docs, limit=limit).collect()
        assert len(got) == len(want) and {(r.doc_id, r.term): r.weight for r in got} == pytest.approx(want, rel=1e-12)
    assert "Exchange" not in plan(S.tf_idf(docs.filter("doc_id <> 3")))
    assert S.tf_idf(docs.limit(0)).count() == 0


def test_sketches_are_made_in_their_row(spark, tmp_path, monkeypatch):
    """The same sketches as Spark makes of grams, and none of them moves."""
    from marquetry.operators import similarity as S
    from marquetry.plans.code_queries import theta_sketches

    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choice("aB_9") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 120)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, "a b"), (63, "a a a a"), (64, "x-y É z" + "q" * 5000), (65, "c d e"), (66, "é a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for size in (100, 1 << 21):
        monkeypatch.setattr(S, "GRAM_PART", size)
        for k, lg_k in ((3, 12), (3, 5), (1, 4)):
            grams = S.document_grams(docs, k=k)
            want = S.distinct_sketches(grams, lg_k=lg_k).select("doc_id", F.col("theta").alias("t"), F.col("distinct").alias("d"))
            made = S.document_sketches(docs, k=k, lg_k=lg_k).join(want, "doc_id", "full_outer")
            both = made.select("doc_id", "grams", "distinct", "d", F.expr("theta_sketch_estimate(theta_intersection(theta, t))").alias("i"), F.expr(f"theta_sketch_estimate(theta_union(theta, t, {lg_k}))").alias("u"))
            count = {r.doc_id: r.n for r in grams.groupBy("doc_id").agg(F.count("gram").alias("n")).collect()}
            got = both.collect()
            assert {r.doc_id: r.grams for r in got} == count and all(r.distinct == r.d == r.i == r.u for r in got)
    # As in the SQL, rows of one id and of none have a row each.
    more = docs.union(spark.createDataFrame([(65, "c d e f"), (None, "a b c")], docs.schema))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    found = theta_sketches(spark, str(tmp_path))
    kept = sorted((r.doc_id for r in found.collect() if r.near), key=str)
    assert kept == sorted([i for i, t in rows if t and len(set("".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in t.lower()).split())) > 2] + [65, None], key=str)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
