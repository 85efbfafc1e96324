"""Registered queries of code operators, over literals and the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions import text as T
from marquetry.operators import clones as C
from marquetry.operators import entries as E
from marquetry.operators import findings as A
from marquetry.operators import flow as D
from marquetry.operators import graph as G
from marquetry.operators import resolve as N
from marquetry.operators import rules as U
from marquetry.operators import similarity as S
from marquetry.operators import textrules as R
from marquetry.plans.adapters import EDGES_SQL, edges, nodes
from marquetry.plans.literals import CFG, DEFS, SITES, SOURCES, USES, Literal
from marquetry.plans.queries import query
from marquetry.runtime import read_table
from marquetry.sources import code, sinks


def _blocks(spark: SparkSession) -> DataFrame:
    e = CFG.df(spark)
    ids = e.select("func", F.col("src").alias("block")).union(e.select("func", "dst")).distinct()
    return ids.withColumns({"is_entry": F.col("block") == 0, "is_exit": F.col("block") == 1})


# -- control and data flow ----------------------------------------------------------------

_BLOCKS = "b AS (SELECT func, src AS block FROM cfg UNION SELECT func, dst FROM cfg)"
#: avoid(func, gone, here): blocks that the entry reaches without passing ``gone``.
_AVOID = """avoid(func, gone, here) AS (SELECT DISTINCT func, block, 0 FROM b WHERE block <> 0
 UNION SELECT a.func, a.gone, c.dst FROM avoid a JOIN cfg c ON c.func = a.func AND c.src = a.here WHERE c.dst <> a.gone)"""
#: shun(func, gone, here): blocks from which the exit is reached without passing ``gone``.
_SHUN = """shun(func, gone, here) AS (SELECT DISTINCT func, block, 1 FROM b WHERE block <> 1
 UNION SELECT s.func, s.gone, c.src FROM shun s JOIN cfg c ON c.func = s.func AND c.dst = s.here WHERE c.src <> s.gone)"""
_DOM = """dom AS (SELECT x.func, x.block, y.block AS d FROM b x JOIN b y ON x.func = y.func AND x.block <> y.block
 WHERE y.block = 0 OR NOT EXISTS (SELECT 1 FROM avoid a WHERE a.func = x.func AND a.gone = y.block AND a.here = x.block))"""
_PDOM = """pdom AS (SELECT x.func, x.block, y.block AS d FROM b x JOIN b y ON x.func = y.func AND x.block <> y.block
 WHERE y.block = 1 OR NOT EXISTS (SELECT 1 FROM shun a WHERE a.func = x.func AND a.gone = y.block AND a.here = x.block))"""
_REACHING = """last AS (SELECT func, block, var, max(stmt) AS stmt FROM defs GROUP BY ALL),
r(func, block, def_block, def_stmt, var) AS (SELECT l.func, c.dst, l.block, l.stmt, l.var FROM last l JOIN cfg c ON c.func = l.func AND c.src = l.block
 UNION SELECT r.func, c.dst, r.def_block, r.def_stmt, r.var FROM r JOIN cfg c ON c.func = r.func AND c.src = r.block
  WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.func = r.func AND d.block = r.block AND d.var = r.var))"""
_DATA = """dd AS (SELECT u.func, u.block AS src, u.block AS dst, u.var FROM uses u JOIN defs d USING (func, block, var) WHERE d.stmt < u.stmt
 UNION SELECT u.func, r.def_block, u.block, u.var FROM uses u JOIN r USING (func, block, var) WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.func = u.func AND d.block = u.block AND d.var = u.var AND d.stmt < u.stmt))"""
_CONTROL = """cd AS (SELECT DISTINCT c.func, c.src, x.block AS dst FROM cfg c JOIN b x ON x.func = c.func
 WHERE (SELECT count(DISTINCT dst) FROM cfg k WHERE k.func = c.func AND k.src = c.src) > 1
 AND (x.block = c.dst OR EXISTS (SELECT 1 FROM pdom p WHERE p.func = c.func AND p.block = c.dst AND p.d = x.block))
 AND NOT EXISTS (SELECT 1 FROM pdom p WHERE p.func = c.func AND p.block = c.src AND p.d = x.block) AND x.block <> 1)"""


@query(f"WITH RECURSIVE {CFG.sql}, {_BLOCKS}, {_AVOID}, {_DOM} SELECT func, block, d AS idom FROM dom x WHERE (SELECT count(*) FROM dom y WHERE y.func = x.func AND y.block = x.d) = (SELECT count(*) - 1 FROM dom y WHERE y.func = x.func AND y.block = x.block)")
def dominator_tree(spark, sf):
    return D.dominators(_blocks(spark), CFG.df(spark))


@query(f"""WITH RECURSIVE {CFG.sql}, {_BLOCKS}, {_SHUN}, {_PDOM} SELECT func, block, d AS idom FROM pdom x
WHERE (SELECT count(*) FROM pdom y WHERE y.func = x.func AND y.block = x.d) = (SELECT count(*) - 1 FROM pdom y WHERE y.func = x.func AND y.block = x.block)""")
def post_dominator_tree(spark, sf):
    return D.dominators(_blocks(spark), CFG.df(spark), post=True).filter("idom >= 0 and block >= 0")


@query(f"WITH RECURSIVE {CFG.sql}, {_BLOCKS}, {_SHUN}, {_PDOM}, {_CONTROL} SELECT * FROM cd")
def control_dependences(spark, sf):
    return D.control_dependence(_blocks(spark), CFG.df(spark))


@query(f"WITH RECURSIVE {CFG.sql}, {DEFS.sql}, {_REACHING} SELECT * FROM r")
def reaching_definitions(spark, sf):
    return D.reaching_definitions(_blocks(spark), CFG.df(spark), DEFS.df(spark))


@query(f"""WITH RECURSIVE {CFG.sql}, {DEFS.sql}, {USES.sql}, l(func, block, var) AS (
SELECT func, block, var FROM uses u WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.func = u.func AND d.block = u.block AND d.var = u.var AND d.stmt < u.stmt)
UNION SELECT l.func, c.src, l.var FROM l JOIN cfg c ON c.func = l.func AND c.dst = l.block WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.func = c.func AND d.block = c.src AND d.var = l.var))
SELECT * FROM l""")
def live_variables(spark, sf):
    return D.liveness(_blocks(spark), CFG.df(spark), DEFS.df(spark), USES.df(spark))


def _data(spark):
    return D.data_dependence(D.reaching_definitions(_blocks(spark), CFG.df(spark), DEFS.df(spark)), DEFS.df(spark), USES.df(spark))


@query(f"WITH RECURSIVE {CFG.sql}, {DEFS.sql}, {USES.sql}, {_REACHING}, {_DATA} SELECT * FROM dd")
def data_dependences(spark, sf):
    return _data(spark)


@query(f"""WITH RECURSIVE {CFG.sql}, {DEFS.sql}, {USES.sql}, {_REACHING}, {_DATA}
SELECT d.func, d.block, d.var, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM dd WHERE dd.func = d.func AND dd.src = d.block AND dd.var = d.var), '') AS used_in
FROM (SELECT DISTINCT func, block, var FROM defs) d""")
def def_use_chains(spark, sf):
    found = D.def_use_chains(D.reaching_definitions(_blocks(spark), CFG.df(spark), DEFS.df(spark)), DEFS.df(spark), USES.df(spark))
    return found.withColumn("used_in", F.array_join(F.col("used_in").cast("array<string>"), ","))


_PDG = f"{CFG.sql}, {DEFS.sql}, {USES.sql}, {_BLOCKS}, {_SHUN}, {_PDOM}, {_CONTROL}, {_REACHING}, {_DATA}, pdg AS (SELECT func, src, dst, 'control' AS kind, NULL::VARCHAR AS var FROM cd UNION ALL SELECT func, src, dst, 'data', var FROM dd)"


def _pdg(spark):
    return D.program_dependence(D.control_dependence(_blocks(spark), CFG.df(spark)), _data(spark))


@query(f"WITH RECURSIVE {_PDG} SELECT * FROM pdg")
def program_dependences(spark, sf):
    return _pdg(spark)


@query(f"WITH RECURSIVE {_PDG}, s(func, block) AS (SELECT 'loop', 0 UNION SELECT p.func, p.dst FROM s JOIN pdg p ON p.func = s.func AND p.src = s.block) SELECT * FROM s")
def forward_slice(spark, sf):
    return D.slice_blocks(_pdg(spark), spark.createDataFrame([("loop", 0)], "func string, block int"), backward=False)


@query(f"""WITH RECURSIVE {_PDG}, s(func, block) AS (SELECT func, 1 FROM b WHERE block = 1 UNION SELECT p.func, p.src FROM s JOIN pdg p ON p.func = s.func AND p.dst = s.block)
SELECT func, block FROM b WHERE block > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.func = b.func AND s.block = b.block)""")
def dead_blocks(spark, sf):
    return D.dead_blocks(_blocks(spark), _pdg(spark))


_SDG = f"""{_PDG}, {SITES.sql}, site AS (SELECT DISTINCT caller || ':' || block AS site FROM sites),
w(func, a, z) AS (SELECT func, src, dst FROM pdg UNION SELECT w.func, w.a, p.dst FROM w JOIN pdg p ON p.func = w.func AND p.src = w.z),
sdg AS (SELECT func || ':' || src || CASE WHEN kind = 'data' AND func || ':' || src IN (SELECT site FROM site) THEN ':ret' ELSE '' END AS src, func || ':' || dst AS dst, kind FROM pdg
 UNION SELECT caller || ':' || block, callee || ':' || entry, 'call' FROM sites UNION SELECT caller || ':' || block, callee || ':' || entry, 'param_in' FROM sites
 UNION SELECT callee || ':' || exit, caller || ':' || block || ':ret', 'param_out' FROM sites
 UNION SELECT caller || ':' || block, caller || ':' || block || ':ret', 'summary' FROM sites WHERE EXISTS (SELECT 1 FROM w WHERE w.func = callee AND w.a = entry AND w.z = exit))"""


@query(f"WITH RECURSIVE {_SDG} SELECT * FROM sdg")
def system_dependences(spark, sf):
    return D.system_dependence(_pdg(spark), SITES.df(spark))


@query(f"""WITH RECURSIVE {_SDG}, up(node) AS (SELECT 'loop:6' UNION SELECT e.src FROM up JOIN sdg e ON e.dst = up.node WHERE e.kind <> 'param_out'),
down(node) AS (SELECT node FROM up UNION SELECT e.src FROM down JOIN sdg e ON e.dst = down.node WHERE e.kind NOT IN ('call', 'param_in')) SELECT node FROM down""")
def two_phase_slice(spark, sf):
    return D.sdg_slice(D.system_dependence(_pdg(spark), SITES.df(spark)), spark.createDataFrame([("loop:6",)], "node string"))


@query(f"""WITH RECURSIVE {_SDG}, up(node) AS (SELECT 'loop:2' UNION SELECT e.dst FROM up JOIN sdg e ON e.src = up.node WHERE e.kind NOT IN ('call', 'param_in')),
down(node) AS (SELECT node FROM up UNION SELECT e.dst FROM down JOIN sdg e ON e.src = down.node WHERE e.kind <> 'param_out') SELECT node FROM down""")
def two_phase_forward_slice(spark, sf):
    return D.sdg_slice(D.system_dependence(_pdg(spark), SITES.df(spark)), spark.createDataFrame([("loop:2",)], "node string"), backward=False)


_FUNCS = Literal("funcs", "id long, func string", ((1, "loop"), (2, "early"), (3, "line"), (4, "unseen")))


@query(f"""WITH RECURSIVE {_SDG}, {_FUNCS.sql}, up(node) AS (SELECT 'line:1' UNION SELECT e.src FROM up JOIN sdg e ON e.dst = up.node WHERE e.kind <> 'param_out'),
down(node) AS (SELECT node FROM up UNION SELECT e.src FROM down JOIN sdg e ON e.dst = down.node WHERE e.kind NOT IN ('call', 'param_in')),
c AS (SELECT split_part(src, ':', 1) AS func FROM sdg UNION SELECT split_part(dst, ':', 1) FROM sdg)
SELECT id, func FROM funcs WHERE func IN (SELECT func FROM c) AND func NOT IN (SELECT split_part(node, ':', 1) FROM down)""")
def dead_by_dependence(spark, sf):
    f = _FUNCS.df(spark)
    return D.sdg_dead(f, f, D.system_dependence(_pdg(spark), SITES.df(spark)), spark.createDataFrame([("line:1",)], "node string"))


_ASSIGNS = Literal("assigns", "func string, block int, stmt int, var string, expr string", (
    ("loop", 0, 1, "a", "2"), ("loop", 0, 2, "b", "a * 3"), ("loop", 4, 1, "c", "1"), ("loop", 5, 1, "c", "2"), ("loop", 6, 1, "d", "b + 1"), ("early", 0, 1, "x", "1 < 2"), ("early", 3, 1, "x", "2 < 1"),
))
_CONSTANTS = Literal("want", "func string, block int, var string, tag string, val string", (
    ("loop", 1, "a", "const", "2"), ("loop", 1, "b", "const", "6"), ("loop", 1, "c", "bottom", None), ("loop", 1, "d", "const", "7"), ("loop", 6, "c", "bottom", None), ("loop", 6, "d", "const", "7"),
    ("early", 1, "x", "bottom", None), ("early", 2, "x", "const", "True"), ("early", 4, "x", "const", "False"),
))


@query(f"WITH {_CONSTANTS.sql} SELECT * FROM want")
def constants_at_ends(spark, sf):
    """Constant propagation, at blocks whose values were worked out by hand."""
    found = D.constant_propagation(CFG.df(spark), _ASSIGNS.df(spark))
    asked = _CONSTANTS.df(spark).select("func", "block", "var")
    return found.join(asked, ["func", "block", "var"], "left_semi").select("func", "block", "var", "tag", "val")


_ARGS = Literal("args", "caller string, callee string, param string, tag string, val string, var string", (
    ("main", "f", "p", "const", "1", None), ("main", "f", "q", "const", "0", None), ("other", "f", "q", "const", "5", None), ("f", "g", "r", "var", None, "p"), ("f", "h", "s", "var", None, "q"),
))
_TESTS = Literal("tests", "func string, block int, var string", (("g", 3, "r"), ("h", 2, "s"), ("f", 7, "p"), ("f", 8, "q")))
_KNOWN = "k1 AS (SELECT callee AS func, param, CASE WHEN count(DISTINCT val) = 1 THEN 'const' ELSE 'bottom' END AS tag, CASE WHEN count(DISTINCT val) = 1 THEN min(val) END AS val FROM args WHERE tag = 'const' GROUP BY ALL), k AS (SELECT * FROM k1 UNION ALL SELECT a.callee, a.param, k1.tag, k1.val FROM args a JOIN k1 ON k1.func = a.caller AND k1.param = a.var)"


def _parameters(spark):
    empty = spark.createDataFrame([], "func string, param string, tag string, val string")
    return D.interprocedural_constants(_ARGS.df(spark), empty)


@query(f"WITH {_ARGS.sql}, {_KNOWN} SELECT * FROM k")
def constant_parameters(spark, sf):
    return _parameters(spark)


@query(f"WITH {_ARGS.sql}, {_TESTS.sql}, {_KNOWN} SELECT t.func, t.block, CASE WHEN k.val = '0' THEN 'true' ELSE 'false' END AS branch FROM tests t JOIN k ON k.func = t.func AND k.param = t.var WHERE k.tag = 'const'")
def dead_call_branches(spark, sf):
    return D.dead_call_branches(_parameters(spark), _TESTS.df(spark))


@query("SELECT DISTINCT p_name AS func, 0 AS src, 1 AS dst, 'next' AS kind FROM part")
def skeleton_cfg(spark, sf):
    n = nodes(spark, sf).withColumn("line_start", F.col("id"))
    return D.skeleton_cfg(n)[1]


_LINES = Literal("want", "variable string, line_no int, kind string", (
    ("n", 2, "def"), ("total", 3, "def"), ("n", 3, "use"), ("total", 4, "def"), ("total", 4, "use"), ("n", 4, "use"), ("total", 5, "use"),
))


@query(f"WITH {_LINES.sql} SELECT * FROM want")
def textual_flow(spark, sf):
    source = "def f(v):\n    n = 4  # total\n    total = n + 1\n    total += n\n    return total"
    rows = spark.createDataFrame([("a.py", "f", 1, source)], "file string, name string, line_start int, source string")
    return D.textual_flow(rows).select("variable", "line_no", "kind")


# -- graph --------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN p_name ELSE upper(p_name) END AS name FROM part WHERE p_size <= 25 OR p_size >= 20")
def merged_nodes(spark, sf):
    n = nodes(spark, sf)
    one, two = n.filter("loc <= 25").select("id", "name"), n.filter("loc >= 20").select("id", F.upper("name").alias("name"))
    e = edges(spark, sf)
    return G.merge_graphs([one, two], [e, e])[0]


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#12' AND p_name = (SELECT min(p_name) FROM part WHERE p_brand = 'Brand#12')")
def node_lookup(spark, sf):
    n = nodes(spark, sf).withColumns({"full_name": F.col("name"), "language": F.lit("python")})
    name = n.filter("file = 'Brand#12'").agg(F.min("name")).first()[0]
    return N.node_lookup(n, name=name, file="Brand#12", language="python").select("id")


@query(f"""WITH RECURSIVE {EDGES_SQL}, s AS (SELECT min(src) AS id FROM e), d(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.dst, depth + 1 FROM d JOIN e ON e.src = d.id WHERE depth < 2),
u(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.src, depth + 1 FROM u JOIN e ON e.dst = u.id WHERE depth < 2),
l(id) AS (SELECT p_partkey FROM part WHERE p_size <= 2 UNION SELECT e.dst FROM l JOIN e ON e.src = l.id)
SELECT id, direction, min(depth) AS depth, id IN (SELECT id FROM l) AS reachable FROM (SELECT id, 'callee' AS direction, depth FROM d UNION ALL SELECT id, 'caller', depth FROM u)
GROUP BY id, direction HAVING min(depth) > 0""")
def call_neighbourhood(spark, sf):
    e = edges(spark, sf)
    start = e.agg(F.min("src")).first()[0]
    return G.call_neighbourhood(nodes(spark, sf), e, start, entries=read_table(spark, sf, "part").filter("p_size <= 2").select(F.col("p_partkey").alias("id")))


@query("SELECT DISTINCT 'c' || s_nationkey AS child, 'r' || n_regionkey AS parent FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def attribute_hierarchy(spark, sf):
    """Suppliers as classes with an ``extends:`` attribute."""
    s = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    mark = F.concat(F.lit("extends:r"), F.col("n_regionkey").cast("string"))
    n = s.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_name").alias("full_name"), F.lit("class").alias("kind"),
        F.lit(None).cast("long").alias("parent_id"), F.array(mark, F.lit("sealed")).alias("attributes"),
    )
    return G.attribute_hierarchy(n)[0]


@query("""WITH t AS (SELECT l_orderkey AS call_id, 'b' || p_brand AS owner, p_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT DISTINCT 'b' || p_brand AS owner FROM part WHERE p_size >= 45), r AS (SELECT DISTINCT o_orderkey AS call_id, 'bBrand#12' AS owner FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT call_id, owner, target FROM t WHERE owner IN (SELECT owner FROM m) AND (call_id NOT IN (SELECT call_id FROM r) OR owner = 'bBrand#12')""")
def resolved_calls(spark, sf):
    """Orders as virtual calls, brands as owners, urgent orders with a known receiver."""
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("target"), F.concat(F.lit("b"), F.col("p_brand")).alias("owner"), "p_size")
    calls = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("target")).join(part, "target")
    known = read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("call_id"), F.lit("bBrand#12").alias("class"))
    return N.resolve_one(calls.select("call_id", "owner", "target"), part.filter("p_size >= 45").select(F.col("owner").alias("class")), known)


# -- entries and names --------------------------------------------------------------------

_PATHS = Literal("paths", "path string", (("./src/Brand#12.py",), ("Brand#13.py",), ("/app/src/Brand#21.py",), ("#22.py",), ("Brand#31.py.bak",)))


def _files(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit(".py")).alias("file"), F.col("p_name").alias("name"), "p_size"
    )


@query(f"""WITH {_PATHS.sql}, p AS (SELECT regexp_replace(path, '^(\\./)+', '') AS p FROM paths), f AS (SELECT p_partkey AS id, 'src/' || p_brand || '.py' AS f FROM part)
SELECT id FROM f WHERE EXISTS (SELECT 1 FROM p WHERE f = p OR ends_with(f, '/' || p) OR ends_with(p, '/' || f))""")
def file_entries(spark, sf):
    return E.file_entries(_files(spark, sf), _PATHS.df(spark))


@query("SELECT p_partkey AS id FROM part WHERE regexp_replace(p_name, '[^a-z]', '', 'g') IN (SELECT regexp_replace(p_name, '[^a-z]', '', 'g') FROM part WHERE p_size = 1)")
def named_by_attributes(spark, sf):
    mark = F.when(F.col("p_size") == 1, F.concat(F.lit('#[serde(default = "a::b::'), F.regexp_replace("name", "[^a-z]", ""), F.lit('")]')))
    n = _files(spark, sf).select("id", F.regexp_replace("name", "[^a-z]", "").alias("name"), F.filter(F.array(mark, F.lit("#[inline]")), lambda x: x.isNotNull()).alias("attributes"))
    return E.named_by_attributes(n)


_IMPLS = Literal("impls", "file string, trait string, type string, line_start int, line_end int", (("Brand#12", "Show", "A", 10, 30), ("Brand#12", None, "A", 31, 40), ("Brand#21", "From", "B", 1, 5)))


@query(f"WITH {_IMPLS.sql} SELECT p_partkey AS id FROM part WHERE EXISTS (SELECT 1 FROM impls i WHERE i.trait IS NOT NULL AND i.file = p_brand AND p_size BETWEEN i.line_start AND i.line_end) OR p_size = 50")
def implementations(spark, sf):
    """Sizes as lines, brands as files; size 50 overrides."""
    n = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("line_start"),
        F.when(F.col("p_size") == 50, F.array(F.lit("@Override"))).otherwise(F.array().cast("array<string>")).alias("attributes"),
    )
    return E.implementations(n, _IMPLS.df(spark))


@query("SELECT c_custkey::VARCHAR AS name, 'o' || o_orderpriority AS importer, min('n' || c_nationkey) AS exporter FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def import_links(spark, sf):
    exports = read_table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"))
    imports = read_table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.concat(F.lit("o"), F.col("o_orderpriority")).alias("file"))
    return N.import_links(exports, imports)


@query("""SELECT l_orderkey AS caller_id, l_partkey::VARCHAR AS callee_name, l_linenumber,
CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 0 END + CASE WHEN l_quantity >= 25 THEN 10 ELSE 0 END AS priority FROM lineitem""")
def call_priorities(spark, sf):
    calls = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("caller_id"), F.col("l_partkey").cast("string").alias("callee_name"), "l_linenumber", (F.col("l_returnflag") == "R").alias("reachable"),
        F.when(F.col("l_linestatus") == "O", "m").alias("source_module"), F.when(F.col("l_quantity") < 25, "a").alias("imported_as"),
    )
    return N.call_priority(calls).select("caller_id", "callee_name", "l_linenumber", "priority")


_FACTS = Literal("facts", "file string, language string, tag string, name string, owner string, line int, line_end int, detail string, module string", (
    ("web/app.ts", "typescript", "import", "draw", "", 1, 1, None, "./lib"), ("web/app.ts", "typescript", "import", "shape", "", 2, 2, "s", "./lib/index"),
    ("web/lib/index.ts", "typescript", "reexport", "paint", "", 1, 1, "draw", "./paint"), ("web/lib/index.ts", "typescript", "reexport", "*", "", 2, 2, None, "./shapes"),
    ("web/lib/paint.ts", "typescript", "function", "paint", "", 1, 3, "public", None), ("web/lib/shapes.ts", "typescript", "function", "shape", "", 1, 3, "public", None),
    ("pkg/a.py", "python", "import", "run", "", 1, 1, None, ".sub.b"), ("pkg/sub/b.py", "python", "function", "run", "", 1, 2, "public", None),
    ("src/main.rs", "rust", "import", "go", "", 1, 1, None, "crate::util"), ("src/util.rs", "rust", "function", "go", "", 1, 2, "public", None),
))
_TARGETS = Literal("want", "file string, local string, imported string, module_file string", (
    ("web/app.ts", "draw", "draw", "web/lib/index.ts"), ("web/app.ts", "draw", "paint", "web/lib/paint.ts"), ("web/app.ts", "draw", "draw", "web/lib/shapes.ts"),
    ("web/app.ts", "s", "shape", "web/lib/index.ts"), ("web/app.ts", "s", "shape", "web/lib/shapes.ts"), ("pkg/a.py", "run", "run", "pkg/sub/b.py"), ("src/main.rs", "go", "go", "src/util.rs"),
))


@query(f"WITH {_TARGETS.sql} SELECT * FROM want WHERE NOT (module_file = 'web/lib/shapes.ts' AND local = 'draw')")
def import_targets(spark, sf):
    """Relative, dotted and crate paths, and one hop through a barrel: its own name before ``*``."""
    facts = _FACTS.df(spark).withColumn("items", F.array("module")).drop("module")
    return N.import_targets(facts)


@query("""WITH f AS (SELECT p_partkey AS id, 'd/' || p_name || '.' || CASE p_size % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'TSX' WHEN 2 THEN 'rs' WHEN 3 THEN 'hpp' ELSE 'xyz' END AS file, p_size AS size FROM part)
SELECT CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'hpp' THEN 'cpp' END AS language, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1""")
def files_by_language(spark, sf):
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "TSX", "rs", "hpp", "xyz")]), F.col("p_size") % 5 + 1)
    f = read_table(spark, sf, "part").select(F.concat(F.lit("d/"), F.col("p_name"), F.lit("."), ext).alias("file"), F.col("p_size").alias("size"))
    return code.by_language(f.withColumn("language", T.language_of(F.col("file"))))


# -- findings and reports -----------------------------------------------------------------


def _rows(spark, sf):
    return read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.lit("R").alias("rule_id"), F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "medium", "low", "info")]), F.col("p_size") % 5 + 1).alias("severity"),
        F.element_at(F.array(*[F.lit(x) for x in ("certain", "high", "medium", "low")]), F.col("p_size") % 4 + 1).alias("confidence"), F.col("p_name").alias("title"),
        F.concat(F.lit("a/"), F.when(F.col("p_size") % 7 == 0, "tests/").otherwise(""), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, ".sh").otherwise(".py")).alias("file"),
        F.when(F.col("p_size") % 3 == 0, "bash").otherwise("python").alias("language"), F.col("p_size").alias("line_start"), (F.col("p_size") + 2).alias("line_end"), F.col("p_size").alias("loc"),
        F.when(F.col("p_size") % 11 == 0, "test_only_code").otherwise("dead_function").alias("finding_type"),
    )


_ROWS = """f AS (SELECT p_partkey AS id, (['critical', 'high', 'medium', 'low', 'info'])[p_size % 5 + 1] AS severity, (['certain', 'high', 'medium', 'low'])[p_size % 4 + 1] AS confidence, p_name AS title,
 'a/' || CASE WHEN p_size % 7 = 0 THEN 'tests/' ELSE '' END || p_brand || CASE WHEN p_size % 3 = 0 THEN '.sh' ELSE '.py' END AS file, CASE WHEN p_size % 3 = 0 THEN 'bash' ELSE 'python' END AS language,
 p_size AS line_start, p_size + 2 AS line_end, p_size AS loc, CASE WHEN p_size % 11 = 0 THEN 'test_only_code' ELSE 'dead_function' END AS finding_type FROM part)"""


@query(f"WITH {_ROWS} SELECT id FROM f WHERE loc >= 4 AND confidence IN ('certain', 'high', 'medium') AND language = 'python' AND file NOT LIKE '%.sh' AND file NOT LIKE 'a/tests/%' AND finding_type <> 'test_only_code'")
def filtered_findings(spark, sf):
    """All post filters at once."""
    kept = A.filter_findings(_rows(spark, sf), min_confidence="medium", min_lines=4, languages=["python"], known_languages={"python", "bash"}, drop_tests=True)
    return kept.select("id")


@query(f"WITH {_ROWS} SELECT id FROM f WHERE file = 'a/Brand#12.py' OR file = 'a/tests/Brand#13.py' OR ends_with('/x/a/Brand#21.py', '/' || file) OR ends_with(file, '/Brand#33.sh')")
def findings_of_diff(spark, sf):
    changed = spark.createDataFrame([("a/Brand#12.py",), ("tests/Brand#13.py",), ("/x/a/Brand#21.py",), ("Brand#33.sh",)], "path string")
    return A.diff_filter(_rows(spark, sf), changed).select("id")


@query(f"""WITH {_ROWS} SELECT id, '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || line_start || '::' || title AS line,
'[' || upper(severity) || '] ' || file || ':' || line_start || ' ' || title || ' (R)' AS "text" FROM f""")
def report_lines(spark, sf):
    return _rows(spark, sf).select("id", sinks.annotation().alias("line"), sinks.text_line().alias("text"))


@query(f"WITH {_ROWS} SELECT severity, confidence, count(*) AS n, count(DISTINCT file) AS files FROM f GROUP BY ALL")
def report_summary(spark, sf):
    return sinks.summary(_rows(spark, sf))


@query(f"""WITH {_ROWS} SELECT title, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, file AS uri, line_start AS start, line_end AS "end", line_start + 1 AS related FROM f""")
def sarif_results(spark, sf):
    """Results of the report, read back from their JSON."""
    related = F.array(F.struct(F.col("file"), (F.col("line_start") + 1).alias("line_start"), F.col("line_end")))
    value = sinks.sarif_results(_rows(spark, sf).withColumns({"related": related, "fix": F.lit("remove it")}))
    at = lambda p: F.get_json_object("value", "$." + p)
    region = "locations[0].physicalLocation.region"
    return value.select(
        at("message.text").alias("title"), at("level").alias("level"), at("locations[0].physicalLocation.artifactLocation.uri").alias("uri"),
        at(f"{region}.startLine").cast("int").alias("start"), at(f"{region}.endLine").cast("int").alias("end"), at("relatedLocations[0].physicalLocation.region.startLine").cast("int").alias("related"),
    )


@query("""WITH i AS (SELECT l_suppkey AS group_id, l_orderkey AS file, l_linenumber AS a, (l_linenumber + l_quantity)::INT AS z FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY file, a, z) AS r, count(*) OVER (PARTITION BY group_id) AS n FROM i)
SELECT group_id, min(z - a + 1) * (any_value(n) - 1) AS duplicated_lines FROM o o1 WHERE (file, a) = (SELECT (file, a) FROM o o2 WHERE o2.group_id = o1.group_id AND r = 1) GROUP BY group_id HAVING count(DISTINCT z) = 1""")
def duplicated_lines(spark, sf):
    """Groups whose first instance is one."""
    i = read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("group_id"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end_line")
    )
    first = i.groupBy("group_id").agg(F.min(F.struct("file", "start_line")).alias("m"))
    single = i.join(first, "group_id").filter((F.col("file") == F.col("m.file")) & (F.col("start_line") == F.col("m.start_line"))).groupBy("group_id").agg(F.countDistinct("end_line").alias("k")).filter("k = 1")
    return S.duplicated_lines(i.join(single, "group_id", "left_semi"))


@query("""WITH o AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_discount) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), n AS (SELECT l_orderkey AS a, l_partkey AS b, max(l_tax) AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT a, b, CASE WHEN coalesce(o.s >= 0.05, FALSE) AND NOT coalesce(n.s >= 0.05, FALSE) THEN 'diverged' WHEN NOT coalesce(o.s >= 0.05, FALSE) AND coalesce(n.s >= 0.05, FALSE) THEN 'converged' ELSE 'unchanged' END AS event
FROM o FULL OUTER JOIN n USING (a, b)""")
def pair_evolution(spark, sf):
    l = read_table(spark, sf, "lineitem")
    side = lambda rows, c: rows.groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.max(c).alias("similarity"))
    return S.pair_evolution(side(l.filter("l_returnflag = 'R'"), "l_discount"), side(l.filter("l_linestatus = 'O'"), "l_tax"), threshold=0.05)


# -- text and rules -----------------------------------------------------------------------

_SCAFFOLD = Literal("want", "file string, line_no int, category string", (
    ("app/jobs.py", 2, "step_progress"), ("app/jobs.py", 3, "scaffolding_name"), ("app/jobs.py", 4, "placeholder"), ("app/jobs.py", 6, "scaffolding_name"), ("app/jobs.py", 7, "placeholder"),
    ("app/jobs.py", 10, "debug_print"), ("app/jobs.py", 11, "todo"), ("web/page.js", 1, "framework_default"), ("web/page.js", 2, "scaffolding_name"), ("web/page.js", 3, "debug_print"),
    ("web/page.js", 4, "placeholder"), ("tests/test_jobs.py", 3, "placeholder"),
))


def _sources(spark):
    return spark.createDataFrame([(f, lang, s) for (f, lang), s in SOURCES.items()], "file string, language string, source string")


@query(f"WITH {_SCAFFOLD.sql} SELECT * FROM want")
def scaffolding(spark, sf):
    """Line rules over literal sources: names, placeholders, prints, progress, defaults."""
    return R.line_findings(_sources(spark), todo=True).select("file", "line_no", "category")


_FLAGGED = Literal("want", "file string, flag_type string, name string, line_start int, line_end int, always_dead boolean", (
    ("a.c", "ifdef", "X", 1, 5, False), ("a.c", "if_zero", "0", 2, 3, True), ("a.rs", "rust_feature", "fast", 1, 4, False), ("b.py", "if_false", "False", 1, 3, True), ("b.py", "environ", "MODE", 4, 5, False), ("b.py", "environ", "HOME", 6, 6, False),
))


@query(f"WITH {_FLAGGED.sql} SELECT * FROM want")
def flag_blocks(spark, sf):
    rows = [
        ("a.c", "c", "#ifdef X\n#if 0\nint a;\n#endif\nint b;\n#else\nint c;\n#endif\n"), ("a.rs", "rust", '#[cfg(feature = "fast")]\nfn f() {\n    g();\n}\nfn h() {}\n'),
        ("b.py", "python", "if False:\n    a()\n    b()\nif os.environ.get('MODE'):\n    c()\nx = os.environ['HOME']\n"),
    ]
    return R.flag_blocks(spark.createDataFrame(rows, "file string, language string, source string"))


_RULED = Literal("want", "rule_id string, file string, line_start int", (
    ("SEC003", "a.py", 1), ("SEC003-TS", "a.py", 1), ("SEC004", "a.py", 2), ("SEC006", "a.py", 3), ("SEC006-TS", "a.py", 3), ("SEC007", "a.py", 4), ("SEC002", "b.js", 1), ("SEC002-TS", "b.js", 1),
    ("IAC-DOCKER-001", "Dockerfile", 1), ("IAC-DOCKER-002", "Dockerfile", 1), ("IAC-TF-001", "m.tf", 1), ("IAC-K8S-001", "k.yaml", 1),
))


@query(f"WITH {_RULED.sql} SELECT * FROM want")
def built_in_rules(spark, sf):
    rows = [
        ("a.py", "python", "os.system(cmd)\napi_key = 'abcdefgh1234'\nx = pickle.loads(b)\nh = hashlib.md5(b)\n"), ("b.js", "javascript", "el.innerHTML = x;\n"), ("Dockerfile", "docker", "FROM base:latest AS b\n"),
        ("m.tf", "terraform", 'acl = "public-read"\n'), ("k.yaml", "yaml", "privileged: true\n"), ("none.py", "python", "x = 1\n"),
    ]
    return U.apply_rules(spark.createDataFrame(rows, "file string, language string, source string")).select("rule_id", "file", "line_start")


_TEMP = Literal("want", "file string, kind string", (
    ("a/PROGRESS.md", "temp_file_delivery"), ("tmp_x.py", "temp_file_prefix"), ("b/x_old.py", "temp_file_suffix"), ("x.orig", "temp_file_suffix"), ("phase_2.py", "temp_file_phased"), ("do_week1.py", "temp_file_temporal"),
    ("stub_a.go", "temp_file_scaffold"), ("x_v2.py", "temp_file_numbered"), ("plain.py", None),
))


@query(f"WITH {_TEMP.sql} SELECT * FROM want")
def temp_files(spark, sf):
    return _TEMP.df(spark).select("file", R.temp_file_kind(F.col("file")).alias("kind"))


_SPLIT = Literal("names", "name string, parts string", (("getUserName", "get,user,name"), ("snake_case_x", "snake,case"), ("HTTPServer", "httpserver"), ("a", ""), ("Phase2Run", "phase2,run")))


@query(f"WITH {_SPLIT.sql} SELECT * FROM names")
def identifier_parts(spark, sf):
    return _SPLIT.df(spark).select("name", F.array_join(T.split_identifier(F.col("name")), ",").alias("parts"))


_CODE = Literal("code", "id int, source string, tokens string", (
    (1, "x = foo(1, 'a')", "$ID = $ID ( $NUM , $STR )"), (2, "if a1 >= 2.5: return \"s\"", "if $ID > = $NUM : return $STR"), (3, "", ""), (4, "def f(self): pass", "def $ID ( $ID ) : $ID"),
))


@query(f"WITH {_CODE.sql} SELECT id, tokens FROM code")
def normal_tokens(spark, sf):
    return _CODE.df(spark).select("id", F.array_join(C.normal_tokens(F.col("source")), " ").alias("tokens"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.vec_id, y.vec_id))::INT AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id * 2 + 1")
def bit_distance(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"))
    return v.select("a", (F.col("a") * 2 + 1).alias("b")).join(v.select(F.col("a").alias("b")), "b").select("a", "b", T.hamming(F.col("a"), F.col("b")).alias("distance"))


@query("SELECT doc_id, TRUE AS near FROM documents WHERE len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) > 2 AND len(regexp_extract_all(lower(text), '[a-z0-9_]+')) >= 3")
def theta_sketches(spark, sf):
    """Distinct grams of documents from sketches, within five percent of the exact count."""
    made = S.document_sketches(read_table(spark, sf, "documents"))
    near = F.abs(F.col("distinct") - F.col("grams")) <= 0.05 * F.col("grams") + 1
    return made.filter("words > 2").select("doc_id", near.alias("near"))


# -- end to end over literal sources ------------------------------------------------------

#: Files whose dead code is known: trait methods, re-exports, attributes, a test, plain dead code.
PROJECT = {
    ("src/lib.rs", "rust"): (
        "pub trait Check {\n    fn check(&self) -> bool;\n}\nstruct User;\nimpl Check for User {\n    fn check(&self) -> bool { true }\n}\nimpl User {\n    fn spare(&self) {}\n}\n"
        "#[serde(default = \"defaults::port\")]\nstruct Conf;\nfn port() -> u16 { 1 }\nfn unused() {}\nfn main() {\n    helper();\n}\nfn helper() {}\n"
    ),
    ("pkg/__init__.py", "python"): "from .core import offered\n",
    ("pkg/core.py", "python"): "__all__ = ['listed']\n\ndef offered():\n    return inner()\n\ndef inner():\n    return 1\n\ndef listed():\n    pass\n\ndef forgotten():\n    return inner()\n",
    ("tests/test_core.py", "python"): "from pkg.core import inner\n\ndef test_inner():\n    assert inner() == 1\n",
}
_DEAD = Literal("want", "file string, name string", (("src/lib.rs", "spare"), ("src/lib.rs", "unused"), ("pkg/core.py", "forgotten")))
_FOUND = Literal("want", "file string, name string, reason string", (
    ("src/lib.rs", "main", "rule"), ("src/lib.rs", "check", "implementation"), ("src/lib.rs", "port", "attribute"), ("pkg/core.py", "offered", "re-export"), ("pkg/core.py", "listed", "re-export"),
))


def _project(spark):
    facts = code.extract(spark.createDataFrame([(f, lang, t) for (f, lang), t in PROJECT.items()], "file string, language string, source string"))
    return facts, code.code_nodes(facts).filter("kind <> 'class' and line_end >= line_start")


@query(f"WITH {_FOUND.sql} SELECT * FROM want")
def detected_entries(spark, sf):
    facts, n = _project(spark)
    found = E.detect(n, facts, blocks=code.impl_blocks(facts)).join(n.select("id", "file", "name", "line_start"), "id")
    return found.filter("not (name = 'check' and line_start = 2)").select("file", "name", "reason")


@query(f"WITH {_DEAD.sql} SELECT * FROM want")
def dead_names(spark, sf):
    """Extraction, resolution, entries and reachability in one."""
    facts, n = _project(spark)
    seeds = E.detect(n, facts, blocks=code.impl_blocks(facts)).select("id").union(R.entry_points(n).filter("is_test_entry").select("id"))
    dead = G.unreachable(n, N.resolve_calls(facts, n).select("src", "dst"), seeds)
    return dead.filter("not (name = 'check' and line_start = 2)").select("file", "name")


_METHODS = Literal("want", "full_name string, kind string, line_start int, line_end int", (
    ("Check", "class", 1, 3), ("User", "class", 4, 4), ("Conf", "class", 12, 12), ("Check.check", "method", 2, 2), ("User.check", "method", 6, 6), ("User.spare", "method", 9, 9),
    ("port", "function", 13, 13), ("unused", "function", 14, 14), ("main", "function", 15, 17), ("helper", "function", 18, 18),
))


@query(f"WITH {_METHODS.sql} SELECT * FROM want")
def extracted_nodes(spark, sf):
    facts, _ = _project(spark)
    return code.code_nodes(facts).filter("language = 'rust'").select("full_name", "kind", "line_start", "line_end")


_CALLS = Literal("want", "file string, owner string, name string", (("src/lib.rs", "main", "helper"), ("pkg/core.py", "offered", "inner"), ("pkg/core.py", "forgotten", "inner"), ("tests/test_core.py", "test_inner", "inner")))


@query(f"WITH {_CALLS.sql} SELECT * FROM want")
def extracted_calls(spark, sf):
    facts, _ = _project(spark)
    return facts.filter("tag = 'call' and name <> 'serde'").select("file", "owner", "name")


_IMPORTS = Literal("want", "file string, name string, module string", (("pkg/__init__.py", "offered", ".core"), ("tests/test_core.py", "inner", "pkg.core")))


@query(f"WITH {_IMPORTS.sql} SELECT * FROM want")
def extracted_imports(spark, sf):
    facts, _ = _project(spark)
    return facts.filter("tag = 'import'").select("file", "name", F.get("items", F.lit(0)).alias("module"))


_RESOLVED = Literal("want", "src string, dst string, confidence string", (
    ("main", "helper", "certain"), ("offered", "inner", "certain"), ("forgotten", "inner", "certain"), ("test_inner", "inner", "high"),
))


@query(f"WITH {_RESOLVED.sql} SELECT * FROM want")
def resolved_edges(spark, sf):
    facts, n = _project(spark)
    names = n.select(F.col("id"), "name")
    e = N.resolve_calls(facts, n)
    return e.join(names.withColumnsRenamed({"id": "src", "name": "s"}), "src").join(names.withColumnsRenamed({"id": "dst", "name": "d"}), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "confidence")
