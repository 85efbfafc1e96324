"""Registered queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions import text as T
from marquetry.operators import findings as A
from marquetry.operators import flow as D
from marquetry.operators import graph as G
from marquetry.operators import similarity as S
from marquetry.operators import textrules as R
from marquetry.plans.adapters import EDGES_SQL, HIERARCHY_SQL, NODES_SQL, REACH_SQL, edges, hierarchy, nodes, seeds
from marquetry.runtime import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- graph -----------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {EDGES_SQL}, {NODES_SQL}, {REACH_SQL}
SELECT n.id, n.name, CASE WHEN n.id IN (SELECT id FROM test) THEN 'test_only_code' ELSE 'unreachable' END AS finding_type,
 CASE WHEN n.id IN (SELECT dst FROM e) THEN 'low' WHEN visibility = 'private' THEN 'certain' WHEN visibility = 'internal' THEN 'high' ELSE 'medium' END AS confidence
FROM n WHERE n.id NOT IN (SELECT id FROM prod)""")
def dead_parts(spark, sf):
    """Reachability, its complement, classification: the flagship query."""
    e, n = edges(spark, sf), nodes(spark, sf)
    found = G.reach(e, seeds(spark, sf))
    alive, tested = found.filter("kind = 'production'").select("id"), found.filter("kind = 'test'").select("id", F.lit(True).alias("t"))
    called = e.select(F.col("dst").alias("id"), F.lit(True).alias("c")).distinct()
    dead = n.join(alive, "id", "left_anti").join(tested, "id", "left").join(called, "id", "left")
    rated = dead.select(
        "*", F.coalesce("c", F.lit(False)).alias("has_callers"), F.coalesce("t", F.lit(False)).alias("test_only"), F.lit(0).alias("markers"),
        F.array().cast("array<string>").alias("attributes"), F.lit(None).cast("double").alias("centrality"), F.lit(None).cast("string").alias("documentation"),
    )
    return A.classify_dead(rated).select("id", "name", "finding_type", "confidence")


@query(f"WITH RECURSIVE {EDGES_SQL}, {REACH_SQL} SELECT id, 'production' AS kind FROM prod UNION ALL SELECT id, 'test' FROM test")
def reach_by_kind(spark, sf):
    return G.reach(edges(spark, sf), seeds(spark, sf)).select("id", "kind")


@query(ORACLES["reach_by_kind"])
def reach_by_kind_distributed(spark, sf):
    """The way of graphs that one task can't hold."""
    return G.reach(edges(spark, sf), seeds(spark, sf), local_edges=0).select("id", "kind")


@query(f"""WITH {EDGES_SQL} SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE dst = p_partkey) AS in_degree,
 (SELECT count(*) FROM e WHERE src = p_partkey) AS out_degree FROM part""")
def degrees(spark, sf):
    return G.degrees(nodes(spark, sf), edges(spark, sf))


@query(f"WITH {EDGES_SQL} SELECT p_partkey AS id, p_partkey NOT IN (SELECT dst FROM e) AS is_root, p_partkey NOT IN (SELECT src FROM e) AS is_leaf FROM part")
def roots_and_leaves(spark, sf):
    return G.roots_and_leaves(nodes(spark, sf), edges(spark, sf))


@query(f"""WITH RECURSIVE {EDGES_SQL}, b(id, depth) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 10)
SELECT id, p_brand AS file, min(depth) AS depth, 'downstream' AS direction FROM b JOIN part ON p_partkey = id GROUP BY id, p_brand HAVING min(depth) > 0""")
def blast_radius(spark, sf):
    e = edges(spark, sf)
    return G.blast_radius(nodes(spark, sf), e, e.agg(F.min("src").alias("id")))


_ROUND = "SELECT p_partkey AS id, (0.15 / c) + 0.85 * (coalesce(g.s, 0) + (SELECT coalesce(sum(score), 0) FROM {0} WHERE id NOT IN (SELECT src FROM e)) / c) AS score FROM part, cnt LEFT JOIN (SELECT e.dst, sum({0}.score / o.n) AS s FROM {0} JOIN e ON e.src = {0}.id JOIN o ON o.src = e.src GROUP BY e.dst) g ON g.dst = p_partkey"


@query(f"""WITH {EDGES_SQL}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), cnt AS (SELECT count(*) AS c FROM part),
r0 AS (SELECT p_partkey AS id, 1.0 / c AS score FROM part, cnt), r1 AS ({_ROUND.format('r0')}), r2 AS ({_ROUND.format('r1')}), r3 AS ({_ROUND.format('r2')})
SELECT id, round(score, 9) AS score FROM r3""")
def pagerank_3(spark, sf):
    return G.pagerank(nodes(spark, sf), edges(spark, sf), rounds=3).select("id", F.round("score", 9).alias("score"))


@query(ORACLES["pagerank_3"])
def pagerank_3_distributed(spark, sf):
    return G.pagerank(nodes(spark, sf), edges(spark, sf), rounds=3, local_edges=0).select("id", F.round("score", 9).alias("score"))


@query()
def pagerank(spark, sf):
    """All hundred rounds."""
    return G.pagerank(nodes(spark, sf), edges(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, w(a, b) AS (SELECT src, dst FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b)
SELECT p_partkey AS id, least(p_partkey, coalesce((SELECT min(w.b) FROM w JOIN w v ON v.a = w.b AND v.b = w.a WHERE w.a = p_partkey), p_partkey)) AS component FROM part""")
def strong_components(spark, sf):
    return G.strongly_connected(nodes(spark, sf), edges(spark, sf))


@query(ORACLES["strong_components"])
def strong_components_distributed(spark, sf):
    return G.strongly_connected(nodes(spark, sf), edges(spark, sf), local_edges=0)


@query(f"""WITH {EDGES_SQL}, d AS (SELECT p_partkey AS id, (SELECT count(*) FROM e WHERE dst = p_partkey)::DOUBLE AS i, (SELECT count(*) FROM e WHERE src = p_partkey)::DOUBLE AS o FROM part),
m AS (SELECT id, ((rank() OVER (ORDER BY i) - 1) / count(*) OVER () + (rank() OVER (ORDER BY o) - 1) / count(*) OVER ()) / 2 AS p FROM d)
SELECT id, round(p, 9) AS percentile, CASE WHEN p >= 0.95 THEN 'critical' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.2 THEN 'normal' ELSE 'low' END AS importance FROM m""")
def importance_by_degree(spark, sf):
    d = G.degrees(nodes(spark, sf), edges(spark, sf)).select("id", F.col("in_degree").cast("double").alias("pagerank"), F.col("out_degree").cast("double").alias("betweenness"))
    return G.importance(d).select("id", F.round("percentile", 9).alias("percentile"), "importance")


@query()
def betweenness(spark, sf):
    return G.betweenness(nodes(spark, sf), edges(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query()
def importance(spark, sf):
    """Classes of nodes by PageRank and betweenness."""
    e, n = edges(spark, sf), nodes(spark, sf)
    scores = G.pagerank(n, e).select("id", F.round("score", 9).alias("pagerank")).join(
        G.betweenness(n, e).select("id", F.round("score", 9).alias("betweenness")), "id"
    )
    return G.importance(scores).select("id", F.round("percentile", 9).alias("percentile"), "importance")


@query(f"""WITH RECURSIVE {EDGES_SQL}, lo AS (SELECT min(src) AS s FROM e),
b(id, depth) AS (SELECT s, 0 FROM lo UNION SELECT e.dst, depth + 1 FROM b JOIN e ON e.src = b.id WHERE depth < 6),
far AS (SELECT id, min(depth) AS d FROM b GROUP BY id ORDER BY d DESC, id LIMIT 1),
p(path, last, depth) AS (SELECT [s], s, 0 FROM lo UNION ALL SELECT list_append(path, e.dst), e.dst, depth + 1 FROM p JOIN e ON e.src = p.last WHERE depth < 6 AND NOT list_contains(path, e.dst))
SELECT array_to_string(path, '>') AS path, depth FROM p JOIN far ON last = far.id AND depth = far.d ORDER BY p.path LIMIT 3""")
def trace_paths(spark, sf):
    e = edges(spark, sf)
    low = e.agg(F.min("src")).first()[0]
    far = G.reach(e, spark.range(low, low + 1), max_depth=6).orderBy(F.desc("depth"), "id").first()["id"]
    return G.trace_paths(e, low, far).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


@query(f"""WITH {EDGES_SQL}, l AS (SELECT src, list(dst ORDER BY dst) AS t FROM e GROUP BY src)
SELECT src, coalesce(sum(len(t)) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", array_to_string(t, ',') AS targets FROM l""")
def csr_adjacency(spark, sf):
    return G.csr(edges(spark, sf)).select("src", F.col("offset").cast("long").alias("offset"), F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query(f"""WITH RECURSIVE {HIERARCHY_SQL}, c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT c.child, h.parent, depth + 1 FROM c JOIN h ON h.child = c.ancestor)
SELECT * FROM c""")
def hierarchy_closure(spark, sf):
    return G.closure(hierarchy(spark, sf))


@query("""SELECT 'r' || n_regionkey AS receiver, count(*) AS n_targets FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 GROUP BY 1""")
def virtual_targets(spark, sf):
    """Class-hierarchy analysis: regions as receivers, rich suppliers as overriding types."""
    sub = G.closure(hierarchy(spark, sf)).select("child", "ancestor")
    s = read_table(spark, sf, "supplier").filter("s_acctbal > 5000")
    methods = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("class"), F.lit("m").alias("name"))
    calls = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("call_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("receiver"), F.lit("m").alias("method"))
    hit = G.virtual_targets(calls, sub, methods)
    return hit.groupBy(F.concat(F.lit("r"), F.col("call_id").cast("string")).alias("receiver")).agg(F.count(F.lit(1)).alias("n_targets"))


@query()
def rapid_types(spark, sf):
    """Rapid type analysis: brands as types, large parts instantiate theirs."""
    part, e = read_table(spark, sf, "part"), edges(spark, sf)
    methods = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class"), F.col("p_name").alias("name"))
    made = part.filter("p_size >= 45").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class"))
    direct = e.filter("src < dst")
    return G.rapid_types(direct, seeds(spark, sf).filter("kind = 'production'").select("id"), e.filter("src > dst").select("src", F.col("dst").alias("target")), made, methods)


@query(f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT p_brand) FROM part) AS files,
 (SELECT sum(p_size) FROM part)::BIGINT AS loc, round((SELECT avg(p_size) FROM part), 6) AS avg_loc, round((SELECT count(*) FROM e) / (SELECT count(*) FROM part), 6) AS avg_degree""")
def graph_stats(spark, sf):
    s = G.graph_stats(nodes(spark, sf), edges(spark, sf))
    return s.select("nodes", "edges", "files", "loc", F.round("avg_loc", 6).alias("avg_loc"), F.round("avg_degree", 6).alias("avg_degree"))


@query(f"""WITH {EDGES_SQL} SELECT src AS id, dst AS other, 'callee' AS direction FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand = b.p_brand
UNION ALL SELECT dst, src, 'caller' FROM e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand = b.p_brand""")
def compatible_neighbours(spark, sf):
    n = nodes(spark, sf).withColumnRenamed("file", "language")
    groups = n.select("language", F.col("language").alias("lang_group")).distinct()
    return G.neighbours(n, edges(spark, sf), groups)


# -- similarity ------------------------------------------------------------------------

_GRAMS = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 2], ' ') AS gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w))"""


@query(f"""WITH {_GRAMS}, n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (na.n + nb.n - shared), 9) AS jaccard FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.n + nb.n - shared) >= 0.8""")
def shingle_pairs(spark, sf):
    return S.overlap_pairs(S.document_codes(read_table(spark, sf, "documents"))).select("a", "b", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 9).alias("jaccard"))


@query(f"""WITH RECURSIVE {_GRAMS}, n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.n + nb.n - shared) >= 0.8),
s AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(id, other) AS (SELECT a, b FROM s UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.other)
SELECT id, least(id, min(other)) AS cluster FROM r GROUP BY id""")
def clone_clusters(spark, sf):
    return S.overlap_clusters(S.document_codes(read_table(spark, sf, "documents")))


@query()
def minhash_pairs(spark, sf):
    return S.lsh_pairs(S.minhash(read_table(spark, sf, "documents")))


@query(f"""WITH {_GRAMS}, b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(t[k:k + 2], ' ') AS gram FROM (SELECT item_id, t, unnest(range(1, len(t) - 1)) AS k FROM b)),
z AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n), 9) AS share FROM g JOIN i USING (gram) JOIN z USING (item_id) GROUP BY 1, 2""")
def contamination(spark, sf):
    items = S.document_grams(read_table(spark, sf, "benchmark"), id_col="item_id").withColumnRenamed("doc_id", "item_id")
    out = S.contamination(S.document_grams(read_table(spark, sf, "documents")), items)
    return out.select("doc_id", "item_id", "shared", F.round("share", 9).alias("share"))


@query(f"WITH {_GRAMS}, c AS (SELECT count(DISTINCT doc_id) AS n FROM g) SELECT gram, count(*) AS df FROM g, c GROUP BY gram, n HAVING count(*) > floor(n * 0.1)")
def stop_grams(spark, sf):
    return S.stop_grams(S.document_grams(read_table(spark, sf, "documents")), share=0.1)


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE length(term) > 1 GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM f JOIN d USING (term)),
z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM r GROUP BY 1)
SELECT doc_id, term, round(w / z, 7) AS weight FROM r JOIN z USING (doc_id)""")
def tf_idf(spark, sf):
    # The SQL counts the terms of texts without an id, and joins their rows away.
    weights = S.tf_idf(read_table(spark, sf, "documents")).filter("doc_id is not null")
    return weights.select("doc_id", "term", F.round("weight", 7).alias("weight"))


@query("""SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35""")
def cosine_pairs(spark, sf):
    v = read_table(spark, sf, "embeddings")
    return S.cosine_pairs(v, threshold=0.35, by="label", id_col="vec_id", vec_col="embedding").select("a", "b", F.round("similarity", 6).alias("similarity"))


def _spans(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("file"), (F.col("user_id") * 3).alias("start"), (F.col("user_id") * 3 + F.col("event_id") % 5).alias("end")
    )


@query("""WITH s AS (SELECT event_id AS id, event_type AS file, user_id * 3 AS a, user_id * 3 + event_id % 5 AS z FROM events)
SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.file = y.file AND x.id < y.id AND x.a <= y.z AND y.a <= x.z""")
def interval_overlaps(spark, sf):
    return S.interval_overlaps(_spans(spark, sf))


_HALF = "2024-01-16"


@query(f"""WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{_HALF}' GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{_HALF}' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.n IS NULL THEN 'appeared' WHEN b.n IS NULL THEN 'disappeared' WHEN a.n = b.n THEN 'unchanged' ELSE 'changed' END AS event
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def snapshot_events(spark, sf):
    """What each user did before and after a date, as two snapshots."""
    e = read_table(spark, sf, "events")
    count = lambda part: part.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    cut_at = F.lit(_HALF).cast("timestamp")
    return S.snapshot_events(count(e.filter(F.col("ts") < cut_at)), count(e.filter(F.col("ts") >= cut_at)), keys=["user_id", "event_type"], value="n")


@query("SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def hash_groups(spark, sf):
    return S.hash_groups(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h")), "h")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100")
def heavy_hitters(spark, sf):
    return S.heavy_hitters(read_table(spark, sf, "lineitem"), "l_partkey")


@query("SELECT event_type, TRUE AS distinct_within, TRUE AS median_within FROM events GROUP BY 1")
def sketches_within_bounds(spark, sf):
    """Sketch estimates against exact values: within 5 % of distinct and 5 % of rank."""
    e = read_table(spark, sf, "events").filter("value is not null")
    est = S.sketch_summary(e, key="user_id", value="value", by="event_type")
    j = e.join(est, "event_type").groupBy("event_type", "distinct", "median").agg(
        F.countDistinct("user_id").alias("exact"), F.avg((F.col("value") <= F.col("median")).cast("int")).alias("share")
    )
    return j.select("event_type", (F.abs(F.col("distinct") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("distinct_within"), F.col("share").between(0.45, 0.55).alias("median_within"))


# -- findings --------------------------------------------------------------------------

_CONF = "CASE WHEN p_size % 4 = 0 THEN 'certain' WHEN p_size % 4 = 1 THEN 'high' WHEN p_size % 4 = 2 THEN 'medium' ELSE 'low' END"
_SEV = "CASE WHEN p_size % 5 = 0 THEN 'critical' WHEN p_size % 5 = 1 THEN 'high' WHEN p_size % 5 = 2 THEN 'medium' WHEN p_size % 5 = 3 THEN 'low' ELSE 'info' END"


def _findings(spark, sf):
    return read_table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_CONF} AS confidence", f"{_SEV} AS severity", "p_brand AS file", "p_size AS loc", "p_size % 7 = 0 AS is_entry_point", "p_size % 11 = 0 AS in_test_file", "p_type AS language", "'dead_function' AS finding_type", "p_size AS line_start")


@query(f"""WITH f AS (SELECT p_partkey AS id, {_CONF} AS c, {_SEV} AS s, p_size % 7 = 0 AS ep, p_size % 11 = 0 AS tf FROM part),
v AS (SELECT id, CASE c WHEN 'certain' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.3 END AS c, CASE s WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.2 END AS s, ep, tf FROM f),
w AS (SELECT id, c, CASE WHEN tf THEN s * 0.5 ELSE s END AS s, ep FROM v), x AS (SELECT id, c, CASE WHEN ep THEN least(s * 1.2, 1.0) ELSE s END AS s FROM w)
SELECT id, round(((s * 0.6 + c * 0.4) * 10)::DOUBLE, 6) AS score FROM x""")
def priority_scores(spark, sf):
    return A.priority(_findings(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT p_brand AS file, count(*) AS n FROM part WHERE {_CONF} IN ('certain', 'high') AND p_size >= 10 GROUP BY 1 ORDER BY n DESC, file LIMIT 10")
def hotspots(spark, sf):
    return A.hotspots(A.filter_findings(_findings(spark, sf), min_confidence="high", min_lines=10), "file")


@query(f"SELECT p_partkey AS id, p_brand AS file, {_CONF} AS confidence FROM part ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 100")
def findings_page(spark, sf):
    rows, _ = A.page(_findings(spark, sf), [F.desc("loc"), F.col("id")], offset=100, limit=50)
    return rows.select("id", "file", "confidence")


@query("""WITH c AS (SELECT event_type AS category, count(*) AS actual FROM events GROUP BY 1)
SELECT category, 100 AS threshold, actual FROM c WHERE actual > 100 AND category IN ('click', 'purchase', 'view') """)
def threshold_violations(spark, sf):
    counts = read_table(spark, sf, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("actual"))
    return A.threshold_violations(counts, {"click": 100, "purchase": 100, "view": 100}).select("category", F.col("threshold").cast("int").alias("threshold"), "actual")


@query("""WITH t AS (SELECT doc_id, quality = 1 AS truth, toxic = 0 AS said FROM labels)
SELECT count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE NOT said AND truth) AS fn FROM t""")
def quality_metrics(spark, sf):
    l = read_table(spark, sf, "labels").withColumn("b", F.col("doc_id") + 1)
    said = l.filter("toxic = 0").select(F.col("doc_id").alias("a"), "b")
    return A.quality_metrics(said, l.select(F.col("b").alias("a"), F.col("doc_id").alias("b"), (F.col("quality") == 1).alias("is_clone"))).select("tp", "fp", "fn")


@query("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS distinct_texts, max(n_chars) AS longest FROM documents GROUP BY ALL")
def counts_by_language(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("distinct_texts"), F.max("n_chars").alias("longest"))


# -- data flow -------------------------------------------------------------------------


@query("""SELECT l_orderkey AS block, l_returnflag AS var, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN 'const' ELSE 'bottom' END AS tag,
 CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS val FROM lineitem GROUP BY 1, 2""")
def lattice_meet(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_returnflag").alias("var"), F.lit("const").alias("tag"), F.col("l_linestatus").alias("val"))
    return D.lattice_meet(rows, ["block", "var"])


_EVENTS = "(SELECT user_id AS func, event_type AS var, event_id AS pos, event_id % 3 = 0 AS is_def FROM events)"


@query(f"""WITH v AS {_EVENTS} SELECT func, var, pos, CASE WHEN NOT EXISTS (SELECT 1 FROM v u WHERE u.func = d.func AND u.var = d.var AND NOT u.is_def AND u.pos > d.pos) THEN 'never_read' ELSE 'overwritten' END AS reason
FROM (SELECT *, lead(pos) OVER (PARTITION BY func, var ORDER BY pos) AS nxt FROM v WHERE is_def) d
WHERE NOT EXISTS (SELECT 1 FROM v u WHERE u.func = d.func AND u.var = d.var AND NOT u.is_def AND u.pos > d.pos)
 OR (nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v u WHERE u.func = d.func AND u.var = d.var AND NOT u.is_def AND u.pos > d.pos AND u.pos <= nxt))""")
def dead_stores(spark, sf):
    v = read_table(spark, sf, "events").select(F.col("user_id").alias("func"), F.col("event_type").alias("var"), F.col("event_id").alias("pos"), (F.col("event_id") % 3 == 0).alias("d"))
    return D.dead_stores(v.filter("d").drop("d"), v.filter("not d").drop("d"))


# -- text rules ------------------------------------------------------------------------


@query(r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
WHERE regexp_matches(line, '(?i)licensed under|released under')""")
def line_rule(spark, sf):
    lines = R.lines(read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("source")))
    return lines.filter(F.col("line").rlike(r"(?i)licensed under|released under")).select(F.col("file").cast("long").alias("doc_id"), "line_no", "line")


@query("""WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM conversations)
SELECT x.conv_id, x.turn AS a, y.turn AS b FROM b x JOIN b y ON x.conv_id = y.conv_id AND x.turn < y.turn WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 0.15""")
def comment_clones(spark, sf):
    c = read_table(spark, sf, "conversations")
    return R.block_clones(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("block"), F.col("text").alias("text")), threshold=0.15).select(F.col("file").alias("conv_id"), "a", "b")


@query("SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic, count(*) AS n FROM labels")
def label_counts(spark, sf):
    return read_table(spark, sf, "labels").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("toxic"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS island, event_id FROM (SELECT user_id, event_id,
 CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) <= 200 THEN 0 ELSE 1 END AS b FROM events)""")
def gap_islands(spark, sf):
    """Gaps and islands, as comment lines are grouped into blocks."""
    return R.islands(read_table(spark, sf, "events").select("user_id", "event_id"), keys=["user_id"], order="event_id", gap=200).select("user_id", "island", "event_id")
