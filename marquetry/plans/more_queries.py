"""Further registered queries: fingerprints, types, slices, rules, ranges, windows, sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquetry.operators import clones as C
from marquetry.operators import findings as A
from marquetry.operators import flow as D
from marquetry.operators import graph as G
from marquetry.operators import resolve as N
from marquetry.operators import rules as U
from marquetry.operators import similarity as S
from marquetry.plans.adapters import EDGES_SQL, edges, nodes
from marquetry.plans.queries import ORACLES, query
from marquetry.runtime import read_table
from marquetry.streaming import incremental as I


@query("""WITH p AS (SELECT vec_id AS id, (list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END)) - CASE WHEN embedding[64] > 0 THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT AS h FROM embeddings),
g AS (SELECT h, min(id) AS rep FROM p GROUP BY h)
SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM g x JOIN g y ON x.rep < y.rep WHERE bit_count(xor(x.h, y.h)) <= 15
UNION ALL SELECT rep, id, 0 FROM p JOIN g USING (h) WHERE id <> rep""")
def fingerprint_pairs(spark, sf):
    """Hamming neighbours of sign fingerprints, by pigeonhole blocks."""
    return C.hamming_pairs(_sign_prints(spark, sf), 15)


def _sign_prints(spark, sf):
    v = read_table(spark, sf, "embeddings")
    bits = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(64)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return v.select(F.col("vec_id").alias("id"), total.cast("long").alias("simhash"))


_SIGNS = """(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END)) - CASE WHEN embedding[64] > 0 THEN 9223372036854775808::HUGEINT ELSE 0 END)::BIGINT"""


@query(f"""WITH p AS (SELECT vec_id AS id, {_SIGNS} AS h FROM embeddings), g AS (SELECT h, min(id) AS rep FROM p GROUP BY h)
SELECT x.rep AS a, y.rep AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM g x JOIN g y ON x.rep < y.rep WHERE bit_count(xor(x.h, y.h)) <= 20
UNION ALL SELECT rep, id, 0 FROM p JOIN g USING (h) WHERE id <> rep""")
def distant_fingerprints(spark, sf):
    """The same at 20 bits, where blocks select nothing and cells are compared."""
    return C.hamming_pairs(_sign_prints(spark, sf), 20)


@query(f"""WITH RECURSIVE {EDGES_SQL}, t("var", class) AS (SELECT p_partkey, p_brand FROM part WHERE p_size >= 45 UNION SELECT e.dst, t.class FROM t JOIN e ON e.src = t."var")
SELECT "var", class FROM t""")
def variable_types(spark, sf):
    made = read_table(spark, sf, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("var"), F.col("p_brand").alias("class"))
    return G.variable_types(made, edges(spark, sf))


@query(ORACLES["variable_types"])
def variable_types_distributed(spark, sf):
    made = read_table(spark, sf, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("var"), F.col("p_brand").alias("class"))
    return G.variable_types(made, edges(spark, sf), local_edges=0)


@query(f"""WITH RECURSIVE {EDGES_SQL}, s(block) AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT e.src FROM s JOIN e ON e.dst = s.block)
SELECT 'f' AS func, block FROM s""")
def backward_slice(spark, sf):
    pdg = edges(spark, sf).select(F.lit("f").alias("func"), "src", "dst", F.lit("control").alias("kind"), F.lit(None).cast("string").alias("var"))
    at = read_table(spark, sf, "part").filter("p_size = 50").select(F.lit("f").alias("func"), F.col("p_partkey").alias("block"))
    return D.slice_blocks(pdg, at)


_RULES = [
    {"id": "mail", "name": "mail address", "severity": "medium", "pattern": r"[a-z0-9._]+@[a-z0-9]+\.[a-z]{2,}", "cwe": None, "languages": [], "enabled": True},
    {"id": "number", "name": "long number", "severity": "low", "pattern": r"[0-9]{9,}", "cwe": None, "languages": [], "enabled": True},
]


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_start FROM documents)
SELECT doc_id, line_start, 'mail' AS rule_id FROM l WHERE regexp_matches(line, '[a-z0-9._]+@[a-z0-9]+\.[a-z]{2,}')
UNION ALL SELECT doc_id, line_start, 'number' FROM l WHERE regexp_matches(line, '[0-9]{9,}')""")
def rule_findings(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("lang").alias("language"), F.col("text").alias("source"))
    return U.apply_rules(d, _RULES).select(F.col("file").cast("long").alias("doc_id"), "line_start", "rule_id")


@query("SELECT c_custkey AS name, c_name AS file FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unused_exports(spark, sf):
    """Customers as exports, urgent orders as imports."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_name").alias("file"))
    return N.unused_exports(c, read_table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("name")))


@query("""WITH s AS (SELECT event_id AS id, event_type AS file, user_id * 3 AS a, user_id * 3 + event_id % 5 AS z FROM events),
p AS (SELECT DISTINCT event_type AS file, user_id * 3 + 2 AS line FROM events)
SELECT file, line, id AS span_id FROM (SELECT p.file, p.line, s.id, row_number() OVER (PARTITION BY p.file, p.line ORDER BY s.a DESC, s.z, s.id DESC) AS r
FROM p JOIN s ON p.file = s.file AND p.line BETWEEN s.a AND s.z) WHERE r = 1""")
def innermost_span(spark, sf):
    """The innermost of the spans around a line: calls and their functions."""
    e = read_table(spark, sf, "events")
    spans = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("file"), (F.col("user_id") * 3).alias("start"), (F.col("user_id") * 3 + F.col("event_id") % 5).alias("end"))
    points = e.select(F.col("event_type").alias("file"), (F.col("user_id") * 3 + 2).alias("line")).distinct()
    return S.containing(points, spans)


@query("SELECT l_returnflag AS confidence, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1")
def confidence_histogram(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("confidence")).distinct()
    return G.confidence_histogram(rows)


@query("""SELECT src, dst, min(rank) AS rank FROM (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS rank FROM lineitem) GROUP BY src, dst""")
def deduped_edges(spark, sf):
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("rank"))
    return G.dedupe_edges(rows)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, sf):
    """Tumbling windows, as the streaming counter keeps them."""
    return I.running_counts(read_table(spark, sf, "events"), "event_type", time_col="ts")


@query("""WITH g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts,
 CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events))
SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, s""")
def session_counts(spark, sf):
    return I.session_counts(read_table(spark, sf, "events"), "user_id", "ts", "6 hours")


@query("""WITH m AS (SELECT unnest([50.0, 100.0, 200.0]) AS threshold)
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE value >= threshold AND event_type = 'purchase') AS tp, count(*) FILTER (WHERE value >= threshold AND event_type <> 'purchase') AS fp,
 count(*) FILTER (WHERE value < threshold AND event_type = 'purchase') AS fn FROM events, m GROUP BY threshold""")
def threshold_sweep(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("is_clone"))
    return A.threshold_sweep(e, [50.0, 100.0, 200.0]).select("threshold", "tp", "fp", "fn")


@query("""WITH s AS (SELECT event_type AS file, user_id * 6 AS a, user_id * 6 + event_id % 5 AS z FROM events),
f AS (SELECT *, CASE WHEN a - max(z) OVER (PARTITION BY file ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2 THEN 0 ELSE 1 END AS b FROM s),
i AS (SELECT *, sum(b) OVER (PARTITION BY file ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT file, min(a) AS "start", max(z) AS "end", count(*) AS n FROM i GROUP BY file, k""")
def merged_spans(spark, sf):
    """Adjacent block clones of a file become one."""
    e = read_table(spark, sf, "events")
    spans = e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("file"), (F.col("user_id") * 6).alias("start"), (F.col("user_id") * 6 + F.col("event_id") % 5).alias("end"), F.lit(1.0).alias("similarity")
    )
    return C.merge_adjacent(spans).select("file", "start", "end", "n")


@query("""WITH c AS (SELECT o_custkey AS file, count(*) AS score FROM orders GROUP BY 1), r AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM c)
SELECT min(score)::DOUBLE AS p90 FROM r WHERE k > floor(n * 0.9)""")
def p90_score(spark, sf):
    counts = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("score"))
    return spark.createDataFrame([(float(A.p90_threshold(counts)),)], "p90 double")


@query("""WITH a AS (SELECT user_id AS file, md5(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT user_id AS file, md5(string_agg(event_type, ',' ORDER BY event_id)) AS h FROM events GROUP BY 1)
SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.file IS NULL THEN 'added' WHEN b.file IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change
FROM a FULL OUTER JOIN b ON a.file = b.file""")
def change_detection(spark, sf):
    """What users did until a date against all they did, by content hash."""
    e = read_table(spark, sf, "events")

    def state(rows):
        log = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
        return I.with_hash(rows.groupBy(F.col("user_id").alias("file")).agg(log.alias("source")))

    return I.detect_changes(state(e.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))), state(e))


@query("""WITH r AS (SELECT n_regionkey AS region, s_suppkey AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'e' AS file, p_partkey AS start_line, p_size AS loc FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 49)""")
def suppressed_findings(spark, sf):
    """Findings on lines that an always-dead flag covers, left out by an anti join."""
    p = read_table(spark, sf, "part")
    found = p.select(F.col("p_brand").alias("file"), F.lit(1).alias("line_start"), F.col("p_partkey").alias("start_line"), F.col("p_size").alias("loc"))
    flags = p.filter("p_size > 49").select(F.col("p_brand").alias("file"), F.lit(1).alias("line"))
    return A.suppress_lines(found, flags).select(F.lit("e").alias("file"), "start_line", "loc")


@query("""SELECT l_suppkey AS group_id, (SELECT count(*) FROM lineitem m WHERE m.l_suppkey = l.l_suppkey) AS n, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey)::INT AS rank FROM lineitem l GROUP BY l_suppkey""")
def numbered_clusters(spark, sf):
    l = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.col("l_quantity").alias("lines"))
    return S.number_clusters(l).select(F.col("cluster").alias("group_id"), "n", "rank")


@query(f"""WITH {EDGES_SQL}, c AS (SELECT p_brand AS file FROM part WHERE p_size = 50)
SELECT DISTINCT file FROM (SELECT file FROM c UNION ALL SELECT a.p_brand FROM e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE b.p_brand IN (SELECT file FROM c))""")
def affected_files(spark, sf):
    changed = read_table(spark, sf, "part").filter("p_size = 50").select(F.col("p_brand").alias("file"))
    return N.affected_files(nodes(spark, sf), edges(spark, sf), changed)


@query("""SELECT source, lang, max(n_chars) AS longest, rank() OVER (PARTITION BY lang ORDER BY max(n_chars) DESC) AS place FROM documents GROUP BY source, lang""")
def ranked_sources(spark, sf):
    d = read_table(spark, sf, "documents").groupBy("source", "lang").agg(F.max("n_chars").alias("longest"))
    return d.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("longest"))).cast("long"))
