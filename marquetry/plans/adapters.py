"""The driver's tables seen as nodes, edges, findings and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.runtime import cut, read_table

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("file"),
        F.col("p_size").alias("loc"), F.when(F.col("p_size") % 3 == 0, "private").when(F.col("p_size") % 3 == 1, "public").otherwise("internal").alias("visibility"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Next part of the same order, where many of it were returned. Most queries read the
    edges several times, and they are few beside the rows they come from: made once."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    rows = read_table(spark, sf, "lineitem").withColumn("dst", F.lead("l_partkey").over(w))
    kept = rows.filter("l_returnflag = 'R' and l_quantity >= 45 and dst is not null and dst <> l_partkey")
    return cut(kept.select(F.col("l_partkey").alias("src"), "dst").distinct())


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    return part.filter("p_size <= 2").select(F.col("p_partkey").alias("id"), F.lit("production").alias("kind")).union(
        part.filter("p_size = 3").select("p_partkey", F.lit("test"))
    )


EDGES_SQL = f"""e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS dst, l_returnflag AS rf, l_quantity AS q FROM lineitem)
  WHERE rf = 'R' AND q >= 45 AND dst IS NOT NULL AND dst <> src)"""
NODES_SQL = """n AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_brand AS file, p_size AS loc,
  CASE WHEN p_size % 3 = 0 THEN 'private' WHEN p_size % 3 = 1 THEN 'public' ELSE 'internal' END AS visibility FROM part)"""
REACH_SQL = """prod(id) AS (SELECT p_partkey FROM part WHERE p_size <= 2 UNION SELECT e.dst FROM prod JOIN e ON e.src = prod.id),
test(id) AS (SELECT p_partkey FROM part WHERE p_size = 3 UNION SELECT e.dst FROM test JOIN e ON e.src = test.id)"""


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers under nations under regions, as (child, parent) names."""
    t = lambda n: read_table(spark, sf, n)
    label = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("nation").select(label("n", "n_nationkey").alias("child"), label("r", "n_regionkey").alias("parent"))
        .union(t("supplier").select(label("s", "s_suppkey"), label("n", "s_nationkey")))
        .union(t("customer").select(label("c", "c_custkey"), label("n", "c_nationkey")))
    )


HIERARCHY_SQL = """h(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
