"""Registered queries of stored expansion, patterns and families of gene sets over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import gpr
from .operators import patterns
from .operators.expansion import Adjacency, Expansion
from .operators.patterns import BOTH, IN, Hop
from .plans.tables import shared_dir
from .queries import _t, _trade, query


@query("""
SELECT o_custkey, CASE WHEN count(*) <= 10 THEN count(*) * 2 ELSE 0 END AS listed_genes, count(*) * 2 AS genes, (pow(2, count(*))::HUGEINT + 1)::VARCHAR AS complexes, pow(2, count(*))::HUGEINT::VARCHAR AS minimal,
       count(*) AS smallest, count(*) * 2 AS nodes, bool_and(o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AS possible,
       CASE WHEN count(*) <= 10 THEN pow(2, count(*))::BIGINT + 1 ELSE 0 END AS listed
FROM orders GROUP BY o_custkey
""")
def gene_rule_families(spark, sf):
    """A rule for each customer: of every order one of two genes, or all of them (which absorption takes out); rules of up to ten orders are listed too."""
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("a"), F.col("o_orderkey")).alias("a"), F.concat(F.lit("b"), F.col("o_orderkey")).alias("b"))
    there = F.when(F.col("o_orderkey") % 3 != 0, F.col("a")), F.when(F.col("o_orderkey") % 2 == 0, F.col("b"))
    rules = o.groupBy("o_custkey").agg(
        F.collect_list(F.concat(F.lit("("), "a", F.lit(" or "), "b", F.lit(")"))).alias("pairs"),
        F.collect_list(F.concat("a", F.lit(" AND "), "b")).alias("all"),
        F.array_compact(F.flatten(F.collect_list(F.array(*there)))).alias("present"),
    )
    rule = F.concat(F.lit("("), F.array_join("pairs", " and "), F.lit(") or ("), F.array_join("all", " and "), F.lit(")"))
    rows = rules.select("o_custkey", rule.alias("rule"), "present", F.when(F.size("pairs") <= 10, rule).alias("short"))
    told = rows.select("o_custkey", gpr.gene_sets("rule").alias("s"), gpr.possible("rule", "present").alias("possible"), gpr.complexes("short").alias("c"))
    long = lambda c: F.col(c).cast("long")
    return told.select(
        "o_custkey", F.size(F.array_distinct(F.flatten("c"))).cast("long").alias("listed_genes"), long("s.genes").alias("genes"), "s.complexes", "s.minimal", long("s.smallest").alias("smallest"),
        long("s.nodes").alias("nodes"), "possible", F.size("c").cast("long").alias("listed"),
    )


@query("""
WITH region1 AS (SELECT r_regionkey FROM region WHERE r_regionkey = 1), n AS (SELECT * FROM nation WHERE n_regionkey = 1), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'node' AS kind, 'Region/1' AS id, 0 AS depth
UNION ALL SELECT DISTINCT 'node', 'Nation/' || n_nationkey, 1 FROM n UNION ALL SELECT DISTINCT 'node', 'Customer/' || c_custkey, 2 FROM c UNION ALL SELECT DISTINCT 'node', 'Order/' || o_orderkey, 3 FROM o
UNION ALL SELECT DISTINCT 'edge', 'Region/1/has_nation/Nation/' || n_nationkey, 1 FROM n
UNION ALL SELECT DISTINCT 'edge', 'Nation/' || c_nationkey || '/has_customer/Customer/' || c_custkey, 2 FROM c
UNION ALL SELECT DISTINCT 'edge', 'Customer/' || o_custkey || '/has_order/Order/' || o_orderkey, 3 FROM o
""")
def expansion_resumed(spark, sf):
    """From one region by label and key: two levels, and one more by another object that goes on from what is stored."""
    path = f"{shared_dir(spark)}/expansion-{uuid.uuid4().hex[:12]}"
    allowed = {"Region": (True, False), "Nation": (True, True), "Customer": (True, False)}
    Expansion(Adjacency.write(_trade(spark, sf), f"{path}/graph"), f"{path}/found", allowed).start_at("Region", " 1 ").grow(2)
    whole = Expansion(Adjacency.read(spark, f"{path}/graph"), f"{path}/found", allowed).grow()
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "depth")
    return rows(whole.nodes(), "node").unionByName(rows(whole.edges(), "edge"))


@query("""
SELECT 'Region/' || r_regionkey AS region, 'Nation/' || n_nationkey AS nation, 'Customer/' || c_custkey AS customer
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
""")
def pattern_two_hops(spark, sf):
    found = patterns.match(_trade(spark, sf, orders=False), "Region", Hop("has_nation", "Nation"), Hop("has_customer", "Customer"))
    return found.select(F.col("n0").alias("region"), F.col("n1").alias("nation"), F.col("n2").alias("customer"))


@query("""
SELECT DISTINCT 'Customer/' || c_custkey AS customer, 'Nation/' || a.n_nationkey AS own, 'Region/' || r_regionkey AS region, 'Nation/' || b.n_nationkey AS neighbour
FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey
""")
def pattern_three_hops(spark, sf):
    """Customer up to its nation and region, and down to that region's nations."""
    found = patterns.match(_trade(spark, sf, orders=False), "Customer", Hop("has_customer", "Nation", IN), Hop("has_nation", "Region", BOTH), Hop("has_nation", "Nation"))
    return found.select(F.col("n0").alias("customer"), F.col("n1").alias("own"), F.col("n2").alias("region"), F.col("n3").alias("neighbour"))


@query("""
WITH RECURSIVE arc AS (
  SELECT 'Region/' || n_regionkey AS s, 'Nation/' || n_nationkey AS t FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)
  UNION SELECT 'Nation/' || c_nationkey, 'Customer/' || c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
  UNION SELECT 'Customer/' || o_custkey, 'Order/' || o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
walk AS (
  SELECT 'Region/' || r_regionkey AS root, 'Region/' || r_regionkey AS id, 0 AS hops FROM region
  UNION SELECT root, t, hops + 1 FROM walk JOIN arc ON s = id WHERE hops < 3)
SELECT root, id, min(hops) AS hops FROM walk WHERE hops >= 1 GROUP BY root, id
""")
def pattern_variable_length(spark, sf):
    """All that lies one to three edges below each region."""
    found = patterns.match(_trade(spark, sf), "Region", Hop(least=1, most=3))
    return found.select(F.col("n0").alias("root"), F.col("n1").alias("id"), F.col("h1").alias("hops"))
