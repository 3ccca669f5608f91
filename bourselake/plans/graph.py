"""Influence and dependency graphs on the market tables."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bourselake.functions import r4, r6
from bourselake.operators import graph, relations as rel, sectors as sec
from bourselake.plans.registry import query
from bourselake.plans.views import add_view
from bourselake.session import cut_lineage
from bourselake.sources.market import Market

add_view("node_ret", "ret sector_idx bench_index rates", """SELECT symbol AS node, date, ret_1d AS r FROM ret WHERE ret_1d IS NOT NULL
  UNION ALL SELECT * FROM (SELECT sector, date, close / LAG(close) OVER (PARTITION BY sector ORDER BY date) - 1 AS r FROM sector_idx) WHERE r IS NOT NULL
  UNION ALL SELECT * FROM (SELECT 'MARKET', date, close / LAG(close) OVER (ORDER BY date) - 1 AS r FROM bench_index) WHERE r IS NOT NULL
  UNION ALL SELECT * FROM (SELECT 'YIELD', date, year10 / LAG(year10) OVER (ORDER BY date) - 1 AS r FROM rates) WHERE r IS NOT NULL""")
add_view("edge_in", "constituents", """SELECT symbol AS src, sector AS dst, 1 AS expected_sign, 'stock' AS kind FROM constituents
  UNION ALL SELECT d.src, s.sector, d.sg, 'driver' FROM (SELECT DISTINCT sector FROM constituents) s, (VALUES ('MARKET', 1), ('YIELD', -1)) d(src, sg)""")
add_view("lagged_edges", "edge_in node_ret", """
WITH j AS (SELECT e.src, e.dst, x.date, x.r AS x, y.r AS y FROM edge_in e JOIN node_ret x ON x.node = e.src JOIN node_ret y ON y.node = e.dst AND y.date = x.date),
l AS (SELECT *, y AS y0, """ + ", ".join(f"LEAD(y, {k}) OVER (PARTITION BY src, dst ORDER BY date) AS y{k}" for k in range(1, 6)) + """ FROM j),
c AS (SELECT src, dst, COUNT(*) AS n, """ + ", ".join(f"CORR(x, y{k}) AS c{k}" for k in range(6)) + """ FROM l GROUP BY 1, 2),
b AS (SELECT *, GREATEST(ABS(c0), ABS(c1), ABS(c2), ABS(c3), ABS(c4), ABS(c5)) AS g FROM c)
SELECT e.src, e.dst, e.expected_sign, e.kind, COALESCE(n, 0) AS n, CASE WHEN n >= 30 THEN c0 END AS corr0,
  CASE WHEN n >= 30 THEN CASE g WHEN ABS(c0) THEN 0.0 WHEN ABS(c1) THEN 1.0 WHEN ABS(c2) THEN 2.0 WHEN ABS(c3) THEN 3.0 WHEN ABS(c4) THEN 4.0 ELSE 5.0 END END AS lead_lag,
  CASE WHEN n >= 30 THEN CASE g WHEN ABS(c0) THEN c0 WHEN ABS(c1) THEN c1 WHEN ABS(c2) THEN c2 WHEN ABS(c3) THEN c3 WHEN ABS(c4) THEN c4 ELSE c5 END END AS lead_corr
  FROM edge_in e LEFT JOIN b ON b.src = e.src AND b.dst = e.dst""")
add_view("edges", "lagged_edges", """SELECT *, CASE WHEN corr0 IS NULL THEN 'untested (too few bars)' WHEN corr0 * expected_sign >= 0.3 THEN 'supported (co-move)'
  WHEN lead_lag > 0 AND lead_corr * expected_sign >= 0.2 THEN CONCAT('supported (leads ', CAST(CAST(lead_lag AS INT) AS VARCHAR), 'd)')
  WHEN GREATEST(ABS(corr0), ABS(lead_corr)) < 0.1 THEN 'no daily link' WHEN corr0 * expected_sign < 0 AND ABS(corr0) >= 0.1 THEN 'wrong sign' ELSE 'weak' END AS verdict FROM lagged_edges""")


def edges(m: Market):
    by_date = Window.orderBy("date")  # one row per calendar date
    drivers = (m.bench_index.select(F.lit("MARKET").alias("node"), "date", (F.col("close") / F.lag("close").over(by_date) - 1).alias("r"))
               .unionByName(m.rates.select(F.lit("YIELD").alias("node"), "date",
                                           (F.col("year10") / F.lag("year10").over(by_date) - 1).alias("r"))))
    series = graph.node_returns(m.bars, sec.sector_index(m.bars, m.constituents), drivers)
    signs = drivers.groupBy(F.col("node").alias("driver")).agg(F.lit(1).alias("one")).select(
        "driver", F.when(F.col("driver") == "YIELD", -1).otherwise(1).alias("expected_sign"))
    return graph.verdicts(rel.lead_lag(graph.sector_edges(m.constituents, signs), series))


EDGE_OUT = "src, dst, kind, n, R6(corr0) AS corr0, CAST(lead_lag AS DOUBLE) AS lead_lag, R6(lead_corr) AS lead_corr, verdict"


@query("influence_edges", "edges", f"SELECT {EDGE_OUT} FROM edges")
def q_edges(m):
    return edges(m).select("src", "dst", "kind", "n", r6("corr0").alias("corr0"), "lead_lag", r6("lead_corr").alias("lead_corr"), "verdict")


@query("bellwethers", "edges", """SELECT dst AS sector, src AS symbol, R6(corr0) AS corr0, ROW_NUMBER() OVER (PARTITION BY dst ORDER BY ABS(COALESCE(corr0, 0)) DESC, src) AS rank FROM edges WHERE kind = 'stock'""")
def q_bell(m):
    return graph.bellwethers(edges(m)).select(F.col("dst").alias("sector"), F.col("src").alias("symbol"), r6("corr0").alias("corr0"), "rank")


add_view("relations", "", """SELECT CONCAT('S', l_suppkey) AS src, p_brand AS dst, CASE l_returnflag WHEN 'N' THEN 'SUPPLIER_OF' WHEN 'R' THEN 'CUSTOMER_OF' ELSE 'PEER_OF' END AS relation,
  CASE WHEN l_discount > 0.05 THEN NULL ELSE l_quantity END AS strength, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0.02 THEN 'medium' ELSE 'low' END AS confidence,
  l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey""")


def relations(m: Market):
    """Supplier - symbol relations with repeated evidence, one per raw line."""
    line = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return line.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("src"), F.col("p_brand").alias("dst"),
        F.when(F.col("l_returnflag") == "N", "SUPPLIER_OF").when(F.col("l_returnflag") == "R", "CUSTOMER_OF").otherwise("PEER_OF").alias("relation"),
        F.when(F.col("l_discount") <= 0.05, F.col("l_quantity")).alias("strength"),
        F.when(F.col("l_tax") > 0.05, "high").when(F.col("l_tax") > 0.02, "medium").otherwise("low").alias("confidence"),
        F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"),
        F.concat_ws("-", F.lit("line"), "l_orderkey", "l_linenumber").alias("evidence"))


add_view("merged", "relations", """SELECT src, dst, relation, COUNT(*) AS n_evidence, MAX(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS cr,
  ARG_MAX(strength, ROW(l_orderkey, l_linenumber, l_extendedprice)) FILTER (strength IS NOT NULL) AS strength FROM relations GROUP BY 1, 2, 3""")


@query("relation_merge", "merged", "SELECT src, dst, relation, n_evidence, strength, CASE cr WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM merged")
def q_merge(m):
    return graph.merge_relations(relations(m))


@query("relation_evidence", "merged relations", """SELECT src, dst, relation, CONCAT_WS('-', 'line', l_orderkey, l_linenumber) AS evidence, n_evidence, m.strength,
  CASE cr WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM relations r JOIN merged m USING (src, dst, relation)""")
def q_evidence(m):
    return graph.edge_evidence(relations(m))


add_view("both_ways", "merged", "SELECT src, dst, relation, strength, cr FROM merged UNION ALL SELECT dst, src, relation, strength, cr FROM merged")
add_view("strongest", "both_ways", """SELECT * FROM both_ways
  QUALIFY ROW_NUMBER() OVER (PARTITION BY src ORDER BY COALESCE(strength, 0) DESC, cr DESC, dst, relation) <= 5""")
add_view("bfs_nodes", "strongest", """
WITH l0 AS (SELECT 'Brand#1' AS node), l1 AS (SELECT DISTINCT dst AS node FROM strongest WHERE src IN (SELECT node FROM l0) AND dst NOT IN (SELECT node FROM l0)),
v1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1), l2 AS (SELECT DISTINCT dst AS node FROM strongest WHERE src IN (SELECT node FROM l1) AND dst NOT IN (SELECT node FROM v1)),
v2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM l2), l3 AS (SELECT DISTINCT dst AS node FROM strongest WHERE src IN (SELECT node FROM l2) AND dst NOT IN (SELECT node FROM v2))
SELECT node, 0 AS level FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2 UNION ALL SELECT node, 3 FROM l3""")


def seed(m: Market):
    return m.constituents.filter("symbol = 'Brand#1'").select(F.col("symbol").alias("node")).distinct()


@query("graph_bfs", "bfs_nodes", "SELECT node, level FROM bfs_nodes")
def q_bfs(m):
    return graph.expand(graph.incident(cut_lineage(graph.merge_relations(relations(m)))), seed(m), depth=3)


@query("graph_bfs_edges", "both_ways strongest bfs_nodes", """
WITH e AS (SELECT s.*, level FROM strongest s JOIN bfs_nodes ON node = src WHERE level < 3
  UNION ALL SELECT b.*, level FROM both_ways b JOIN bfs_nodes ON node = src WHERE level = 3)
SELECT src, dst, relation, strength, CASE cr WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, level FROM e""")
def q_bfs_edges(m):
    edges = graph.incident(cut_lineage(graph.merge_relations(relations(m))))
    return graph.expanded_edges(edges, graph.expand(edges, seed(m), depth=3), depth=3)


def boards(m: Market):
    """Suppliers sit on the boards of the symbols they deliver to."""
    line = m.table("lineitem").join(m.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return line.select(F.col("p_brand").alias("company"), F.col("l_suppkey").alias("person"))


BOARD = """
WITH b AS (SELECT DISTINCT p_brand AS company, l_suppkey AS person FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.company AS src, b.company AS dst, COUNT(*) AS n_shared{extra} FROM b a JOIN b ON a.person = b.person AND a.company < b.company GROUP BY 1, 2"""


@query("shared_member_link", "", BOARD.format(extra=""))
def q_shared(m):
    return graph.shared_members(boards(m)).drop("relation")


@query("board_interlocks", "", BOARD.format(extra=", 'BOARD_INTERLOCK' AS relation"))
def q_boards(m):
    return graph.shared_members(boards(m))


add_view("interlocks", "", BOARD.format(extra=""))


@query("edge_price_overlay", "interlocks node_ret", """
WITH j AS (SELECT e.src, e.dst, x.date, x.r AS x, y.r AS y FROM interlocks e JOIN node_ret x ON x.node = e.src JOIN node_ret y ON y.node = e.dst AND y.date = x.date),
l AS (SELECT *, """ + ", ".join(f"LEAD(y, {k}) OVER (PARTITION BY src, dst ORDER BY date) AS y{k}" for k in range(1, 6)) + """ FROM j),
c AS (SELECT src, dst, COUNT(*) AS n, CORR(x, y) AS c0, """ + ", ".join(f"CORR(x, y{k}) AS c{k}" for k in range(1, 6)) + """ FROM l GROUP BY 1, 2),
b AS (SELECT *, GREATEST(ABS(c0), ABS(c1), ABS(c2), ABS(c3), ABS(c4), ABS(c5)) AS g FROM c)
SELECT src, dst, n, R6(c0) AS corr0, CAST(CASE g WHEN ABS(c0) THEN 0 WHEN ABS(c1) THEN 1 WHEN ABS(c2) THEN 2 WHEN ABS(c3) THEN 3 WHEN ABS(c4) THEN 4 ELSE 5 END AS DOUBLE) AS best_lag FROM b""")
def q_overlay(m):
    """Listed - listed edges annotated with their price co-movement."""
    series = graph.node_returns(m.bars, sec.sector_index(m.bars, m.constituents))
    df = rel.lead_lag(graph.shared_members(boards(m)).select("src", "dst"), series)
    return df.select("src", "dst", "n", r6("corr0").alias("corr0"), F.col("lead_lag").alias("best_lag"))


@query("related_party_edges", "", """SELECT CONCAT('C', o_custkey) AS src, CONCAT('S', l_suppkey) AS dst, MAX(l_extendedprice) AS strength, COUNT(*) AS n_evidence, 'GROUP_ENTITY' AS relation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def q_related(m):
    rows = m.table("lineitem").join(m.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("dst"),
        F.col("l_extendedprice").alias("amount"))
    return graph.related_parties(rows)
