"""Influence and dependency graphs as edge tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourselake.functions import lagged, safe_div
from bourselake.operators.pairs import pair_moments
from bourselake.session import cut_lineage


def node_returns(bars: DataFrame, sector_index: DataFrame, drivers: DataFrame | None = None
                 ) -> DataFrame:
    """(node, date, r) for stocks, sector indices and driver series."""
    stock = bars.select(F.col("symbol").alias("node"), "date",
                        (safe_div("close", lagged("close")) - 1).alias("r"))
    index = sector_index.select(F.col("sector").alias("node"), "date",
                                (safe_div("close", lagged("close", 1, "sector")) - 1).alias("r"))
    out = stock.unionByName(index)
    if drivers is not None:
        out = out.unionByName(drivers.select("node", "date", "r"))
    return out.filter("r IS NOT NULL")


# -- influence graph ---------------------------------------------------------------------------
def verdicts(edges: DataFrame) -> DataFrame:
    """Name what the correlations say about the expected sign of each edge."""
    sign = F.col("expected_sign")
    together = F.col("corr0") * sign
    lead_corr = F.coalesce("lead_corr", F.lit(0.0))
    strongest = F.greatest(F.abs("corr0"), F.abs(lead_corr))
    days = F.col("lead_lag").cast("int").cast("string")
    verdict = (F.when(F.col("corr0").isNull(), "untested (too few bars)")
               .when(together >= 0.3, "supported (co-move)")
               .when((F.col("lead_lag") > 0) & (lead_corr * sign >= 0.2),
                     F.concat(F.lit("supported (leads "), days, F.lit("d)")))
               .when(strongest < 0.1, "no daily link")
               .when((together < 0) & (F.abs("corr0") >= 0.1), "wrong sign").otherwise("weak"))
    return edges.withColumn("verdict", verdict)


def sector_edges(constituents: DataFrame, drivers: DataFrame) -> DataFrame:
    """Driver -> sector and member -> sector edges with their expected sign."""
    members = constituents.select(F.col("symbol").alias("src"), F.col("sector").alias("dst"),
                                  F.lit(1).alias("expected_sign"), F.lit("stock").alias("kind"))
    sectors = constituents.select("sector").distinct()
    # a driver acts on every sector: drivers carry the (short) sector list as one array
    listed = sectors.agg(F.array_sort(F.collect_set("sector"))).scalar()
    outside = drivers.withColumn("dst", F.explode(listed)).select(
        F.col("driver").alias("src"), "dst", "expected_sign", F.lit("driver").alias("kind"))
    return members.unionByName(outside)


def bellwethers(edges: DataFrame, k: int | None = None) -> DataFrame:
    """Members of each sector by the size of their co-movement."""
    rank = F.row_number().over(Window.partitionBy("dst").orderBy(
        F.desc(F.abs(F.coalesce("corr0", F.lit(0.0)))), "src"))
    out = edges.filter("kind = 'stock'").withColumn("rank", rank.cast("bigint"))
    return out if k is None else out.filter(F.col("rank") <= k)


# -- dependency graph ----------------------------------------------------------------------------
# Confidence labels from weak to strong.
CONFIDENCE = ("low", "medium", "high")


def confidence_rank() -> Column:
    return sum((F.when(F.col("confidence") == c, i + 1).otherwise(0) for i, c in enumerate(CONFIDENCE)), F.lit(0))


def merge_relations(relations: DataFrame) -> DataFrame:
    """One edge per (src, dst, relation): evidence counted, best confidence, last stated strength.

    `seq` orders the deliveries. The evidence itself stays in rows, see `edge_evidence`.
    """
    merged = relations.groupBy("src", "dst", "relation").agg(
        F.count("*").alias("n_evidence"), F.max(confidence_rank()).alias("_rank"),
        F.max_by("strength", F.when(F.col("strength").isNotNull(), F.col("seq"))).alias("strength"))
    label = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("_rank"))
    return merged.withColumn("confidence", label).drop("_rank")


def edge_evidence(relations: DataFrame) -> DataFrame:
    """Every piece of evidence next to its merged edge, one row each: an edge may have any number of them."""
    key = ["src", "dst", "relation"]
    return relations.select(*key, "evidence").join(merge_relations(relations), key)


def incident(edges: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends: src is the end it is seen from."""
    rest = ["relation", "strength", "confidence"]
    return edges.select("src", "dst", *rest).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def strongest(edges: DataFrame, breadth: int) -> DataFrame:
    """The first `breadth` edges of each node by strength (none counts as 0), then confidence."""
    order = [F.desc(F.coalesce("strength", F.lit(0))), F.desc(confidence_rank()), "dst", "relation"]
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return edges.withColumn("_k", rank).filter(F.col("_k") <= breadth).drop("_k")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2, breadth: int = 5) -> DataFrame:
    """Breadth-first expansion: each level follows the first `breadth` edges per node.

    `edges(src, dst, relation, strength, confidence)` is directed; what is followed is found once, and the visited set is
    cut from its lineage per level.
    """
    followed = cut_lineage(strongest(edges, breadth).select("src", "dst"))
    visited = seeds.select("node", F.lit(0).alias("level"))
    frontier = visited
    for level in range(1, depth + 1):
        reached = (frontier.join(followed, F.col("node") == F.col("src")).select(F.col("dst").alias("node"))
                   .distinct().join(visited.select("node"), "node", "left_anti"))
        frontier = cut_lineage(reached.withColumn("level", F.lit(level)))
        visited = visited.unionByName(frontier)
    return visited


def expanded_edges(edges: DataFrame, nodes: DataFrame, depth: int = 2, breadth: int = 5) -> DataFrame:
    """The edges an expansion saw: those it followed below the last level, and all edges of the last level's nodes."""
    at = F.col("node") == F.col("src")
    inner = strongest(edges, breadth).join(nodes.filter(F.col("level") < depth), at)
    return inner.unionByName(edges.join(nodes.filter(F.col("level") == depth), at)).drop("node")


def shared_members(membership: DataFrame, relation: str = "BOARD_INTERLOCK") -> DataFrame:
    """Company pairs a < b that share a person, with the number shared.

    `membership(company, person)`. Shared persons are counted as a matrix product over blocks of
    companies and chunks of persons, both of bounded size, so a person on very many boards emits no pair rows.
    """
    seats = membership.select(F.col("company").alias("symbol"), F.col("person").alias("date"),
                              F.lit(1.0).alias("seat")).distinct()
    shared = pair_moments(seats, "seat", split=True)
    return shared.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("n_shared"),
                         F.lit(relation).alias("relation"))


def related_parties(rows: DataFrame) -> DataFrame:
    """Related-party table to group edges; strength is the largest amount."""
    return rows.groupBy("src", "dst").agg(F.max("amount").alias("strength"),
                                          F.count("*").alias("n_evidence")).withColumn(
        "relation", F.lit("GROUP_ENTITY"))
