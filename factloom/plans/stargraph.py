"""A typed graph derived from the star-schema tables, as input for the graph queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type"""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, id_, name, kind: df.select(F.concat(F.lit(id_[0]), F.col(id_[1])).alias("id"), name.alias("name"), F.lit(kind).alias("type"))
    brands = t("part").select("p_brand").distinct()
    return (
        row(t("part"), ("P", "p_partkey"), F.col("p_name"), "Weapon System")
        .unionByName(row(t("supplier"), ("S", "s_suppkey"), F.col("s_name"), "Platform/Carrier"))
        .unionByName(row(t("customer"), ("C", "c_custkey"), F.col("c_name"), "Combat Unit"))
        .unionByName(row(t("nation"), ("N", "n_nationkey"), F.col("n_name"), "Command Structure"))
        .unionByName(row(t("orders"), ("O", "o_orderkey"), F.concat(F.lit("Order "), F.col("o_orderkey")), "Campaign/Operation"))
        .unionByName(row(brands, ("B", "p_brand"), F.col("p_brand"), "Technical Specification"))
    )


# Of each kind of edge the short name in ids, and the types of its ends.
KINDS = {
    "Equip-Carry": ("EC", "Platform/Carrier", "Weapon System"),
    "Unit-Equip": ("UE", "Combat Unit", "Weapon System"),
    "Unit-Org": ("UO", "Combat Unit", "Command Structure"),
    "Weapon-Spec": ("WS", "Weapon System", "Technical Specification"),
    "Equip-Counter": ("EX", "Weapon System", "Weapon System"),
    "Campaign-Part": ("CP", "Campaign/Operation", "Combat Unit"),
    "Causal-Lead": ("CL", "Campaign/Operation", "Campaign/Operation"),
}


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """id, source, target, type, confidence, source_type, target_type; the order of ids is the order of edges.

    Only the tables of the kinds asked for are read. All line items count.
    """
    t = lambda name: table(spark, sf_dir, name)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    # grouped by the numbers, which are shorter than the ids; edges of one part come together, so that what counts them by part shuffles little
    best_of = lambda rows, letter, c: rows.select(c, "l_partkey", "l_discount").repartition("l_partkey").groupBy(c, "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("c")).select(key(letter, c).alias("source"), key("P", "l_partkey").alias("target"), F.round("c", 6).alias("confidence"))
    made = {
        "Equip-Carry": lambda: best_of(t("lineitem"), "S", "l_suppkey"),
        "Unit-Equip": lambda: best_of(t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")), "C", "o_custkey"),
        "Unit-Org": lambda: t("customer").select(key("C", "c_custkey").alias("source"), key("N", "c_nationkey").alias("target"), F.lit(0.9).alias("confidence")),
        "Weapon-Spec": lambda: t("part").select(key("P", "p_partkey").alias("source"), key("B", "p_brand").alias("target"), F.round(0.5 + F.col("p_size") / 101, 6).alias("confidence")),
        "Equip-Counter": lambda: t("part").select(
            key("P", "p_partkey").alias("source"), F.concat(F.lit("P"), F.lead("p_partkey").over(W.partitionBy("p_type", "p_size").orderBy("p_partkey"))).alias("target"), F.lit(0.7).alias("confidence")
        ).where("target IS NOT NULL"),
        "Campaign-Part": lambda: t("orders").select(key("O", "o_orderkey").alias("source"), key("C", "o_custkey").alias("target"), F.lit(0.8).alias("confidence")),
        "Causal-Lead": lambda: t("orders").select(
            key("O", "o_orderkey").alias("source"), F.concat(F.lit("O"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).alias("target"), F.lit(0.6).alias("confidence")
        ).where("target IS NOT NULL"),
    }
    out = None
    for kind in kinds:
        short, source_type, target_type = KINDS[kind]
        rows = made[kind]().select(
            F.concat(F.lit(short), F.lit(":"), "source", F.lit(">"), "target").alias("id"), "source", "target", F.lit(kind).alias("type"), "confidence",
            F.lit(source_type).alias("source_type"), F.lit(target_type).alias("target_type"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


#: The same as common table expressions: nodes, and all edges.
SQL = """
ec AS MATERIALIZED (SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, round(max(1 - l_discount), 6) AS confidence FROM lineitem GROUP BY 1, 2),
ue AS MATERIALIZED (SELECT 'C' || o_custkey AS source, 'P' || l_partkey AS target, round(max(1 - l_discount), 6) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
uo AS MATERIALIZED (SELECT 'C' || c_custkey AS source, 'N' || c_nationkey AS target, 0.9::DOUBLE AS confidence FROM customer),
ws AS MATERIALIZED (SELECT 'P' || p_partkey AS source, 'B' || p_brand AS target, round(0.5::DOUBLE + p_size / 101::DOUBLE, 6) AS confidence FROM part),
ex AS MATERIALIZED (SELECT * FROM (SELECT 'P' || p_partkey AS source, 'P' || lead(p_partkey) OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS target, 0.7::DOUBLE AS confidence FROM part) WHERE target IS NOT NULL),
cp AS MATERIALIZED (SELECT 'O' || o_orderkey AS source, 'C' || o_custkey AS target, 0.8::DOUBLE AS confidence FROM orders),
cl AS MATERIALIZED (SELECT * FROM (SELECT 'O' || o_orderkey AS source, 'O' || lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target, 0.6::DOUBLE AS confidence FROM orders) WHERE target IS NOT NULL),
edges AS MATERIALIZED (
  SELECT 'EC:' || source || '>' || target AS id, source, target, 'Equip-Carry' AS type, confidence, 'Platform/Carrier' AS source_type, 'Weapon System' AS target_type FROM ec
  UNION ALL SELECT 'UE:' || source || '>' || target, source, target, 'Unit-Equip', confidence, 'Combat Unit', 'Weapon System' FROM ue
  UNION ALL SELECT 'UO:' || source || '>' || target, source, target, 'Unit-Org', confidence, 'Combat Unit', 'Command Structure' FROM uo
  UNION ALL SELECT 'WS:' || source || '>' || target, source, target, 'Weapon-Spec', confidence, 'Weapon System', 'Technical Specification' FROM ws
  UNION ALL SELECT 'EX:' || source || '>' || target, source, target, 'Equip-Counter', confidence, 'Weapon System', 'Weapon System' FROM ex
  UNION ALL SELECT 'CP:' || source || '>' || target, source, target, 'Campaign-Part', confidence, 'Campaign/Operation', 'Combat Unit' FROM cp
  UNION ALL SELECT 'CL:' || source || '>' || target, source, target, 'Causal-Lead', confidence, 'Campaign/Operation', 'Campaign/Operation' FROM cl
),
nodes AS (
  SELECT 'P' || p_partkey AS id, p_name AS name, 'Weapon System' AS type FROM part
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Platform/Carrier' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, c_name, 'Combat Unit' FROM customer
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'Command Structure' FROM nation
  UNION ALL SELECT 'O' || o_orderkey, 'Order ' || o_orderkey, 'Campaign/Operation' FROM orders
  UNION ALL SELECT DISTINCT 'B' || p_brand, p_brand, 'Technical Specification' FROM part
)
"""
