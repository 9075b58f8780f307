"""Nodes and edges derived from the relational tables and the conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tables import table


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, prefix: str, key: str, label: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("name"))

    turns = table(spark, sf_dir, "conversations").select(_turn(F.col("turn")).alias("id"), F.lit("ConversationTurn").alias("type"), F.col("role").alias("name"))
    parts = [
        part("region", "r", "r_regionkey", "r_name", "Entity"), part("nation", "n", "n_nationkey", "n_name", "Entity"), part("customer", "c", "c_custkey", "c_name", "Entity"),
        part("supplier", "s", "s_suppkey", "s_name", "Source"), part("orders", "o", "o_orderkey", "o_orderpriority", "Event"), turns,
    ]
    return reduce(DataFrame.unionByName, parts)


def _turn(turn):
    return F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, a: str, src: str, b: str, dst: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"))

    following = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("next", following).where("next IS NOT NULL").select(_turn(F.col("turn")).alias("src"), _turn(F.col("next")).alias("dst"), F.lit("TEMPORAL_NEXT").alias("type"), F.lit(0.5).alias("weight"))
    every = [
        part("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF"), part("customer", "c", "c_custkey", "n", "c_nationkey", "PART_OF"), part("supplier", "s", "s_suppkey", "n", "s_nationkey", "PART_OF"),
        part("orders", "o", "o_orderkey", "c", "o_custkey", "RELATED_TO"), turns,
    ]
    return reduce(DataFrame.unionByName, every).select(F.concat("src", F.lit(">"), "dst").alias("id"), "src", "dst", "type", "weight")


SQL = """nodes AS (SELECT 'r' || r_regionkey AS id, 'Entity' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Entity', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Entity', c_name FROM customer UNION ALL SELECT 's' || s_suppkey, 'Source', s_name FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'Event', o_orderpriority FROM orders UNION ALL SELECT 't' || conv_id || '_' || turn, 'ConversationTurn', role FROM conversations),
edges AS (SELECT src || '>' || dst AS id, src, dst, type, weight::DOUBLE AS weight FROM (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'PART_OF' AS type, 1.0 AS weight FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'PART_OF', 1.0 FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'PART_OF', 1.0 FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'RELATED_TO', 1.0 FROM orders
  UNION ALL SELECT 't' || conv_id || '_' || turn, 't' || conv_id || '_' || following, 'TEMPORAL_NEXT', 0.5 FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) WHERE following IS NOT NULL))"""
