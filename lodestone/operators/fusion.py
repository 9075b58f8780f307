"""Reciprocal-rank fusion of ranked lists, many queries at once.

Input is one long table: query_id, method, id, content columns if wanted, score, position (1-based place in its list), weight (0 or
null: the method's default). The full outer merge of the lists is one aggregation by (query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

K = 60
MAX_RESULTS = 100
DEFAULT_WEIGHTS = {"vector": 1.0, "keyword": 1.0, "graph": 1.0}


def inputs(**lists: DataFrame) -> DataFrame:
    """The long table of lists(query_id, id, score, rank), named by method in the order given."""
    out = None
    for order, (method, rows) in enumerate(lists.items()):
        if not method:
            raise ValueError("a method needs a name")
        part = rows.select("query_id", F.lit(method).alias("method"), F.lit(order).alias("method_order"), "id", "score", F.col("rank").alias("position"), F.lit(0.0).alias("weight"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to fuse")
    return out


def weighted(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    known = DEFAULT_WEIGHTS | (weights or {})
    default = F.coalesce(F.create_map(*[x for m, w in known.items() for x in (F.lit(m), F.lit(float(w)))])[F.col("method")], F.lit(1.0))
    return rows.withColumn("weight", F.coalesce(F.when(F.col("weight") != 0, F.col("weight")), default))


def normalized(rows: DataFrame) -> DataFrame:
    """Scores to [0, 1] within each query and method; 1 where all are equal."""
    w = Window.partitionBy("query_id", "method")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return rows.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)))


def fuse(rows: DataFrame, *, k: int = K, weights: dict[str, float] | None = None, normalize: bool = True, least: float = 0.0, limit: int = MAX_RESULTS) -> DataFrame:
    """query_id, id, rrf, combined, final, methods (in order), method_scores, rank. final = rrf * (1 + weighted mean score)."""
    rows = weighted(rows, weights)
    rows = normalized(rows) if normalize else rows
    merged = rows.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("position"))).alias("rrf"),
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("combined"),
        F.transform(F.array_sort(F.collect_list(F.struct("method_order", "method"))), lambda x: x["method"]).alias("methods"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "score")))).alias("method_scores"),
    )
    out = merged.withColumn("final", F.col("rrf") * (1 + F.col("combined")))
    if least > 0:
        out = out.where(F.col("final") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 9)), F.desc(F.round("rrf", 9)), F.asc("id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


def overlap(fused: DataFrame) -> DataFrame:
    """query_id, method_a, method_b, n: results that two methods share (ordered pairs)."""
    one = fused.select("query_id", "id", F.explode("methods").alias("method_a"), "methods")
    pairs = one.select("query_id", "method_a", F.explode("methods").alias("method_b")).where("method_a <> method_b")
    return pairs.groupBy("query_id", "method_a", "method_b").agg(F.count(F.lit(1)).alias("n"))


def stats(fused: DataFrame) -> DataFrame:
    """query_id, n_results, n_multi (found by several methods), average final score."""
    return fused.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.sum((F.size("methods") > 1).cast("long")).alias("n_multi"), F.avg("final").alias("average")
    )
