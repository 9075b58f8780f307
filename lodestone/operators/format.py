"""What a service would show: evidence, community cards, conflicts and ids, made short and put in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .evidence import best_per_source
from .validate import severity, severity_weight

MOST_CONTENT, MOST_SUMMARY, MOST_ENTITIES, MOST_ID = 500, 200, 10, 16


def short_id(c: Column) -> Column:
    return T.cut(c, MOST_ID)


def evidence(rows: DataFrame, *, least: float = 0.0, group: bool = False) -> DataFrame:
    """rows(query_id, id, content, confidence, source, why_selected): by confidence, contents cut, blank explanations replaced; with
    group the best row of each source."""
    kept = rows.where(F.round("confidence", 9) >= least) if least > 0 else rows
    kept = best_per_source(kept) if group else kept
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 9)), "id"))
    why = F.when(T.trimmed(F.coalesce("why_selected", F.lit(""))) == "", F.lit("selected based on relevance")).otherwise(F.col("why_selected"))
    return kept.select("query_id", "id", T.cut(F.col("content"), MOST_CONTENT).alias("content"), F.round("confidence", 3).alias("confidence"), "source", why.alias("why_selected"), rank.alias("rank"))


def cards(members: DataFrame) -> DataFrame:
    """members(id, title, summary, entity), a row for each member: the first ten entities by name, a short summary, the number of members.
    Names are cut to ten before they are gathered; callers sort by entity_count, largest first, where they show cards."""
    place = F.row_number().over(Window.partitionBy("id").orderBy("entity"))
    first = members.withColumn("n", place).where(F.col("n") <= MOST_ENTITIES).groupBy("id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    count = members.groupBy("id").agg(F.min("title").alias("title"), T.cut(F.min("summary"), MOST_SUMMARY).alias("summary"), F.count(F.lit(1)).alias("entity_count"))
    return count.join(first, "id").select("id", "title", "summary", "entities", "entity_count")


def merged_conflicts(*lists: DataFrame) -> DataFrame:
    """Conflicts(id, kind, severity) of several lists: of equal ids that of the first list; severities by their four names; worst first."""
    out = None
    for n, rows in enumerate(lists):
        part = rows.select("id", "kind", severity(F.col("severity")).alias("severity"), F.lit(n).alias("list"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("id").agg(F.min_by(F.struct("kind", "severity"), "list").alias("c")).select("id", "c.kind", "c.severity")
    return first.withColumn("weight", severity_weight(F.col("severity")))


def entity_ids(c: Column) -> Column:
    """Short, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x != ""), short_id)))


def retrieval_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """Counts are never negative."""
    return rows.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in columns})


def display(rows: DataFrame, limit: int = 20) -> str:
    """A few rows as text, for people."""
    return "\n".join(f"[{r.rank}] {r.confidence:.3f} {r.source}: {r.content}" for r in rows.orderBy("query_id", "rank").limit(limit).collect())
