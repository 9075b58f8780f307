"""Multi-factor ranking of results: query_id, id, query, content, base_score, age_days (null: unknown), source, title, authority, quality.

The factors are row expressions; diversity compares the results of one query with each other, which are as many as fusion's limit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.constants import TRUSTED_SOURCES
from ..sources.tables import written


@dataclass(frozen=True)
class Ranking:
    relevance: float = 1.0
    freshness: float = 0.2
    authority: float = 0.3
    diversity: float = 0.1
    quality: float = 0.4
    personal: float = 0.2
    boost_at: float = 0.8
    penalty_at: float = 0.3
    radius: float = 0.5
    limit: int = 100
    half_life_days: float = 30.0
    topics: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


def _one(x) -> Column:
    return F.lit(float(x))


def relevance() -> Column:
    q = F.lower("query")
    raised = F.col("base_score") * F.when(F.contains(F.lower("content"), q), 1.2).otherwise(1.0) * F.when(F.contains(F.lower(F.coalesce("title", F.lit(""))), q), 1.3).otherwise(1.0)
    return F.when(F.col("query") == "", F.col("base_score")).otherwise(F.least(raised, _one(1)))


def freshness(half_life: float) -> Column:
    import math

    return F.when(F.col("age_days").isNull(), _one(0.5)).otherwise(F.exp(F.lit(-math.log(2)) * F.col("age_days") / half_life))


def authority() -> Column:
    known = F.coalesce(F.col("authority").cast("double"), _one(0.5))
    return F.when(F.lower(F.coalesce("source", F.lit(""))).rlike("|".join(TRUSTED_SOURCES)), F.least(known * 1.2, _one(1))).otherwise(known)


def quality() -> Column:
    n = F.octet_length("content")
    base = F.when((n > 100) & (n < 2000), 0.7).when(n < 50, 0.3).otherwise(0.5)
    told = F.when(F.col("quality").isNotNull(), (base + F.col("quality").cast("double")) / 2).otherwise(base)
    return F.greatest(F.least(F.when(n < 20, told * 0.5).when(n > 5000, told * 0.8).otherwise(told), _one(1)), _one(0))


def personal(topics: tuple[str, ...], sources: tuple[str, ...]) -> Column:
    out = _one(0.5)
    for t in topics:
        out = out + F.when(F.contains(F.lower("content"), F.lit(t.lower())), 0.2).otherwise(0.0)
    for s in sources:
        out = out + F.when(F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit(s.lower())), 0.3).otherwise(0.0)
    return F.least(out, _one(1))


def factors(rows: DataFrame, c: Ranking = Ranking()) -> DataFrame:
    return rows.withColumns({
        "relevance": relevance(), "freshness": freshness(c.half_life_days), "authority_score": authority(), "quality_score": quality(), "personal": personal(c.topics, c.sources),
    })


def content_pairs(rows: DataFrame) -> DataFrame:
    """query_id, id, other, similarity of the word sets for all ordered pairs of a query that share a word; the rest have similarity 0. A
    query's list is bounded by ranking (twice the limit), so its sets meet in one task, as a product of 0/1 matrices. Words go by their
    64-bit fingerprints."""
    sets = rows.select("query_id", "id", F.transform(T.content_words(F.col("content")), lambda w: F.xxhash64(w)).alias("w"))

    def paired(group: pa.Table) -> pa.Table:
        lists = group.column("w").combine_chunks()
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words, at = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        row = np.repeat(np.arange(len(n)), n)
        both = np.zeros((len(n), len(n)), np.float32)
        for a in range(0, len(words), 1 << 14):
            own = (at >= a) & (at < a + (1 << 14))
            x = np.zeros((len(n), min(1 << 14, len(words) - a)), np.float32)
            x[row[own], at[own] - a] = 1
            both += x @ x.T
        np.fill_diagonal(both, 0)
        i, j = np.nonzero(both)
        common = both[i, j].astype(np.float64)
        ids = group.column("id").combine_chunks()
        query = group.column("query_id").combine_chunks().take(pa.array(np.zeros(len(i), np.int64)))
        return pa.table({"query_id": query, "id": ids.take(pa.array(i)), "other": ids.take(pa.array(j)), "similarity": pa.array(common / (n[i] + n[j] - common))})

    kinds = sets.schema
    out = StructType([kinds["query_id"], kinds["id"], StructField("other", kinds["id"].dataType), StructField("similarity", DoubleType())])
    return sets.groupBy("query_id").applyInArrow(paired, out)


def diversity(rows: DataFrame, radius: float = 0.5) -> DataFrame:
    """query_id, id, diversity. The mean similarity is over all other results of the query."""
    pairs = content_pairs(rows).groupBy("query_id", "id").agg(
        F.product(F.when(F.col("similarity") > radius, 1 - F.col("similarity") * 0.5).otherwise(1.0)).alias("close"), F.sum("similarity").alias("total")
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    own = rows.select("query_id", "id", n.alias("n")).join(pairs, ["query_id", "id"], "left")
    score = F.coalesce("close", F.lit(1.0)) * (1 - F.coalesce("total", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)) * 0.3)
    return own.select("query_id", "id", F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.least(score, _one(1)), _one(0.1))).alias("diversity"))


def rank(rows: DataFrame, c: Ranking = Ranking()) -> DataFrame:
    """All factors, final score after boosts and penalties, their labels, rank; the `limit` best of each query. Of a query's rows the
    first 2 * limit by base score are looked at."""
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base_score"), "id"))
    rows = written(rows.withColumn("place", first).where(F.col("place") <= 2 * c.limit).drop("place"))  # read for the factors and for the pairs
    scored = factors(rows, c).join(diversity(rows, c.radius), ["query_id", "id"])
    total = c.relevance + c.freshness + c.authority + c.quality + c.diversity + c.personal
    mean = (
        F.col("relevance") * c.relevance + F.col("freshness") * c.freshness + F.col("authority_score") * c.authority
        + F.col("quality_score") * c.quality + F.col("diversity") * c.diversity + F.col("personal") * c.personal
    ) / total
    scored = scored.withColumn("mean", mean)
    high, trusted, fresh = F.round("mean", 9) >= c.boost_at, F.col("authority_score") >= 0.8, F.round("freshness", 9) >= 0.9
    up = F.col("mean") * F.when(high, 1.1).otherwise(1.0) * F.when(trusted, 1.05).otherwise(1.0) * F.when(fresh, 1.03).otherwise(1.0)
    scored = scored.withColumn("raised", up)
    low, poor = F.round("raised", 9) <= c.penalty_at, F.round("quality_score", 9) <= 0.3
    down = F.col("raised") * F.when(low, 0.9).otherwise(1.0) * F.when(poor, 0.95).otherwise(1.0)
    labels = lambda *x: F.array_compact(F.array(*[F.when(k, v) for k, v in x]))
    scored = scored.withColumns({
        "final": F.greatest(F.least(down, _one(1)), _one(0)),
        "boosts": labels((high, "high_score_boost"), (trusted, "authority_boost"), (fresh, "freshness_boost")),
        "penalties": labels((low, "low_score_penalty"), (poor, "quality_penalty")),
    })
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("final", 9)), F.desc(F.round("base_score", 9)), F.desc(F.round("relevance", 9)), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= c.limit).drop("mean", "raised")


def stats(ranked: DataFrame) -> DataFrame:
    """query_id, counts, means of the six factors, the metrics of diversity and quality, boosts and penalties."""
    names = ("relevance", "freshness", "authority_score", "quality_score", "diversity", "personal")
    return ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"avg_{x}") for x in names),
        F.avg("diversity").alias("diversity_metric"), F.avg("quality_score").alias("quality_metric"),
        F.sum(F.size("boosts")).cast("long").alias("boosts"), F.sum(F.size("penalties")).cast("long").alias("penalties"),
    )
