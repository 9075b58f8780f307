"""Evidence from ranked results: confidence filter, near-duplicate removal, explanation, provenance, relations, histogram, conflicts.

Input rows: query_id, id, content, confidence, source, age_days, position (place in the list), matched (array of terms),
related (array of entities), path (array of nodes), metadata columns version, author, category, topic where there are any.
A query's list is bounded (fusion and ranking limit it), so folds over a list are array expressions, not loops on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..sources.tables import written
from .rank import content_pairs

LEAST_CONFIDENCE = 0.1
NEAR = 0.8
LIMIT = 50
MOST_BYTES = 2000


def confident(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return rows.where(F.round("confidence", 9) >= least) if least > 0 else rows


def exact_dedup(rows: DataFrame) -> DataFrame:
    """The first by position of each trimmed lower-case content in a query."""
    w = Window.partitionBy("query_id", F.lower(T.trimmed(F.col("content")))).orderBy("position", "id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def near_dedup(rows: DataFrame, near: float = NEAR) -> DataFrame:
    """In order of position, a row stays unless it is near (Jaccard of word sets) a row that stayed, or equal to an earlier one."""
    rows = written(exact_dedup(rows))  # a bounded list for each query, read three times below
    place = rows.select("query_id", F.col("id").alias("other"), F.col("position").alias("other_position"))
    close = content_pairs(rows).where(F.round("similarity", 9) >= near).join(place, ["query_id", "other"])
    before = (
        rows.select("query_id", "id", "position").join(close, ["query_id", "id"]).where("other_position < position")
        .groupBy("query_id", "id").agg(F.collect_set("other_position").alias("near"))
    )
    none = F.array().cast("array<int>")
    x = F.struct(F.col("position").cast("int").alias("position"), F.coalesce(F.col("near").cast("array<int>"), none).alias("near"))
    lists = rows.select("query_id", "id", "position").join(before, ["query_id", "id"], "left").select("query_id", x.alias("x"))
    folded = lists.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
        "query_id", F.explode(F.aggregate("xs", none, lambda kept, x: F.when(F.arrays_overlap(kept, x["near"]), kept).otherwise(F.concat(kept, F.array(x["position"]))))).alias("position")
    )
    return rows.join(folded, ["query_id", "position"], "left_semi")


def why_selected(detail: str = "detailed") -> Column:
    score = F.round("confidence", 9)
    n, m = F.size("matched"), F.array_join(F.slice("matched", 1, 3), ", ")
    every = F.array_join("matched", ", ")
    terms = {
        "basic": F.concat(F.lit("matches "), n.cast("string"), F.lit(" query terms")),
        "detailed": F.when(n <= 3, F.concat(F.lit("matches terms: "), every)).otherwise(F.concat(F.lit("matches "), n.cast("string"), F.lit(" terms including: "), m)),
        "verbose": F.concat(F.lit("matches all terms: "), every),
    }[detail]
    source = F.lower(F.coalesce("source", F.lit("")))
    return F.concat_ws(
        "; ",
        F.when(score >= 0.8, "high relevance score").when(score >= 0.6, "good relevance score").otherwise("moderate relevance score"),
        F.when(n > 0, terms),
        F.when(F.size("path") > 0, F.concat(F.lit("connected via "), (F.size("path") - 1).cast("string"), F.lit("-hop graph path"))),
        F.when(F.size("related") > 0, F.concat(F.lit("related to "), F.size("related").cast("string"), F.lit(" entities"))),
        F.when(source.contains("official"), "from official source").when(source.contains("verified"), "from verified source"),
        F.when(F.col("age_days") < 1, "very recent content").when(F.col("age_days") < 7, "recent content"),
    )


def relations(query_entities: Column | None = None, context_entities: Column | None = None) -> Column:
    """Map of entity to relation: query entities over related ones, context entities only where absent."""
    pairs = lambda a, label: F.map_from_arrays(F.array_distinct(a), F.array_repeat(F.lit(label), F.size(F.array_distinct(a))))
    none = F.array().cast("array<string>")
    q = query_entities if query_entities is not None else none
    c = context_entities if context_entities is not None else none
    related = F.array_except("related", q)
    context = F.array_except(F.array_except(c, q), F.col("related"))
    return F.map_concat(pairs(related, "related_entity"), pairs(q, "query_entity"), pairs(context, "contextual_entity"))


def provenance(user: str | None = None, columns: tuple[str, ...] = ()) -> Column:
    """columns: what the rows have; version and author come from there, where they are."""
    said = lambda c: F.col(c).cast("string") if c in columns else F.lit(None).cast("string")
    author = F.lit(user) if user is not None else said("author")
    return F.struct(F.col("source").alias("source"), F.col("age_days").alias("age_days"), F.coalesce(said("version"), F.lit("1.0")).alias("version"), author.alias("user_id"))


def assemble(rows: DataFrame, *, least: float = LEAST_CONFIDENCE, near: float = NEAR, limit: int = LIMIT, most_bytes: int = MOST_BYTES, detail: str = "detailed", user: str | None = None) -> DataFrame:
    """Filter, near-duplicate removal, limit, explanation, provenance, validation; rank by confidence."""
    kept = near_dedup(confident(rows, least), near)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "id"))
    kept = kept.withColumn("n", first).where(F.col("n") <= limit).drop("n")
    made = kept.withColumns({"why_selected": why_selected(detail), "provenance": provenance(user, tuple(kept.columns)), "relation_map": relations(), "content": T.cut(F.col("content"), most_bytes)})
    valid = made.where((F.col("content") != "") & (F.coalesce("source", F.lit("")) != "") & F.col("confidence").between(0, 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("confidence", 9)), "id"))
    return valid.withColumn("rank", rank)


def histogram(rows: DataFrame) -> DataFrame:
    """query_id, bucket, n; five buckets of 0.2, closed on the left."""
    c = F.round("confidence", 9)
    bucket = F.when(c >= 0.8, "0.8-1.0").when(c >= 0.6, "0.6-0.8").when(c >= 0.4, "0.4-0.6").when(c >= 0.2, "0.2-0.4").otherwise("0.0-0.2")
    return rows.groupBy("query_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def conflicts(rows: DataFrame, *, gap: float = 0.5, pairs: int | None = None) -> DataFrame:
    """Pairs of a query's results from different sources whose confidences differ by more than `gap`; with `pairs`, of the pairs in row-major
    order the first so many are looked at. A query's list is bounded, and so are its pairs."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "id"))
    one = rows.select("query_id", "id", "source", "confidence", place.alias("i"), n.alias("n"))
    two = one.select("query_id", F.col("id").alias("other"), F.col("source").alias("other_source"), F.col("confidence").alias("other_confidence"), F.col("i").alias("j"))
    number = (F.col("i") - 1) * F.col("n") - F.expr("i * (i - 1) / 2") + (F.col("j") - F.col("i"))
    apart = F.abs(F.round(F.col("confidence") - F.col("other_confidence"), 9)) > gap
    seen = number <= pairs if pairs is not None else F.lit(True)
    return one.join(two, "query_id").where((F.col("i") < F.col("j")) & seen & (F.col("source") != F.col("other_source")) & apart).select("query_id", "id", "other")


def best_per_source(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "source").orderBy(F.desc(F.round("confidence", 9)), "id")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def self_critique(rows: DataFrame) -> DataFrame:
    """query_id, critique: by the mean confidence."""
    mean = F.round(F.avg("confidence"), 9)
    band = F.when(mean < 0.3, "low").when(mean > 0.8, "high").otherwise("moderate")
    return rows.groupBy("query_id").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" results, "), band, F.lit(" confidence")).alias("critique"))
