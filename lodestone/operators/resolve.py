"""Entity resolution: name similarity by character bigrams, duplicates, candidates in a store, best matches, merges, links.

Equal names of a type (trimmed, lower case) form a class, of which the least id alone goes on: a hundred thousand copies of a name are
one row of every join. Pairs of classes come from a prefix filter on bigrams within a type (rarest first), not from all pairs: two names
of one type whose score passes the threshold share a bigram among the first few of each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..sources.tables import written
from . import text_search as TS, vector_search as VS

NAME_WEIGHT, TYPE_WEIGHT, THRESHOLD = 0.7, 0.3, 0.8
CANDIDATES, BOOST = 10, 0.1


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names (trimmed, lower case), else the Jaccard of their bigrams."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).otherwise(T.jaccard(T.bigrams(x), T.bigrams(y)))


def classes(entities: DataFrame) -> DataFrame:
    """rep, id: the least id of the entities with each one's type and name, and the entity."""
    named = entities.select("id", "etype", F.lower(F.trim("name")).alias("name"))
    reps = named.groupBy("etype", "name").agg(F.min("id").alias("rep"))
    return named.join(reps, (named["etype"].eqNullSafe(reps["etype"])) & (named["name"].eqNullSafe(reps["name"]))).select("rep", "id")


def similar_pairs(entities: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), name_sim: pairs of classes (their least ids) of one type whose name similarity is at least `least` (> 0).
    entities: id, etype, name. Members of one class have similarity 1; `classes` names them."""
    named = entities.groupBy("etype", F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("id"))
    grams = named.select("id", "etype", "name", F.explode(F.when(F.size(T.bigrams(F.col("name"))) > 0, T.bigrams(F.col("name"))).otherwise(F.array("name"))).alias("g"))
    rarity = grams.groupBy("etype", "g").agg(F.count(F.lit(1)).alias("m"))
    sets = grams.join(rarity, ["etype", "g"]).groupBy("id", "etype", "name").agg(F.array_sort(F.collect_list(F.struct("m", "g"))).alias("x"))
    keep = F.size("x") - F.ceil(F.size("x") * F.lit(least) - 1e-9).cast("int") + 1
    prefix = sets.select("id", "etype", "name", F.explode(F.slice("x", F.lit(1), keep)).alias("e")).select("id", "etype", "name", F.col("e.g").alias("g"))
    other = prefix.select("etype", "g", F.col("id").alias("b"), F.col("name").alias("other"))
    pairs = prefix.join(other, ["etype", "g"]).where("id < b").select(F.col("id").alias("a"), "b", "name", "other").distinct()
    return pairs.select("a", "b", name_similarity(F.col("name"), F.col("other")).alias("name_sim")).where(F.round("name_sim", 9) >= least)


def duplicates(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity over the threshold: pairs of classes, and each further member of a class with its least id. 0.7 name + 0.3 for one
    type; different types cannot pass a threshold over 0.7."""
    pairs = _class_pairs(entities, threshold)
    return pairs.unionByName(classes(entities).where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(NAME_WEIGHT + TYPE_WEIGHT).alias("similarity")))


def _class_pairs(entities: DataFrame, threshold: float) -> DataFrame:
    if threshold < NAME_WEIGHT:
        raise ValueError("pairs of different types would pass; they are not searched")
    least = (threshold - TYPE_WEIGHT) / NAME_WEIGHT
    pairs = similar_pairs(entities, math.floor(least * 1e9) / 1e9)
    return pairs.select("a", "b", (F.col("name_sim") * NAME_WEIGHT + TYPE_WEIGHT).alias("similarity")).where(F.round("similarity", 9) > threshold)


def deduplicate(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """An entity goes if a duplicate of it has a higher confidence, or the same and a smaller id; of equals the smallest id stays. The best
    member of a class speaks for it, so the work is in proportion to the members and to the pairs of classes."""
    place = F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("i"))
    own = entities.select("id", place.alias("place")).join(classes(entities), "id")
    best = own.groupBy("rep").agg(F.min("place").alias("best"))
    pairs = _class_pairs(entities, threshold)
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(best, both["b"] == best["rep"]).select(F.col("a").alias("rep"), "best").unionByName(best).groupBy("rep").agg(F.min("best").alias("best"))
    gone = own.join(near, "rep").where("place > best").select("id")
    return entities.join(gone, "id", "left_anti")


def candidates_by_name(entities: DataFrame, stored: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """id, candidate, place: the k stored entities whose names hold most tokens of the entity's name, ties by id. Equal names are searched
    once."""
    names = entities.groupBy(F.col("name").alias("query")).agg(F.min("id").alias("query_id"))
    found = TS.index_search(stored.select("id", F.col("name").alias("content")), names, k)
    asked = entities.select("id", F.col("name").alias("query")).join(names, "query")
    return asked.join(found.select("query_id", F.col("id").alias("candidate"), F.col("rank").alias("place")), "query_id").select("id", "candidate", "place")


def candidates_by_embedding(entities: DataFrame, stored: DataFrame, k: int = CANDIDATES, least: float = THRESHOLD) -> DataFrame:
    """id, candidate, place, cosine: the k stored entities nearest by embedding, of equal dimension and a cosine of `least` or more. Ids are
    longs here."""
    near = VS.nearest(stored.select("id", "embedding"), entities.where(F.size("embedding") > 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("qe")), k)
    dims = lambda t, name: t.select(F.col("id").alias(name), F.size("embedding").alias(f"{name}_dims"))
    same = near.withColumnsRenamed({"id": "candidate"}).join(dims(entities, "query_id"), "query_id").join(dims(stored, "candidate"), "candidate").where("query_id_dims = candidate_dims")
    return same.where(F.round("similarity", 9) >= least).select(F.col("query_id").alias("id"), "candidate", F.col("rank").alias("place"), F.col("similarity").alias("cosine"))


def best_match(entities: DataFrame, stored: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, candidate, similarity: of an entity's candidates (id, candidate, place) the most similar over the threshold (0.7 name, 0.3 type);
    ties by place."""
    a = entities.select("id", "etype", "name")
    b = stored.select(F.col("id").alias("candidate"), F.col("etype").alias("other_type"), F.col("name").alias("other_name"))
    score = name_similarity(F.col("name"), F.col("other_name")) * NAME_WEIGHT + F.when(F.col("etype") == F.col("other_type"), TYPE_WEIGHT).otherwise(0.0)
    scored = candidates.join(a, "id").join(b, "candidate").withColumn("similarity", score).where(F.round("similarity", 9) > threshold)
    top = F.max_by(F.struct("candidate", "similarity"), F.struct(F.round("similarity", 9).alias("s"), (-F.col("place")).alias("p")))
    return scored.groupBy("id").agg(top.alias("m")).select("id", "m.candidate", "m.similarity")


def link(entities: DataFrame, stored: DataFrame, candidates: DataFrame | None = None, *, threshold: float = THRESHOLD, boost: float = BOOST) -> tuple[DataFrame, DataFrame]:
    """(entities, edges). An entity with a best match among its candidates (by name where none are given) takes the stored one in: `merged`,
    confidence raised by `boost`, 1 at most; an edge RELATED_TO joins the two, weighted by the cosine of the candidates where they have one.
    Others stay as they are. entities and stored: id, etype, name, confidence, source, properties."""
    candidates = candidates_by_name(entities, stored) if candidates is None else candidates
    best = written(best_match(entities, stored, candidates, threshold))  # read for the entities and for the edges
    matched = best.join(stored.withColumnRenamed("id", "candidate"), "candidate").select("id", "etype", "name", "confidence", "source", "properties")
    taken = merged(entities, matched).join(best.select("id", F.lit(True).alias("hit")), "id", "left")
    raised = F.when(F.col("hit"), F.least(F.col("confidence") + F.lit(boost), F.lit(1.0))).otherwise(F.col("confidence"))
    weight = F.col("similarity")
    pairs = best.select(F.col("id").alias("a"), F.col("candidate").alias("b"), weight.alias("similarity"))
    if "cosine" in candidates.columns:
        pairs = best.join(candidates.select("id", "candidate", "cosine"), ["id", "candidate"]).select(F.col("id").alias("a"), F.col("candidate").alias("b"), F.col("cosine").alias("similarity"))
    return taken.withColumn("confidence", raised).drop("hit"), links(pairs)


def resolve(entities: DataFrame, stored: DataFrame, candidates: DataFrame | None = None, *, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(entities, edges): duplicates within the batch go, the rest are linked to the store."""
    return link(written(deduplicate(entities, threshold)), stored, candidates, threshold=threshold)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of first(id, etype, name, confidence, source, properties) with the match of the same id in second taken in: its properties win, the
    higher confidence stays, and name, type and source are those of the more confident."""
    b = second.select("id", *(F.col(c).alias("b_" + c) for c in ("etype", "name", "confidence", "source", "properties")))
    j = first.join(b, "id", "left")
    better = F.coalesce(F.col("b_confidence") > F.col("confidence"), F.lit(False))
    pick = lambda c: F.when(better, F.col("b_" + c)).otherwise(F.col(c)).alias(c)
    none = F.create_map().cast("map<string,string>")
    own, new = F.coalesce("properties", none), F.coalesce("b_properties", none)
    properties = F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return j.select("id", pick("etype"), pick("name"), F.greatest("confidence", F.coalesce("b_confidence", "confidence")).alias("confidence"), pick("source"), properties.alias("properties"))


def links(pairs: DataFrame) -> DataFrame:
    """Edges RELATED_TO of matched pairs(a, b, similarity); nodes are written before edges."""
    name = F.concat(F.lit("link_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string"))
    return pairs.select(name.alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED_TO").alias("type"), F.col("similarity").alias("weight"))
