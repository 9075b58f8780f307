"""Property graph on two tables: nodes(id, type, name) and edges(id, src, dst, type, weight). Directed; parallel edges are allowed.

Iterations join the whole frontier or the whole graph in one job each, and write their state to the shared folder, so that neither
the plan nor the lineage grows with the rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window, functions as F

from ..functions.constants import EDGE_TYPES, NODE_TYPES
from ..functions.text import words_of
from ..sources.tables import dropped, written

CUT_EVERY = 5
#: What a counted table has at most where it is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def nodes_by_type(nodes: DataFrame, kind: str, **properties) -> DataFrame:
    out = nodes.where(F.col("type") == kind)
    for k, v in properties.items():
        out = out.where(F.col(k) == v)
    return out


edges_by_type = nodes_by_type


def neighbors(nodes: DataFrame, edges: DataFrame, of: DataFrame, *, node_types: Sequence[str] = (), edge_types: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """id, neighbor, type: distinct out-neighbours of the ids in `of`; with `most`, the first so many of each id, by name."""
    out = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges
    found = out.join(of.select("id"), out["src"] == of["id"]).select(of["id"].alias("id"), F.col("dst").alias("neighbor")).distinct()
    kinds = nodes.where(F.col("type").isin(*node_types)) if node_types else nodes
    out = found.join(kinds.select(F.col("id").alias("neighbor"), "type"), "neighbor").select("id", "neighbor", "type")
    if most is None:
        return out
    place = F.row_number().over(Window.partitionBy("id").orderBy("neighbor"))
    return out.withColumn("place", place).where(F.col("place") <= most).drop("place")


def valid_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.coalesce("id", F.lit("")) != "") & F.col("type").isin(*NODE_TYPES))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Named ends that exist, a known type, a weight of 0 or more."""
    fine = edges.where((F.coalesce("id", F.lit("")) != "") & F.col("type").isin(*EDGE_TYPES) & (F.col("weight") >= 0))
    ids = nodes.select("id")
    return fine.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def rejected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(valid_edges(edges, nodes).select("id"), "id", "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in `gone` (id), and edges that touch none of them."""
    ids = gone.select("id")
    rest = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), rest.select(*edges.columns)


def paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int, *, edge_types: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """src, dst, nodes, edges, cost of all simple paths of at most max_depth edges, a whole frontier a round. A path stops at an end. Each
    frontier is written, so that no round runs the rounds before it again. With `most`, the cheapest so many of each pair, ties by fewer
    edges and by name."""
    steps = edges.where(F.col("type").isin(*edge_types)) if edge_types else edges
    steps = steps.select(F.col("id").alias("edge"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight")
    goal = ends.select(F.col("id").alias("at"), F.lit(True).alias("goal")).distinct()
    front = starts.select(F.col("id").alias("src"), F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0.0).alias("cost"))
    found = None
    for depth in range(max_depth + 1):
        marked = front.join(goal, "at", "left")
        done = marked.where("goal").select("src", F.col("at").alias("dst"), "nodes", "edges", "cost")
        found = done if found is None else found.unionByName(done)
        if depth == max_depth:
            break
        front = (
            marked.where("goal IS NULL").join(steps, "at").where(~F.array_contains("nodes", F.col("to")))
            .select("src", F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("edge")).alias("edges"), (F.col("cost") + F.col("weight")).alias("cost"))
        )
        front = written(front)
    if most is None:
        return found
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.round("cost", 9), F.size("nodes"), "nodes"))
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int = 10) -> DataFrame:
    """The cheapest path of each pair; ties by fewer edges, then by name."""
    every = paths(edges, starts, ends, max_depth)
    return every.groupBy("src", "dst").agg(F.min(F.struct(F.round("cost", 9).alias("c"), F.size("nodes").alias("n"), "nodes", "edges", "cost")).alias("p")).select("src", "dst", "p.nodes", "p.edges", "p.cost")


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 10, tolerance: float | None = None) -> DataFrame:
    """id, score. Mass is conserved: what dangling nodes hold is spread over all. Distinct targets count. Stops early within tolerance. A
    round is one job: what dangling nodes hold is observed while its scores are written, and the scores before are deleted then."""
    n = nodes.count()
    ids = nodes.select("id")
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    links = edges.select("src", "dst").distinct()
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = written(links.join(out, "src"))
    base = written(ids.join(out.select(F.col("src").alias("id"), F.lit(True).alias("gives")), "id", "left").select("id", F.col("gives").isNull().alias("sink")))
    loose = base.where("sink").count() / n
    scores = base.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        seen = Observation()
        given = links.join(scores.select("id", "score"), links["src"] == scores["id"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        score = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / n))
        new = base.join(given, base["id"] == given["dst"], "left").select("id", "sink", score.alias("score"))
        new = written(new.observe(seen, F.sum(F.when(F.col("sink"), F.col("score"))).alias("loose")))  # the next round reads it
        loose = seen.get["loose"] or 0.0
        done = False
        if tolerance is not None:
            done = new.join(scores.select("id", F.col("score").alias("old")), "id").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] <= tolerance
        dropped(scores)
        scores = new
        if done:
            break
    return scores.select("id", "score")


def pagerank_unnormalized(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """id, score from 1.0; parallel edges count; dangling mass is lost."""
    ids = nodes.select("id")
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    links = written(edges.select("src", "dst").join(out, "src"))
    scores, cut = ids.withColumn("score", F.lit(1.0)), None
    for turn in range(rounds):
        given = links.join(scores, links["src"] == scores["id"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        scores = ids.join(given, ids["id"] == given["dst"], "left").select("id", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if turn % CUT_EVERY == CUT_EVERY - 1:
            before, scores = cut, written(scores)
            dropped(*([before] if before is not None else []))
            cut = scores
    return scores


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id that is connected, whichever way edges point. Labels spread to neighbours and then jump to their own
    label's label, so rounds grow with the logarithm of the diameter in the usual case; stops when nothing moves."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels, last = nodes.select("id", F.col("id").alias("component")).distinct(), None
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = written(labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("next")))
        root = step.groupBy("component").agg(F.min("next").alias("root"))
        root = root.join(root.select(F.col("component").alias("root"), F.col("root").alias("further")), "root").select("component", F.col("further").alias("root"))
        new = written(step.join(root, "component").select("id", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("moved")))
        dropped(step, *([last] if last is not None else []))
        labels, last = new.select("id", "component"), new
        if new.where("moved").isEmpty():
            return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def type_communities(nodes: DataFrame) -> DataFrame:
    """type, n, score, summary: nodes grouped by type."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("score")).withColumn("summary", F.concat(F.lit("Community of "), "type", F.lit(" nodes")))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Extension: nodes, edges, density, mean and greatest out-degree over nodes that have one."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"), F.sum("d").alias("edges"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    one = n.withColumn("k", F.lit(1)).join(degree.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return one.withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def name_search(nodes: DataFrame, queries: DataFrame, *, most: int | None = None) -> DataFrame:
    """query_id, id, score: Entity nodes whose name holds a word of the query, whatever the case; the score is always 0.8. With `most`, the
    first so many ids of each query, by id.

    Ids whose names hold the same words are a class, and queries meet classes: a word that all names hold is one row for each query, not one
    for each name, and no pair of a query and an id is made twice or shuffled to be counted once."""
    terms = queries.select("query_id", F.explode(F.array_distinct(words_of(F.lower("query")))).alias("term"))
    found = _held_words(nodes.where("type = 'Entity'").select("id", F.lower("name").alias("name")), terms.select("term").distinct())
    held = written(found.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("held")))
    classes = held.select("held").distinct().select("held", F.explode("held").alias("term"))
    asked = written(classes.join(terms, "term").select("held", "query_id").distinct())
    first = lambda rows, of: rows.withColumn("place", F.row_number().over(Window.partitionBy(of).orderBy("id"))).where(F.col("place") <= most).drop("place")
    if most is not None:
        held = first(held, "held")  # a query's first ids are among those of its classes
    out = held.join(_small(asked), "held").select("query_id", "id", F.lit(0.8).alias("score"))
    return out if most is None else first(out, "query_id")


def _held_words(names: DataFrame, terms: DataFrame) -> DataFrame:
    """id, term: the terms that each name holds. A term meets only the names that hold its rarest run of three characters (all of a shorter
    one), and none if no name holds one of its runs."""
    runs = lambda c, sizes: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.transform(F.array(*map(F.lit, sizes)), lambda k: F.substring(c, i, k))))
    keyed = names.select("id", "name", F.explode(F.array_distinct(runs(F.col("name"), (1, 2, 3)))).alias("key"))
    inner = F.when(F.length("term") <= 3, F.array("term")).otherwise(F.filter(runs(F.col("term"), (3,)), lambda x: F.length(x) == 3))
    parts = written(terms.select("term", F.explode(F.array_distinct(inner)).alias("key")))
    often = written(keyed.select("key").join(_small(parts.select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("m")))
    rarest = F.min(F.struct(F.coalesce("m", F.lit(0)).alias("m"), "key")).alias("b")
    best = written(parts.join(_small(often), "key", "left").groupBy("term").agg(rarest).where("b.m > 0").select("term", "b.key"))
    return keyed.join(_small(best), "key").where(F.contains("name", "term")).select("id", "term")


def _small(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast where they are few and short; beyond that the join is Catalyst's choice."""
    n, size = rows.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else rows
