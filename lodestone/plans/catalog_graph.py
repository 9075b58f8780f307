"""Registered graph queries, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import graph_tables as GT, tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ROUNDS = 10


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _both(spark, d):
    return GT.nodes(spark, d), GT.edges(spark, d)


@_register("g_nodes_by_type", f"WITH {GT.SQL} SELECT id, name FROM nodes WHERE type = 'Entity'")
def g_nodes_by_type(spark, d):
    return G.nodes_by_type(GT.nodes(spark, d), "Entity").select("id", "name")


@_register("g_edges_by_type", f"WITH {GT.SQL} SELECT id, src, dst, weight FROM edges WHERE type = 'PART_OF' AND weight = 1.0")
def g_edges_by_type(spark, d):
    return G.edges_by_type(GT.edges(spark, d), "PART_OF", weight=1.0).select("id", "src", "dst", "weight")


@_register("g_neighbors", f"WITH {GT.SQL} SELECT DISTINCT e.src AS id, e.dst AS neighbor, n.type FROM edges e JOIN nodes s ON s.id = e.src AND s.type IN ('Event', 'Source') JOIN nodes n ON n.id = e.dst WHERE n.type = 'Entity'")
def g_neighbors(spark, d):
    nodes, edges = _both(spark, d)
    return G.neighbors(nodes, edges, nodes.where("type IN ('Event', 'Source')").select("id"), node_types=["Entity"])


@_register("g_delete_cascade", f"WITH {GT.SQL}, gone AS (SELECT id FROM nodes WHERE name = 'FRANCE' OR id LIKE 'c1%') SELECT type, count(*) AS n, sum(weight) AS weight FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type")
def g_delete_cascade(spark, d):
    nodes, edges = _both(spark, d)
    _, rest = G.delete_nodes(nodes, edges, nodes.where("name = 'FRANCE' OR id LIKE 'c1%'"))
    return rest.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@_register("g_rejected_edges", f"WITH {GT.SQL}, few AS (SELECT id FROM nodes WHERE type <> 'Event') SELECT id, type FROM edges WHERE src NOT IN (SELECT id FROM few) OR dst NOT IN (SELECT id FROM few)")
def g_rejected_edges(spark, d):
    nodes, edges = _both(spark, d)
    return G.rejected_edges(edges, nodes.where("type <> 'Event'")).select("id", "type")


_PATHS = f"""WITH RECURSIVE {GT.SQL}, p AS (SELECT id AS src, id AS here, [id] AS ns, []::VARCHAR[] AS es, 0.0::DOUBLE AS cost, 0 AS depth FROM nodes WHERE type IN ('Event', 'Source')
UNION ALL SELECT p.src, e.dst, list_append(ns, e.dst), list_append(es, e.id), cost + e.weight, depth + 1 FROM p JOIN edges e ON e.src = p.here WHERE depth < 3 AND NOT starts_with(p.here, 'r') AND NOT list_contains(ns, e.dst))"""


@_register("g_paths", f"{_PATHS} SELECT src, here AS dst, array_to_string(ns, '>') AS nodes, len(es)::INTEGER AS hops, round(cost, 6) AS cost FROM p WHERE starts_with(here, 'r')")
def g_paths(spark, d):
    nodes, edges = _both(spark, d)
    found = G.paths(edges, nodes.where("type IN ('Event', 'Source')"), nodes.where("id LIKE 'r%'"), 3)
    return found.select("src", "dst", F.array_join("nodes", ">").alias("nodes"), F.size("edges").alias("hops"), F.round("cost", 6).alias("cost"))


@_register("g_shortest_path", f"{_PATHS}, r AS (SELECT src, here AS dst, ns, es, cost FROM p WHERE starts_with(here, 'r') QUALIFY row_number() OVER (PARTITION BY src, here ORDER BY round(cost, 9), len(ns), ns) = 1) SELECT src, dst, array_to_string(ns, '>') AS nodes, round(cost, 6) AS cost FROM r")
def g_shortest_path(spark, d):
    nodes, edges = _both(spark, d)
    found = G.shortest_paths(edges, nodes.where("type IN ('Event', 'Source')"), nodes.where("id LIKE 'r%'"), 3)
    return found.select("src", "dst", F.array_join("nodes", ">").alias("nodes"), F.round("cost", 6).alias("cost"))


def _unrolled(start: str, step: str) -> str:
    out = [f"p0 AS MATERIALIZED ({start})"]
    for k in range(_ROUNDS):
        out.append(f"p{k + 1} AS MATERIALIZED ({step.replace('@', f'p{k}')})")
    return ", ".join(out)


_PR = f"""WITH {GT.SQL}, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), o AS (SELECT src, count(*) AS degree FROM l GROUP BY src), c AS (SELECT count(*)::DOUBLE AS n FROM nodes),
{_unrolled("SELECT id, 1 / (SELECT n FROM c) AS score FROM nodes", '''SELECT id, 0.15::DOUBLE / (SELECT n FROM c) + 0.85::DOUBLE * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM @ WHERE id NOT IN (SELECT src FROM o)) / (SELECT n FROM c)) AS score
FROM nodes LEFT JOIN (SELECT dst, sum(score / degree) AS got FROM l JOIN o USING (src) JOIN @ ON @.id = l.src GROUP BY dst) x ON x.dst = nodes.id''')}"""


@_register("g_pagerank", f"{_PR} SELECT id, round(score, 9) AS score FROM p{_ROUNDS}")
def g_pagerank(spark, d):
    nodes, edges = _both(spark, d)
    return G.pagerank(nodes, edges, rounds=_ROUNDS).select("id", F.round("score", 9).alias("score"))


_PU = f"""WITH {GT.SQL}, o AS (SELECT src, count(*) AS degree FROM edges GROUP BY src),
{_unrolled("SELECT id, 1.0::DOUBLE AS score FROM nodes", '''SELECT id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(got, 0) AS score
FROM nodes LEFT JOIN (SELECT dst, sum(score / degree) AS got FROM edges JOIN o USING (src) JOIN @ ON @.id = edges.src GROUP BY dst) x ON x.dst = nodes.id''')}"""


@_register("g_pagerank_unnormalized", f"{_PU} SELECT id, round(score, 6) AS score FROM p{_ROUNDS}")
def g_pagerank_unnormalized(spark, d):
    nodes, edges = _both(spark, d)
    return G.pagerank_unnormalized(nodes, edges, rounds=_ROUNDS).select("id", F.round("score", 6).alias("score"))


# trees of foreign keys have a diameter of 6 and conversations are short chains: 40 rounds reach every label there
_CC = ", ".join(
    ["b AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)", "l0 AS MATERIALIZED (SELECT id, id AS c FROM nodes)"]
    + [f"l{k + 1} AS MATERIALIZED (SELECT l.id, least(l.c, min(m.c)) AS c FROM l{k} l LEFT JOIN b ON b.a = l.id LEFT JOIN l{k} m ON m.id = b.b GROUP BY l.id, l.c)" for k in range(40)]
)


@_register("g_components", f"WITH {GT.SQL}, {_CC} SELECT id, c AS component FROM l40")
def g_components(spark, d):
    return G.components(*_both(spark, d))


@_register("g_component_sizes", f"WITH {GT.SQL}, {_CC} SELECT c AS component, count(*) AS size FROM l40 GROUP BY c")
def g_component_sizes(spark, d):
    return G.component_sizes(G.components(*_both(spark, d)))


@_register("g_type_communities", f"WITH {GT.SQL} SELECT type, count(*) AS n, 1.0::DOUBLE AS score, 'Community of ' || type || ' nodes' AS summary FROM nodes GROUP BY type")
def g_type_communities(spark, d):
    return G.type_communities(GT.nodes(spark, d))


@_register("g_metrics", f"WITH {GT.SQL} SELECT nodes, avg(d) AS mean_degree, max(d) AS max_degree, sum(d)::BIGINT AS edges, sum(d) / (nodes * (nodes - 1))::DOUBLE AS density FROM (SELECT src, count(*) AS d FROM edges GROUP BY src), (SELECT count(*) AS nodes FROM nodes) GROUP BY nodes")
def g_metrics(spark, d):
    return G.metrics(*_both(spark, d))


@_register("g_name_search", f"WITH {GT.SQL}, t AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> ''))) AS term FROM benchmark) SELECT DISTINCT query_id, id, 0.8::DOUBLE AS score FROM nodes JOIN t ON type = 'Entity' AND contains(lower(name), term)")
def g_name_search(spark, d):
    return G.name_search(GT.nodes(spark, d), S.text_queries(spark, d))
