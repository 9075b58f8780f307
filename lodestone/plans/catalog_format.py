"""Registered queries of formatting and of the views side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as EV, format as FM
from ..sources import graph_tables as GT, tables as S
from . import catalog_search as CS, recall as RC

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


@_register("fmt_evidence", f"""WITH {CS._EV}, b AS (SELECT *, {CS._WHY} AS why_selected FROM ea QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY round(ea.confidence, 9) DESC, id) = 1)
SELECT query_id, id, CASE WHEN strlen(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END AS content, round(confidence, 3) AS confidence, source, why_selected,
row_number() OVER (PARTITION BY query_id ORDER BY round(b.confidence, 9) DESC, id)::INTEGER AS rank FROM b""")
def fmt_evidence(spark, d):
    return FM.evidence(CS.assembly(spark, d).withColumn("why_selected", EV.why_selected()), group=True)


@_register("fmt_cards", """SELECT 'n' || n_nationkey AS id, n_name AS title, array_to_string(list_sort(list(c_name))[1:10], ',') AS entities, count(*) AS entity_count FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def fmt_cards(spark, d):
    nation, customer = S.table(spark, d, "nation"), S.table(spark, d, "customer")
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    members = joined.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.lit("").alias("summary"), F.col("c_name").alias("entity"))
    return FM.cards(members).select("id", "title", F.array_join("entities", ",").alias("entities"), "entity_count")


_ORDERS = "SELECT 'o' || o_orderkey AS id, o_orderstatus AS kind, lower(substring(o_orderpriority, 3)) AS severity FROM orders"


@_register("fmt_conflicts", f"""WITH o AS ({_ORDERS}), e AS (SELECT 'o' || event_id AS id, event_type AS kind, 'warn' AS severity FROM events), u AS (SELECT *, 0 AS l FROM o UNION ALL SELECT *, 1 FROM e),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY l) = 1),
s AS (SELECT id, kind, CASE WHEN severity IN ('critical', 'high', 'medium', 'low') THEN severity WHEN severity IN ('error', 'severe') THEN 'high' WHEN severity IN ('warning', 'warn') THEN 'medium' WHEN severity IN ('info', 'information') THEN 'low' ELSE 'medium' END AS severity FROM f)
SELECT id, kind, severity, (CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END)::INTEGER AS weight FROM s""")
def fmt_conflicts(spark, d):
    orders = S.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("kind"), F.lower(F.expr("substring(o_orderpriority, 3)")).alias("severity"))
    events = S.table(spark, d, "events").select(F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.lit("warn").alias("severity"))
    return FM.merged_conflicts(orders, events)


@_register("fmt_ids", "SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(list_transform([p_name, p_type, p_type], lambda x: CASE WHEN strlen(x) > 16 THEN substring(x, 1, 16) || '...' ELSE x END))), ',') AS ids FROM part")
def fmt_ids(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(FM.entity_ids(F.array("p_name", "p_type", "p_type")), ",").alias("ids"))


@_register("mv_retrieve", f"""WITH {CS._IX}, {CS._VS}, {CS._nearest(10)}, {GT.SQL},
nt AS (SELECT query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> ''))) AS term FROM q),
ng AS (SELECT DISTINCT query_id, id FROM nodes JOIN nt ON type = 'Entity' AND contains(lower(name), term))
SELECT query_id, 'text' AS view, id::VARCHAR AS id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY ix.score DESC, ix.id)::INTEGER AS rank FROM ix QUALIFY rank <= 10
UNION ALL SELECT query_id, 'vector', id::VARCHAR, round(similarity, 6), rank::INTEGER FROM vn
UNION ALL SELECT query_id, 'graph', id, 0.8::DOUBLE, row_number() OVER (PARTITION BY query_id ORDER BY id)::INTEGER AS r FROM ng QUALIFY r <= 10""")
def mv_retrieve(spark, d):
    out = RC.multi_view(S.documents(spark, d), S.vectors(spark, d), GT.nodes(spark, d), S.text_queries(spark, d), S.vector_queries(spark, d))
    return out.withColumn("score", F.round("score", 6))
