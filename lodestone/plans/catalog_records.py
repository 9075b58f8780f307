"""Registered queries of records: point operations, files, validation of records, linking to a store, writes, whole recall, and streams that
are replayed from stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import BLOCKED_IN_CONTENT
from ..functions.dialect import sql_text
from ..operators import evidence as EV, graph as G, preprocess as P, provenance as PR, records as RE, resolve as R, storage as ST, text_search as TS, understand as U, validate as V
from ..sources import graph_tables as GT, tables as S
from ..streaming import ingest as I
from . import catalog_graph as CG, catalog_ingest as CI, catalog_search as CS, catalog_understand as CU, recall as RC

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _folder(spark) -> str:
    return f"{S.shared_dir(spark)}/lodestone/records-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- point operations and files


@_register("st_get", "SELECT vec_id AS id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id = 7")
def st_get(spark, d):
    return ST.get(S.vectors(spark, d), "id", 7).select("id", "label", F.col("score").cast("double").alias("score"))


@_register("st_exists", "SELECT DISTINCT l_orderkey AS id, l_orderkey IN (SELECT doc_id FROM documents) AS found FROM lineitem")
def st_exists(spark, d):
    return ST.exists(S.documents(spark, d), S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct(), "id")


@_register("st_update_edges", f"WITH {GT.SQL} SELECT id, src, CASE WHEN type = 'PART_OF' THEN 2.0 ELSE weight END::DOUBLE AS weight FROM edges")
def st_update_edges(spark, d):
    edges = GT.edges(spark, d)
    batch = edges.where("type = 'PART_OF'").select("id", F.lit(2.0).alias("weight"))
    return ST.update(edges, batch, "id", ["weight"]).select("id", "src", "weight")


@_register("st_missing_edges", f"WITH {GT.SQL} SELECT 'x' || id AS id FROM edges WHERE type = 'PART_OF'")
def st_missing_edges(spark, d):
    """Updates of edges that are not there are reported."""
    edges = GT.edges(spark, d)
    asked = edges.where("type = 'PART_OF'").select("id").unionByName(edges.where("type = 'PART_OF'").select(F.concat(F.lit("x"), "id").alias("id")))
    return ST.missing(edges, asked, "id")


@_register("st_delete_edges", f"WITH {GT.SQL} SELECT type, count(*) AS n FROM edges WHERE NOT starts_with(src, 'c1') GROUP BY type")
def st_delete_edges(spark, d):
    edges = GT.edges(spark, d)
    return ST.delete(edges, edges.where("src LIKE 'c1%'").select("id"), "id").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@_register("st_save_load", f"WITH {GT.SQL} SELECT id, src, dst, type, weight FROM edges")
def st_save_load(spark, d):
    """Edges through a JSON file in the shared folder and back."""
    path = _folder(spark)
    ST.save(GT.edges(spark, d), path, form="json")
    return ST.load(spark, path, "id string, src string, dst string, type string, weight double", form="json")


@_register("g_valid_nodes", f"WITH {GT.SQL} SELECT id, type FROM nodes WHERE id <> '' AND type IN ('Entity', 'Claim', 'Event', 'Task', 'Source', 'ConversationTurn') UNION ALL SELECT 'good', 'Claim'")
def g_valid_nodes(spark, d):
    odd = spark.createDataFrame([("", "Entity", "no id"), ("bad", "Nothing", "no type"), ("good", "Claim", "fine"), (None, "Event", "null id")], "id string, type string, name string")
    return G.valid_nodes(GT.nodes(spark, d).unionByName(odd)).select("id", "type")


@_register("g_neighbors_most", f"WITH {GT.SQL}, r AS (SELECT DISTINCT dst AS id, src AS neighbor FROM edges WHERE type = 'PART_OF') SELECT id, neighbor FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY neighbor) <= 3")
def g_neighbors_most(spark, d):
    """The first three parts of each whole: edges turned round, at most three neighbours."""
    nodes, edges = GT.nodes(spark, d), GT.edges(spark, d)
    turned = edges.select("id", F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
    return G.neighbors(nodes, turned, nodes, edge_types=["PART_OF"], most=3).select("id", "neighbor")


@_register("g_paths_cheapest", f"{CG._PATHS}, r AS (SELECT src, here AS dst, ns, cost FROM p WHERE starts_with(here, 'r') QUALIFY row_number() OVER (PARTITION BY src, here ORDER BY round(cost, 9), len(ns), ns) = 1) SELECT src, dst, array_to_string(ns, '>') AS nodes, round(cost, 6) AS cost FROM r")
def g_paths_cheapest(spark, d):
    nodes, edges = GT.nodes(spark, d), GT.edges(spark, d)
    found = G.paths(edges, nodes.where("type IN ('Event', 'Source')"), nodes.where("id LIKE 'r%'"), 3, most=1)
    return found.select("src", "dst", F.array_join("nodes", ">").alias("nodes"), F.round("cost", 6).alias("cost"))


@_register("g_filter_properties", f"WITH {GT.SQL} SELECT id FROM nodes WHERE type = 'Event' AND name = '1-URGENT'")
def g_filter_properties(spark, d):
    return G.nodes_by_type(GT.nodes(spark, d), "Event", name="1-URGENT").select("id")


# ---------------------------------------------------------------- chunks by sentence and paragraph


def _sized(text: str, most: int, overlap: int, tag: str, keys: str) -> str:
    """Recursive size chunks of rows(keys, text) of the relation `tag`, as z(keys, ordinal, s, e)."""
    back = "(length(w) - instr(reverse(w), ' '))"
    on = " AND ".join(f"z.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"z.{k}" for k in keys.split(", "))
    return f"""z AS (SELECT {keys}, 0 AS m, 0 AS s, CASE WHEN length({text}) <= {most} THEN length({text}) WHEN instr(reverse(w), ' ') > 0 AND {back} > {most // 2} THEN {back} ELSE {most} END AS e FROM (SELECT {keys}, {text}, substring({text}, 1, {most}) AS w FROM {tag}) WHERE length({text}) > 0
UNION ALL SELECT {keys}, m + 1, s, CASE WHEN s + {most} >= length({text}) THEN length({text}) WHEN instr(reverse(w), ' ') > 0 AND {back} > {most // 2} THEN s + {back} ELSE s + {most} END
FROM (SELECT {own}, m, greatest(e - {overlap}, s + 1) AS s, y.{text}, substring(y.{text}, greatest(e - {overlap}, s + 1) + 1, {most}) AS w FROM z JOIN {tag} y ON {on} WHERE e < length(y.{text})))"""


_M, _O = CI.MOST, CI.OVERLAP
_SENTENCED = f"""{CI._PACK}, sp AS (SELECT id, x.kind AS kind, x.a AS n, coalesce(list_sum(l[1:x.a - 1]), 0)::INTEGER AS st, list_sum(l[1:x.b])::INTEGER AS en FROM (SELECT id, l, unnest(o) AS x FROM pk WHERE len(o) > 0)),
st AS (SELECT sp.id, n, kind, st, substring(content, st + 1, en - st) AS t FROM sp JOIN tx ON tx.id = sp.id), lo AS (SELECT id, n, t FROM st WHERE kind = 1), {_sized("t", _M, _O, "lo", "id, n")},
ss AS (SELECT id, n, 0 AS m, 'sentence' AS strategy, st AS s, st + length(t) AS e, t AS chunk FROM st WHERE kind = 0 UNION ALL SELECT z.id, z.n, m, 'sentence-size', st + s, st + e, substring(st.t, s + 1, e - s) FROM z JOIN st ON st.id = z.id AND st.n = z.n AND kind = 1)"""


@_register("ch_sentence", f"WITH RECURSIVE {_SENTENCED} SELECT id, (row_number() OVER (PARTITION BY id ORDER BY n, e) - 1)::INTEGER AS ordinal, strategy, s::INTEGER AS \"start\", e::INTEGER AS \"end\", md5(chunk) AS digest FROM ss")
def ch_sentence(spark, d):
    return P.chunk_by_sentence(CI.texts(spark, d), most=_M, overlap=_O).select("id", "ordinal", "strategy", "start", "end", F.md5(F.col("chunk").cast("binary")).alias("digest"))


_PARAGRAPHS = rf"list_filter(list_transform(string_split_regex(content, '\n[\t\n\f\r ]*\n'), lambda x: {CI._trim('x')}), lambda x: x <> '')"
#: No paragraph is longer than this.
_WIDE = 200_000
_PARAGRAPHED = f"""{CI._TX}, pa AS (SELECT id, {_PARAGRAPHS} AS p FROM tx),
pg AS (SELECT id, p, 0 AS i, ''::VARCHAR AS now, []::VARCHAR[] AS o FROM pa UNION ALL
SELECT id, p, i + 1, CASE WHEN i + 1 > len(p) THEN '' WHEN now = '' THEN p[i + 1] WHEN length(now) + length(p[i + 1]) <= {_WIDE} THEN now || chr(10) || chr(10) || p[i + 1] ELSE p[i + 1] END,
  CASE WHEN now <> '' AND (i + 1 > len(p) OR length(now) + length(p[i + 1]) > {_WIDE}) THEN list_append(o, now) ELSE o END FROM pg WHERE i <= len(p))"""


@_register("ch_paragraph", f"WITH RECURSIVE {_PARAGRAPHED} SELECT id, len(o)::BIGINT AS n, md5(array_to_string(o, '|')) AS digest FROM pg WHERE i = len(p) + 1 AND len(o) > 0")
def ch_paragraph(spark, d):
    """Dispatch by name; the size is over every paragraph, so that all go into packs."""
    chunks = P.chunk(CI.texts(spark, d), "paragraph", most=_WIDE, overlap=0)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))), lambda x: x["chunk"]), "|")
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.md5(listed.cast("binary")).alias("digest"))


# ---------------------------------------------------------------- entities: merge, candidates, matches, links


def _incoming(spark, d) -> DataFrame:
    """Names as a careless writer has them, with confidences in tenths."""
    known = CI.named(spark, d)
    careless = F.lower(F.expr("substring(name, 1, length(name) - 1)"))
    return known.select(F.concat(F.lit("i"), "id").alias("id"), "etype", careless.alias("name"), (F.col("confidence") / 10).alias("confidence"), F.lit("batch").alias("source"), F.create_map(F.lit("from"), F.lit("batch"), F.lit("n"), F.col("confidence").cast("string")).alias("properties"))


def _kept(spark, d) -> DataFrame:
    return CI.named(spark, d).select("id", "etype", "name", ((F.length("name") % 7) / 10).alias("confidence"), F.lit("store").alias("source"), F.create_map(F.lit("from"), F.lit("store")).alias("properties"))


_IN = f"""{CI._NA}, ic AS (SELECT 'i' || id AS id, etype, lower(substring(name, 1, length(name) - 1)) AS name, confidence / 10.0::DOUBLE AS confidence FROM na),
sd AS (SELECT id, etype, name, (length(name) % 7) / 10.0::DOUBLE AS confidence FROM na),
cq AS (SELECT id, unnest(list_filter(string_split_regex(name, '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM ic),
cd AS (SELECT id AS candidate, unnest(list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM sd),
ca AS (SELECT cq.id, candidate, row_number() OVER (PARTITION BY cq.id ORDER BY count(*) DESC, candidate) AS place FROM cq JOIN cd USING (term) GROUP BY cq.id, candidate QUALIFY place <= 10),
g1 AS (SELECT *, list_distinct(list_transform(range(1, length(name)), lambda i: substring(name, i, 2))) AS g FROM ic),
g2 AS (SELECT id AS candidate, etype AS et, lower(name) AS nm, confidence AS co, name AS raw, list_distinct(list_transform(range(1, length(name)), lambda i: substring(lower(name), i, 2))) AS h FROM sd),
sm AS (SELECT ca.id, candidate, place, 0.7::DOUBLE * CASE WHEN name = nm THEN 1.0 ELSE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h)))::DOUBLE END + CASE WHEN etype = et THEN 0.3 ELSE 0.0 END::DOUBLE AS similarity FROM ca JOIN g1 ON g1.id = ca.id JOIN g2 USING (candidate)),
bm AS (SELECT * FROM sm WHERE round(similarity, 9) > 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, place) = 1)"""


@_register("res_candidates", f"WITH {_IN} SELECT id, candidate, place::INTEGER AS place FROM ca")
def res_candidates(spark, d):
    return R.candidates_by_name(_incoming(spark, d), _kept(spark, d))


@_register("res_best_match", f"WITH {_IN} SELECT id, candidate, round(similarity, 6) AS similarity FROM bm")
def res_best_match(spark, d):
    new, old = _incoming(spark, d), _kept(spark, d)
    return R.best_match(new, old, R.candidates_by_name(new, old)).withColumn("similarity", F.round("similarity", 6))


_LINKED = """SELECT ic.id, CASE WHEN co > ic.confidence THEN raw ELSE name END AS name, round(CASE WHEN bm.id IS NULL THEN ic.confidence ELSE least(greatest(ic.confidence, co) + 0.1::DOUBLE, 1.0::DOUBLE) END, 6) AS confidence,
CASE WHEN co > ic.confidence THEN 'store' ELSE 'batch' END AS source, CASE WHEN bm.id IS NULL THEN 'batch' ELSE 'store' END AS origin FROM ic LEFT JOIN bm ON bm.id = ic.id LEFT JOIN g2 ON g2.candidate = bm.candidate"""


@_register("res_link", f"WITH {_IN} {_LINKED}")
def res_link(spark, d):
    linked, _ = R.link(_incoming(spark, d), _kept(spark, d))
    return linked.select("id", "name", F.round("confidence", 6).alias("confidence"), "source", F.col("properties")["from"].alias("origin"))


@_register("res_link_edges", f"WITH {_IN} SELECT 'link_' || id || '_' || candidate AS id, id AS src, candidate AS dst, round(similarity, 6) AS weight FROM bm")
def res_link_edges(spark, d):
    _, edges = R.link(_incoming(spark, d), _kept(spark, d))
    return edges.select("id", "src", "dst", F.round("weight", 6).alias("weight"))


_DUP = """nn AS (SELECT *, list_distinct(list_transform(range(1, length(name)), lambda i: substring(name, i, 2))) AS g0 FROM ic),
dd AS (SELECT a.id AS a, b.id AS b FROM nn a JOIN nn b ON a.etype = b.etype AND a.id <> b.id WHERE round(0.7::DOUBLE * CASE WHEN a.name = b.name THEN 1.0 ELSE len(list_intersect(a.g0, b.g0)) / (len(a.g0) + len(b.g0) - len(list_intersect(a.g0, b.g0)))::DOUBLE END + 0.3::DOUBLE, 9) > 0.8),
gone AS (SELECT a AS id FROM dd JOIN ic x ON x.id = a JOIN ic y ON y.id = b WHERE y.confidence > x.confidence OR (y.confidence = x.confidence AND b < a))"""


@_register("res_resolve", f"WITH {_IN}, {_DUP} {_LINKED} WHERE ic.id NOT IN (SELECT id FROM gone)")
def res_resolve(spark, d):
    found, _ = R.resolve(_incoming(spark, d), _kept(spark, d))
    return found.select("id", "name", F.round("confidence", 6).alias("confidence"), "source", F.col("properties")["from"].alias("origin"))


@_register("res_merge", f"WITH {_IN} SELECT ic.id, CASE WHEN s.confidence > ic.confidence THEN s.name ELSE ic.name END AS name, round(greatest(ic.confidence, s.confidence), 6) AS confidence, ic.id IS NOT NULL AS taken FROM ic JOIN sd s ON 'i' || s.id = ic.id")
def res_merge(spark, d):
    other = _kept(spark, d).withColumn("id", F.concat(F.lit("i"), "id"))
    out = R.merged(_incoming(spark, d), other)
    return out.select("id", "name", F.round("confidence", 6).alias("confidence"), (F.col("properties")["from"] == "store").alias("taken"))


@_register("res_candidates_embedding", """WITH q AS (SELECT vec_id AS id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.id, vec_id AS candidate, list_cosine_similarity(qe, embedding) AS cosine FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(cosine, 9) DESC, vec_id) <= 10)
SELECT id, candidate, round(cosine, 6) AS cosine FROM s WHERE round(s.cosine, 9) >= 0.8""")
def res_candidates_embedding(spark, d):
    v = S.vectors(spark, d)
    return R.candidates_by_embedding(v.where("id % 20 = 0"), v).select("id", "candidate", F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- searches


@_register("idx_page", f"WITH {CS._IX} SELECT query_id, id, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS place FROM ix) WHERE place BETWEEN 4 AND 8")
def idx_page(spark, d):
    """Five results of each query after the first three, worst first."""
    every = TS.index_search(S.documents(spark, d), S.text_queries(spark, d), None)
    return TS.page(every, 5, 3, descending=False)


@_register("kw_match", f"""WITH {CS._kw(10)}, mt AS (SELECT kr.query_id, kr.id, documents.text AS content, unnest(list_distinct({CS._kt('benchmark.text')})) AS term FROM kr JOIN benchmark ON item_id = query_id JOIN documents ON doc_id = id),
mm AS (SELECT query_id, id, term, content FROM mt WHERE list_contains({CS._kt('content')}, term))
SELECT query_id, id, count(*) AS n_matched, md5(string_agg(term, ',' ORDER BY term)) AS terms, md5(array_to_string(list_sort(list_distinct(list(substring(content, greatest(instr(lower(content), term) - 50, 1), instr(lower(content), term) - greatest(instr(lower(content), term) - 50, 1) + length(term) + 50)))), '|')) AS highlights FROM mm GROUP BY ALL""")
def kw_match(spark, d):
    docs, queries = S.documents(spark, d), S.text_queries(spark, d)
    found = TS.match(docs, queries, TS.keyword_search(docs, queries)).where(F.size("matched") > 0)
    return found.select("query_id", "id", F.size("matched").cast("long").alias("n_matched"), F.md5(F.array_join(F.array_sort("matched"), ",").cast("binary")).alias("terms"), F.md5(F.array_join(F.array_sort("highlights"), "|").cast("binary")).alias("highlights"))


@_register("q_keywords", f"WITH {CU._P} SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(terms, phrases))), ' | ') AS keywords FROM pq")
def q_keywords(spark, d):
    return U.parse(CU.queries(spark, d)).select("query_id", F.array_join(F.array_sort("keywords"), " | ").alias("keywords"))


@_register("fuse_min_score", f"WITH {CS._fu()} SELECT query_id, id, round(final, 6) AS final FROM fu WHERE final >= 0.02")
def fuse_min_score(spark, d):
    return CS.fused(spark, d, least=0.02).select("query_id", "id", F.round("final", 6).alias("final"))


# ---------------------------------------------------------------- evidence and provenance


@_register("ev_relations", "SELECT doc_id AS id, CASE WHEN source = 'src1' THEN 'query_entity' ELSE 'related_entity' END AS of_source, CASE WHEN lang = source THEN 'none' WHEN lang = 'en' THEN 'contextual_entity' ELSE 'related_entity' END AS of_lang FROM documents")
def ev_relations(spark, d):
    """Related entities are source and language (but `en`), `src1` is a query's entity and `en` one of the context."""
    rows = S.documents(spark, d).withColumn("related", F.filter(F.array("source", "lang"), lambda x: x != "en"))
    out = rows.withColumn("m", EV.relations(F.array(F.lit("src1")), F.array(F.lit("en"))))
    return out.select("id", F.col("m")[F.col("source")].alias("of_source"), F.col("m")[F.col("lang")].alias("of_lang"))


@_register("ev_provenance", "SELECT doc_id AS id, source, CASE WHEN lang = 'en' THEN '2.1' ELSE '1.0' END AS version, lang AS user_id FROM documents")
def ev_provenance(spark, d):
    rows = S.documents(spark, d).withColumns({"age_days": F.lit(1), "version": F.when(F.col("lang") == "en", "2.1"), "author": F.col("lang")})
    p = rows.select("id", EV.provenance(columns=tuple(rows.columns)).alias("p"))
    return p.select("id", "p.source", "p.version", "p.user_id")


@_register("prov_verified", f"WITH {CI._EVT} SELECT memory_id, version::INTEGER AS version, version % 3 <> 0 AS sound FROM vs")
def prov_verified(spark, d):
    """Each third version was tampered with."""
    rows = PR.versions(CI.events(spark, d))
    return PR.verified(rows.withColumn("kind", F.when(F.col("version") % 3 == 0, F.concat("kind", F.lit("!"))).otherwise(F.col("kind"))))


# ---------------------------------------------------------------- records


@_register("rec_json", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def rec_json(spark, d):
    """Customers as JSON and back."""
    rows = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return RE.from_json(RE.to_json(rows), "id long, name string, balance double")


@_register("rec_helpers", "SELECT o_orderkey AS id, lower(trim(o_orderpriority)) AS name, 'order ' || o_orderstatus || ' ' || o_orderpriority AS triple, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS evidence, 'trans_' || substring(sha256(o_orderkey || '_create_1'), 1, 16) AS transformation FROM orders")
def rec_helpers(spark, d):
    rows = S.table(spark, d, "orders").withColumn("e", F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("c0"))))
    return rows.select(
        F.col("o_orderkey").alias("id"), RE.normalized_name(F.col("o_orderpriority")).alias("name"), RE.triple(F.lit("order"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("triple"),
        RE.evidence_count(RE.with_evidence(F.col("e"), F.lit("c1"))).alias("evidence"), RE.transformation_id(F.col("o_orderkey"), F.lit("create"), F.lit(1)).alias("transformation"),
    )


@_register("q_process", f"WITH {CU._ALL.replace('[1:8] AS expansions', '[1:9] AS expansions')} SELECT query_id, CASE WHEN strlen({CU._trim('qs.query')}) < 2 THEN 'query is too short' ELSE qs.query || ' | ' || array_to_string(expansions, ' | ') END AS expanded FROM k4 JOIN qs USING (query_id)")
def q_process(spark, d):
    good, bad = U.process(CU.queries(spark, d))
    return good.select("query_id", F.array_join("expanded", " | ").alias("expanded")).unionByName(bad.select("query_id", F.col("error").alias("expanded")))



@_register("v_chunks", "SELECT doc_id AS id, concat_ws('; ', CASE WHEN coalesce(text, '') = '' THEN 'chunk content is empty' END, CASE WHEN doc_id % 3 = 0 THEN 'chunk source is empty' END, CASE WHEN doc_id % 5 = 0 THEN 'chunk confidence out of range' END) AS errors FROM documents")
def v_chunks(spark, d):
    rows = S.documents(spark, d).withColumns({"source": F.when(F.col("id") % 3 != 0, F.col("source")), "confidence": F.when(F.col("id") % 5 == 0, 1.5).otherwise(0.5)})
    return rows.select("id", F.array_join(V.chunk_errors(), "; ").alias("errors"))


@_register("v_entities", f"WITH {CI._NA} SELECT id, CASE WHEN confidence > 1 THEN 'entity confidence out of range' ELSE '' END AS errors FROM na")
def v_entities(spark, d):
    return CI.named(spark, d).select("id", F.array_join(V.entity_errors(), "; ").alias("errors"))


@_register("v_claims", "SELECT 'o' || o_orderkey AS id, concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'claim object is empty' END, CASE WHEN o_orderkey % 7 = 0 THEN 'claim confidence out of range' END) AS errors FROM orders")
def v_claims(spark, d):
    rows = S.table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("order").alias("subject"), F.lit("has").alias("predicate"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("object"), F.when(F.col("o_orderkey") % 7 != 0, 0.5).alias("confidence"))
    return rows.select("id", F.array_join(V.claim_errors(), "; ").alias("errors"))


@_register("v_responses", "SELECT o_orderkey AS id, concat_ws('; ', CASE WHEN o_custkey % 2 = 0 THEN 'memory_id is empty' END, CASE WHEN o_orderkey % 3 = 1 THEN 'candidates is negative' END) AS errors FROM orders")
def v_responses(spark, d):
    rows = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 2 != 0, "m").alias("memory_id"), F.when(F.col("o_orderkey") % 3 == 1, -1).otherwise(2).alias("candidates"))
    return rows.select("id", F.array_join(V.response_errors(["memory_id"], ["candidates"]), "; ").alias("errors"))


@_register("v_metadata", "SELECT page_id, concat_ws('; ', CASE WHEN strlen(url) > 100 THEN 'metadata key is too long' END, CASE WHEN strlen(coalesce(html, '')) > 500 THEN 'metadata value is too long' END) AS errors FROM pages WHERE url IS NOT NULL")
def v_metadata(spark, d):
    rows = S.table(spark, d, "pages").where("url IS NOT NULL")
    return rows.select("page_id", F.array_join(V.metadata_errors(F.create_map(F.col("url"), F.coalesce("html", F.lit("")))), "; ").alias("errors"))


@_register("v_tag_ops", "SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#13' THEN p_type || ',new' WHEN p_type = 'new' THEN p_brand || ',new' ELSE p_brand || ',' || p_type || ',new' END AS tags FROM part")
def v_tag_ops(spark, d):
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(V.without_tag(V.with_tag(F.array("p_brand", "p_type"), "new"), "Brand#13"), ",").alias("tags"))


# ---------------------------------------------------------------- writes and whole recall

_VALID = " AND ".join([f"{CI._trim('text')} <> ''", "strlen(text) <= 10000", *(f"NOT regexp_matches(text, {sql_text(p)})" for p in BLOCKED_IN_CONTENT), f"{CI._trim('source')} <> ''", "strlen(source) <= 200"])
_TWICE = f"""WITH RECURSIVE b2 AS (SELECT doc_id, text || ' Revised.' AS text, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
v2 AS (SELECT doc_id, text FROM b2 WHERE {_VALID}), v1 AS (SELECT doc_id, text FROM documents WHERE {_VALID}),
vv AS (SELECT doc_id AS id, text AS content FROM v2 UNION ALL SELECT doc_id, text FROM v1 WHERE doc_id NOT IN (SELECT doc_id FROM v2)), nm AS (SELECT id, {CI._NORM} AS content FROM vv), {_sized("content", _M, _O, "nm", "id")}
SELECT z.id || '_chunk_' || m AS chunk_id, z.id AS document, md5(substring(content, s + 1, e - s)) AS digest FROM z JOIN nm ON nm.id = z.id"""


def _written_twice(spark, d) -> dict[str, DataFrame]:
    """All documents, and then those that have labels again, revised, into one store."""
    path = _folder(spark)
    docs = S.documents(spark, d).select("id", "content", "source")
    RC.write(docs, path, strategy="size", most=_M, overlap=_O)
    labelled = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    revised = docs.join(labelled, "id", "left_semi").withColumn("content", F.concat("content", F.lit(" Revised.")))
    return RC.write(revised, path, strategy="size", most=_M, overlap=_O)


@_register("e2e_write_twice", _TWICE)
def e2e_write_twice(spark, d):
    return _written_twice(spark, d)["chunks"].select("chunk_id", "document", F.md5(F.col("content").cast("binary")).alias("digest"))


@_register("e2e_recall_filtered", "SELECT 'fr' AS lang, FALSE AS none")
def e2e_recall_filtered(spark, d):
    """The languages of all evidence when both searches see French documents alone."""
    docs = S.documents(spark, d).withColumn("age_days", S.age_days(F.col("id")).cast("double"))
    out = RC.recall(docs, S.vectors(spark, d), S.text_queries(spark, d), S.vector_queries(spark, d), filters={"lang": "fr"})
    found = out.join(S.documents(spark, d).select("id", "lang"), "id")
    return found.groupBy("lang").agg((F.count(F.lit(1)) == 0).alias("none"))


@_register("e2e_handle_recall", f"""WITH {CI._stated_sql()}, er AS ({"SELECT query_id, " + CI.ORACLES["v_recall_args"].split("SELECT query_id, ", 1)[1]})
SELECT query_id, CASE WHEN errors = '' THEN 'searched' ELSE errors END AS state FROM er""")
def e2e_handle_recall(spark, d):
    """A whole recall of the stated queries: the errors of those that are turned away; the others are parsed, searched and criticised."""
    out = RC.handle(S.documents(spark, d), S.vectors(spark, d), CI.stated_queries(spark))
    bad = out["rejected"].select("query_id", F.array_join("errors", "; ").alias("state"))
    return bad.unionByName(out["parsed"].join(out["critique"].select("query_id", "critique"), "query_id", "left").select("query_id", F.lit("searched").alias("state")))


# ---------------------------------------------------------------- streams, replayed


def _replayed(spark, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over stored files writes until it has read them all."""
    out, state = _folder(spark), _folder(spark)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _streamed(spark, d, name: str) -> DataFrame:
    return spark.readStream.schema(S.table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


@_register("stream_chunks", f"""WITH RECURSIVE nm AS (SELECT doc_id AS id, text AS content FROM documents), {_sized("content", _M, _O, "nm", "id")}
SELECT z.id, m AS ordinal, md5(substring(content, s + 1, e - s)) AS digest FROM z JOIN nm ON nm.id = z.id""")
def stream_chunks(spark, d):
    docs = _streamed(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return _replayed(spark, I.chunk_stream(docs, most=_M, overlap=_O), "append").select("id", "ordinal", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@_register("stream_first_seen", "SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, d):
    rows = _streamed(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _replayed(spark, I.first_seen(rows, "user_id", late="3650 days").select("user_id"), "append")
