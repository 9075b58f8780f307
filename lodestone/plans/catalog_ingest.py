"""Registered queries of ingestion: normalising, chunking, extraction, resolution, validation, provenance and storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..functions.constants import (
    BLOCKED_IN_CONTENT, BLOCKED_IN_QUERIES, CAUSAL_PATTERNS, DEFINITION_PATTERNS, ENTITY_KEYWORDS, ENTITY_PATTERNS, FACTUAL_INDICATORS, NOT_A_PERSON, NOT_AN_ENTITY,
    PATTERN_CONFIDENCE, STRONG_VERBS, SUSPICIOUS, TEMPORAL_PATTERNS, TRIVIAL_CLAIMS, VERB_GROUPS,
)
from ..functions.dialect import sql_list, sql_text
from ..operators import extract as X, preprocess as P, provenance as PR, resolve as R, storage as ST, validate as V
from ..sources import graph_tables as GT, tables as S
from .catalog_understand import STATED as STATED_QUERIES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Chunk size and overlap of the registered queries.
MOST, OVERLAP = 400, 80

STATED = (
    "Dr. Ada Lovelace works at Analytical Engine Company in New York City. Contact ada@example.com or +1 555-123-4567 before March 3, 2024.",
    "According to the report, machine learning improves search quality. The new index contains 1,234 documents and 56.7% of them are new.",
    "Photosynthesis is defined as the conversion of light into energy. Entropy means disorder of a system. API refers to an interface.",
    "Heavy rain causes floods in the valley. Poor design leads to failures. Because of the storm, the bridge was closed.",
    "In 1969, Apollo landed on the Moon. The team met after the launch. On July 4, 2023, the Agency released data.",
    "I think the model seems good. It is raining. Prof. Grace Hopper said the compiler works well.",
    "See https://example.org/a?b=1 and http://test.example.net for details; released 2024-01-15, revised 3/4/2024.",
    "Smith Corporation and Jones University signed an agreement with the Ministry of Health, State of Ohio. Results show growth.",
    "first paragraph with a few words\n\nsecond paragraph: it has a definition of something\n\n\nthird",
    "tabs\tand  double  spaces ,odd punctuation ;here:there ( inside ) “quoted” — dash… end.Next",
)


def texts(spark, d) -> DataFrame:
    """id, content: all documents, and stated texts that hold what the documents lack."""
    stated = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(STATED)], "id long, content string")
    return S.documents(spark, d).select("id", "content").unionByName(stated)


_TX = "tx AS (SELECT doc_id::BIGINT AS id, text AS content FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({10**9 + k}::BIGINT, {sql_text(t)})" for k, t in enumerate(STATED)) + "))"


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"


# ---------------------------------------------------------------- normalising and chunking

_NORM = _trim(r"regexp_replace(regexp_replace(regexp_replace(replace(content, chr(9), ' '), ' {2,}', ' ', 'g'), '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
for _a, _b in P.ENCODING:
    _NORM = f"replace({_NORM}, {sql_text(_a)}, {sql_text(_b)})"
_NORM = rf"regexp_replace({_NORM}, '\.([A-Z])', '. \1', 'g')"
for _m in (",", ":", ";"):
    _NORM = f"replace(replace(replace({_NORM}, ' {_m}', '{_m}'), '{_m}', '{_m} '), '{_m}  ', '{_m} ')"
_NORM = f"replace(replace({_NORM}, '( ', '('), ' )', ')')"


@_register("pp_normalize", f"WITH {_TX} SELECT id, {_NORM} AS content FROM tx")
def pp_normalize(spark, d):
    return texts(spark, d).select("id", P.preprocess(F.col("content")).alias("content"))


_SE = r"list_filter(regexp_extract_all(content, '(?s).*?[.!?]+[\t\n\f\r ]+|.+'), lambda x: x <> '')"


@_register("ch_sentences", f"WITH {_TX}, s AS (SELECT id, {_SE} AS s FROM tx) SELECT id, len(s)::INTEGER AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INTEGER AS longest, md5(array_to_string(s, '|')) AS digest FROM s")
def ch_sentences(spark, d):
    s = texts(spark, d).select("id", P.sentences(F.col("content")).alias("s"))
    return s.select("id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


_S1 = f"(i >= a AND l[i] <= {OVERLAP})"
_S2 = f"({_S1} AND i - 1 >= a AND l[i - 1] + l[i] <= {OVERLAP})"
_PACK = f"""{_TX}, sl AS (SELECT id, list_transform({_SE}, lambda x: length(x)) AS l FROM tx),
pk AS (SELECT id, l, 0 AS i, 0 AS a, 0::BIGINT AS size, []::STRUCT(a INTEGER, b INTEGER, kind INTEGER)[] AS o FROM sl UNION ALL
SELECT id, l, i + 1, CASE WHEN i + 1 > len(l) OR l[i + 1] > {MOST} THEN 0 WHEN a = 0 THEN i + 1 WHEN size + l[i + 1] <= {MOST} THEN a WHEN {_S2} THEN i - 1 WHEN {_S1} THEN i ELSE i + 1 END,
  CASE WHEN i + 1 > len(l) OR l[i + 1] > {MOST} THEN 0 WHEN a = 0 THEN l[i + 1] WHEN size + l[i + 1] <= {MOST} THEN size + l[i + 1] ELSE l[i + 1] + CASE WHEN {_S1} THEN l[i] ELSE 0 END + CASE WHEN {_S2} THEN l[i - 1] ELSE 0 END END,
  list_concat(CASE WHEN a > 0 AND (i + 1 > len(l) OR l[i + 1] > {MOST} OR size + l[i + 1] > {MOST}) THEN [{{a: a, b: i, kind: 0}}] ELSE [] END, CASE WHEN l[i + 1] > {MOST} THEN [{{a: i + 1, b: i + 1, kind: 1}}] ELSE [] END)
FROM pk WHERE i <= len(l))"""


@_register("ch_sentence_pack", f"WITH RECURSIVE {_PACK} SELECT id, x.a AS a, x.b AS b, x.kind AS kind, coalesce(list_sum(l[1:x.a - 1]), 0)::INTEGER AS \"start\", list_sum(l[1:x.b])::INTEGER AS \"end\" FROM (SELECT id, l, unnest(o) AS x FROM pk WHERE len(o) > 0)")
def ch_sentence_pack(spark, d):
    packs = P.pack_sentences(texts(spark, d), most=MOST, overlap=OVERLAP)
    return packs.select("id", F.explode("packs").alias("p")).select("id", *(F.col(f"p.{c}").alias(c) for c in ("a", "b", "kind", "start", "end")))


_BACK = "(length(w) - instr(reverse(w), ' '))"
_SIZE = f"""WITH RECURSIVE {_TX}, cs AS (SELECT id, 0 AS ordinal, 0 AS s, CASE WHEN length(content) <= {MOST} THEN length(content) WHEN instr(reverse(w), ' ') > 0 AND {_BACK} > {MOST // 2} THEN {_BACK} ELSE {MOST} END AS e FROM (SELECT id, content, substring(content, 1, {MOST}) AS w FROM tx) WHERE length(content) > 0
UNION ALL SELECT id, ordinal + 1, s, CASE WHEN s + {MOST} >= length(content) THEN length(content) WHEN instr(reverse(w), ' ') > 0 AND {_BACK} > {MOST // 2} THEN s + {_BACK} ELSE s + {MOST} END
FROM (SELECT cs.id, ordinal, greatest(e - {OVERLAP}, s + 1) AS s, content, substring(content, greatest(e - {OVERLAP}, s + 1) + 1, {MOST}) AS w FROM cs JOIN tx ON tx.id = cs.id WHERE e < length(content)))"""


@_register("ch_size", f"{_SIZE} SELECT cs.id, ordinal, s::INTEGER AS \"start\", e::INTEGER AS \"end\", md5(substring(content, s + 1, e - s)) AS digest FROM cs JOIN tx ON tx.id = cs.id")
def ch_size(spark, d):
    return P.chunk_by_size(texts(spark, d), most=MOST, overlap=OVERLAP).select("id", "ordinal", "start", "end", F.md5(F.col("chunk").cast("binary")).alias("digest"))


# ---------------------------------------------------------------- entities

_FALSE = sql_list(NOT_AN_ENTITY)
_PE = " UNION ALL ".join(
    f"SELECT id, {sql_text(k)} AS etype, unnest(n) AS name, {round(100 * PATTERN_CONFIDENCE[k])} AS confidence, {n}::BIGINT * 1000000000 + unnest(range(len(n))) AS seq, 'pattern' AS method FROM (SELECT id, regexp_extract_all(content, {sql_text(p)}) AS n FROM tx)"
    for n, (k, p) in enumerate(ENTITY_PATTERNS.items())
)
_PE = f"{_TX}, pe AS ({_PE})"
_EDGE = "[.,!?;:()\\[\\]{}\"'']+"
_WORDS = rf"list_transform(list_filter(string_split_regex(content, '[\t\n\x0B\f\r ]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^{_EDGE}|{_EDGE}$', '', 'g'))"
_TITLED = r"(strlen({0}) >= 2 AND NOT regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])\p{{Ll}}'))"
_KEYS = "(VALUES " + ", ".join(f"({sql_text(k.strip('.').lower())}, {sql_text(t)}, {sql_text(k)}, {n})" for n, (t, ks) in enumerate(ENTITY_KEYWORDS.items()) for k in ks) + ") AS kt(key, etype, keyword, t_no)"
_SUITS = f"({_TITLED.format('w[j]')} AND CASE etype WHEN 'PERSON' THEN NOT list_contains({sql_list(NOT_A_PERSON)}, w[j]) WHEN 'ORGANIZATION' THEN strlen(w[j]) > 2 WHEN 'LOCATION' THEN strlen(w[j]) > 2 ELSE TRUE END)"


def _while(x: str) -> str:
    titled = _TITLED.format("x")
    return f"({x})[1:coalesce(nullif(list_position(list_transform({x}, lambda x: {titled}), FALSE), 0) - 1, len({x}))]"


_KE = f"""wo AS (SELECT id, {_WORDS} AS w FROM tx),
ki AS (SELECT id, w, i, etype, keyword, t_no FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM wo) JOIN {_KEYS} ON key = lower(w[i])),
kj AS (SELECT *, list_filter(list_transform([-3, -2, -1, 1, 2, 3], lambda k: i + k), lambda j: j >= 1 AND j <= len(w) AND {_SUITS})[1] AS j FROM ki),
ke AS (SELECT id, etype, name, 60 + CASE WHEN strlen(name) > 10 THEN 10 ELSE 0 END + CASE WHEN strlen(keyword) > 5 THEN 10 ELSE 0 END AS confidence, 10000000000000 + i * 10 + t_no AS seq, 'keyword' AS method
  FROM (SELECT *, array_to_string(list_concat(list_reverse({_while("list_reverse(w[greatest(j - 40, 1):j - 1])")}), [w[j]], {_while("w[j + 1:j + 40]")}), ' ') AS name FROM kj WHERE j IS NOT NULL))"""
_EN = f"en AS (SELECT id, etype, name, confidence, method FROM en0 WHERE confidence >= 50 AND strlen({_trim('name')}) BETWEEN 2 AND 100 AND NOT list_contains({_FALSE}, lower(name)) QUALIFY row_number() OVER (PARTITION BY id, etype, lower(name) ORDER BY seq) = 1)"


@_register("ent_patterns", f"WITH {_PE} SELECT id, etype, count(*) AS n, md5(string_agg(name, '|' ORDER BY seq)) AS digest FROM pe GROUP BY ALL")
def ent_patterns(spark, d):
    found = X.pattern_entities(texts(spark, d))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), "|")
    return found.groupBy("id", "etype").agg(F.count(F.lit(1)).alias("n"), F.md5(listed.cast("binary")).alias("digest"))


@_register("ent_keywords", f"WITH {_TX}, {_KE} SELECT id, etype, name, confidence FROM ke")
def ent_keywords(spark, d):
    return X.keyword_entities(texts(spark, d)).select("id", "etype", "name", "confidence")


@_register("ent_dedup", f"WITH {_PE}, {_KE}, en0 AS (SELECT * FROM pe UNION ALL BY NAME SELECT * FROM ke), {_EN} SELECT id, etype, name, confidence / 100.0::DOUBLE AS confidence, method FROM en")
def ent_dedup(spark, d):
    return X.entities(texts(spark, d)).select("id", "etype", "name", "confidence", "method")


# ---------------------------------------------------------------- claims

_CS = rf"""{_TX}, cs AS (SELECT id, s_no, sentence FROM (SELECT id, unnest(s) AS sentence, unnest(range(len(s))) AS s_no FROM (SELECT id, list_transform(string_split_regex(content, '[.!?]+[\t\n\f\r ]+'), lambda x: {_trim("x")}) AS s FROM tx)) WHERE strlen(sentence) > 10)"""


def _clean(x: str) -> str:
    x = _trim(x)
    for start in ("the ", "a ", "an "):
        x = f"regexp_replace({x}, '^{start}', '')"
    for end in (r"\.", ",", ";"):
        x = f"regexp_replace({x}, '{end}$', '')"
    return x


def _cut(x: str) -> str:
    return _trim(f"CASE WHEN strlen({x}) > 100 THEN substring({x}, 1, 100) || '...' ELSE {x} END")


def _pattern_sql(patterns, predicate: str, base: int, swapped: bool = False) -> str:
    a, b = (2, 1) if swapped else (1, 2)
    return " UNION ALL ".join(
        f"SELECT id, s_no, sentence, {base + n} AS c_no, regexp_extract(sentence, {sql_text('(?i)' + p)}, {a}) AS s0, '{predicate}' AS predicate, regexp_extract(sentence, {sql_text('(?i)' + p)}, {b}) AS o0 FROM cs" for n, p in enumerate(patterns)
    )


_SVO = " UNION ALL ".join(
    f"""SELECT id, s_no, sentence, {n} * 1000 + k AS c_no, array_to_string(list_slice(parts, 1, 2 * k + 1), '') AS s0, trim(verbs[k + 1]) AS predicate, array_to_string(list_slice(parts, 2 * k + 3, len(parts)), '') AS o0
FROM (SELECT *, unnest(range(len(verbs))) AS k, flatten(list_transform(pieces, lambda p, i: [p, coalesce(verbs[i], '')])) AS parts
  FROM (SELECT id, s_no, sentence, string_split_regex(sentence, {sql_text(chr(92).join(['(?i)', f'b({g})', 'b']))}) AS pieces, regexp_extract_all(sentence, {sql_text(chr(92).join(['(?i)', f'b({g})', 'b']))}) AS verbs FROM cs) WHERE len(verbs) > 0)"""
    for n, g in enumerate(VERB_GROUPS)
)


def _any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(p)})" for p in phrases) + ")"


def _proper(x: str) -> str:
    return rf"(len(list_filter(string_split_regex({x}, '[\t\n\x0B\f\r ]+'), lambda w: strlen(w) > 1 AND {_TITLED.format('w')})) > 0)"


def _claims_sql(parts: str) -> str:
    return f"""{_CS}, c0 AS ({parts}), c1 AS (SELECT *, {_clean("s0")} AS s1, {_clean("o0")} AS o1 FROM c0 WHERE s0 <> '' AND o0 <> ''),
c2 AS (SELECT id, s_no, sentence, c_no, {_cut("s1")} AS subject, predicate, {_cut("o1")} AS object FROM c1),
c3 AS (SELECT *, greatest(least(5 + CASE WHEN {_any("lower(sentence)", FACTUAL_INDICATORS)} THEN 1 ELSE 0 END + CASE WHEN {_any("lower(predicate)", STRONG_VERBS)} THEN 2 ELSE 0 END + CASE WHEN {_proper("subject")} THEN 1 ELSE 0 END
  + CASE WHEN {_proper("object")} THEN 1 ELSE 0 END - CASE WHEN {_any("lower(sentence)", X.OPINIONS)} THEN 2 ELSE 0 END, 10), 0) + CASE WHEN predicate = 'is_defined_as' THEN 1 ELSE 0 END AS tenths FROM c2),
cl AS (SELECT * FROM c3 WHERE subject <> '' AND object <> '' AND tenths BETWEEN 6 AND 10 AND strlen(subject || ' ' || predicate || ' ' || object) <= 200 AND strlen(subject) >= 3 AND strlen(object) >= 3
  AND NOT {_any("lower(subject || ' ' || predicate || ' ' || object)", TRIVIAL_CLAIMS)} QUALIFY row_number() OVER (PARTITION BY id, lower(subject), lower(predicate), lower(object) ORDER BY s_no, c_no) = 1)"""


_DEF, _CAU, _TEM = _pattern_sql(DEFINITION_PATTERNS, "is_defined_as", 1_000_000), _pattern_sql(CAUSAL_PATTERNS, "causes", 2_000_000), _pattern_sql(TEMPORAL_PATTERNS, "occurs_during", 3_000_000, True)


def _scored(f):
    def query(spark, d):
        return X.valid_claims(X.scored(f(X.claim_sentences(texts(spark, d))))).select("id", "s_no", "subject", "predicate", "object", "tenths")

    return query


for _name, _sql, _f in (("cl_definitions", _DEF, X.definition_claims), ("cl_causal", _CAU, X.causal_claims), ("cl_temporal", _TEM, X.temporal_claims), ("cl_svo", _SVO, X.svo_claims)):
    _register(_name, f"WITH {_claims_sql(_sql)} SELECT id, s_no::INTEGER AS s_no, subject, predicate, object, tenths FROM cl")(_scored(_f))


@_register("cl_score", f"WITH {_claims_sql(' UNION ALL '.join((_SVO, _DEF, _CAU, _TEM)))} SELECT id, s_no::INTEGER AS s_no, subject, predicate, object, tenths / 10.0::DOUBLE AS confidence FROM cl")
def cl_score(spark, d):
    return X.claims(texts(spark, d))


# ---------------------------------------------------------------- resolution


def named(spark, d) -> DataFrame:
    def part(t, prefix, key, name, kind):
        return S.table(spark, d, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("etype"), F.col(name).alias("name"), (F.col(key) % 5).cast("int").alias("confidence"))

    return reduce(DataFrame.unionByName, [part("nation", "n", "n_nationkey", "n_name", "LOCATION"), part("region", "r", "r_regionkey", "r_name", "LOCATION"), _types(spark, d)])


def _types(spark, d) -> DataFrame:
    one = S.table(spark, d, "part").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    return one.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), F.lit("CONCEPT").alias("etype"), F.col("p_type").alias("name"), (F.col("k") % 5).cast("int").alias("confidence"))


_NA = """na AS (SELECT 'n' || n_nationkey AS id, 'LOCATION' AS etype, n_name AS name, (n_nationkey % 5)::INTEGER AS confidence FROM nation UNION ALL SELECT 'r' || r_regionkey, 'LOCATION', r_name, r_regionkey % 5 FROM region
  UNION ALL SELECT 'p' || min(p_partkey), 'CONCEPT', p_type, (min(p_partkey) % 5)::INTEGER FROM part GROUP BY p_type),
nb AS (SELECT *, list_distinct(list_transform(range(1, length(name)), lambda i: substring(lower(trim(name)), i, 2))) AS g FROM na),
np AS (SELECT a.id AS a, b.id AS b, CASE WHEN lower(a.name) = lower(b.name) THEN 1.0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE END AS name_sim FROM nb a JOIN nb b ON a.etype = b.etype AND a.id < b.id)"""


@_register("res_bigram_jaccard", f"WITH {_NA} SELECT a, b, round(name_sim, 6) AS name_sim FROM np WHERE round(np.name_sim, 9) >= 0.5")
def res_bigram_jaccard(spark, d):
    return R.similar_pairs(named(spark, d), 0.5).select("a", "b", F.round("name_sim", 6).alias("name_sim"))


_DU = f"{_NA}, du AS (SELECT a, b, name_sim * 0.7::DOUBLE + 0.3::DOUBLE AS similarity FROM np WHERE round(name_sim * 0.7::DOUBLE + 0.3::DOUBLE, 9) > 0.8)"


@_register("res_dedup", f"WITH {_DU}, bo AS (SELECT a, b FROM du UNION ALL SELECT b, a FROM du) SELECT id, etype, name FROM na WHERE id NOT IN (SELECT bo.a FROM bo JOIN na x ON x.id = bo.a JOIN na y ON y.id = bo.b WHERE y.confidence > x.confidence OR (y.confidence = x.confidence AND bo.b < bo.a))")
def res_dedup(spark, d):
    return R.deduplicate(named(spark, d)).select("id", "etype", "name")


@_register("res_links", f"WITH {_DU} SELECT 'link_' || a || '_' || b AS id, a AS src, b AS dst, 'RELATED_TO' AS type, round(similarity, 6) AS weight FROM du")
def res_links(spark, d):
    return R.links(R.duplicates(named(spark, d))).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- validation


def stated_queries(spark) -> DataFrame:
    odd = ("", "   ", "<script>alert(1)</script>", "go to javascript:void", "x" * 1001, 'a < b & "c"', "tab\there\nand  there")
    rows = [(k, q, (k * 37) % 130 - 10, (k * 7919) % 40_000 - 1000) for k, q in enumerate([*STATED_QUERIES, *odd])]
    return spark.createDataFrame(rows, "query_id int, query string, max_results int, time_budget int")


def _stated_sql() -> str:
    odd = ("", "   ", "<script>alert(1)</script>", "go to javascript:void", "x" * 1001, 'a < b & "c"', "tab\there\nand  there")
    return "sq AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {sql_text(q)}, {(k * 37) % 130 - 10}, {(k * 7919) % 40_000 - 1000})" for k, q in enumerate([*STATED_QUERIES, *odd])) + ") AS t(query_id, query, max_results, time_budget))"


@_register("v_recall_args", f"""WITH {_stated_sql()} SELECT query_id, concat_ws('; ', CASE WHEN {_trim("query")} = '' THEN 'query is empty' END, CASE WHEN strlen(query) > 1000 THEN 'query is too long' END,
{", ".join(f"CASE WHEN contains(lower(query), {sql_text(p)}) THEN 'query contains blocked pattern: {p}' END" for p in BLOCKED_IN_QUERIES)},
CASE WHEN max_results < 0 OR max_results > 100 THEN 'max_results out of range' END, CASE WHEN time_budget < 0 OR time_budget > 30000 THEN 'time_budget out of range' END) AS errors FROM sq""")
def v_recall_args(spark, d):
    return stated_queries(spark).select("query_id", F.array_join(V.recall_errors(), "; ").alias("errors"))


def _sane(x: str) -> str:
    x = _trim(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        x = f"replace({x}, {sql_text(raw)}, '{safe}')"
    return rf"regexp_replace(regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\t\n\f\r ]+', ' ', 'g')"


@_register("v_sanitize", f"SELECT page_id, {_sane('html')} AS html, {_sane('url')} AS url FROM pages")
def v_sanitize(spark, d):
    return S.table(spark, d, "pages").select("page_id", T.sanitized(F.col("html")).alias("html"), T.sanitized(F.col("url")).alias("url"))


@_register("v_suspicious", "SELECT page_id, " + " OR ".join(f"regexp_matches(html, {sql_text(p)})" for p in SUSPICIOUS) + " AS suspicious FROM pages")
def v_suspicious(spark, d):
    return S.table(spark, d, "pages").select("page_id", V.suspicious(F.col("html")).alias("suspicious"))


@_register("v_write_args", f"""SELECT doc_id AS id, concat_ws('; ', CASE WHEN {_trim("text")} = '' THEN 'content is empty' END, CASE WHEN strlen(text) > 10000 THEN 'content is too long' END,
{", ".join(f"CASE WHEN regexp_matches(text, {sql_text(p)}) THEN 'content matches blocked pattern {n}' END" for n, p in enumerate(BLOCKED_IN_CONTENT))},
CASE WHEN {_trim("source")} = '' THEN 'source is required' END, CASE WHEN strlen(source) > 200 THEN 'source is too long' END) AS errors FROM documents""")
def v_write_args(spark, d):
    return S.documents(spark, d).select("id", F.array_join(V.write_errors(), "; ").alias("errors"))


@_register("v_tags", r"SELECT p_partkey AS id, array_to_string(list_filter(list_transform([p_brand, p_type, '-' || p_name || '_', ' '], lambda x: regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9_-]', '', 'g'), '^[_-]+|[_-]+$', '', 'g')), lambda x: x <> ''), ',') AS tags FROM part")
def v_tags(spark, d):
    raw = F.array("p_brand", "p_type", F.concat(F.lit("-"), "p_name", F.lit("_")), F.lit(" "))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(V.tags(raw), ",").alias("tags"))


# ---------------------------------------------------------------- provenance and storage


def events(spark, d) -> DataFrame:
    return S.table(spark, d, "events").select("event_id", F.col("user_id").alias("memory_id"), F.unix_timestamp("ts").alias("at"), F.col("event_type").alias("kind"))


_EVT = "ev AS (SELECT event_id, user_id AS memory_id, floor(epoch(ts))::BIGINT AS at, event_type AS kind FROM events), vs AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ev.at, event_id) AS version FROM ev)"


@_register("prov_ids", "SELECT doc_id AS id, 'prov_' || substring(sha256(doc_id || '_' || source || '_' || n_chars), 1, 16) AS prov FROM documents")
def prov_ids(spark, d):
    return S.documents(spark, d).select("id", PR.provenance_id(F.col("id"), F.col("source"), F.col("n_chars")).alias("prov"))


@_register("prov_versions", f"WITH {_EVT} SELECT memory_id, event_id, version::INTEGER AS version, CASE WHEN version > 1 THEN memory_id || '_v' || (version - 1) ELSE '' END AS parent, sha256(memory_id || '|' || version || '|' || vs.at || '|' || kind) AS hash FROM vs")
def prov_versions(spark, d):
    return PR.versions(events(spark, d)).select("memory_id", "event_id", "version", F.coalesce("parent", F.lit("")).alias("parent"), "hash")


@_register("prov_history", f"WITH {_EVT} SELECT memory_id, max(version)::INTEGER AS version, string_agg(kind, ',' ORDER BY version) AS history FROM (SELECT *, max(version) OVER (PARTITION BY memory_id) AS last FROM vs) WHERE version > last - 10 GROUP BY memory_id")
def prov_history(spark, d):
    return PR.current(PR.versions(events(spark, d)))


@_register("prov_stats", f"WITH {_EVT} SELECT kind, count(*) AS n, count(DISTINCT memory_id) AS memories FROM vs GROUP BY kind")
def prov_stats(spark, d):
    return PR.stats(PR.versions(events(spark, d)))


@_register("st_upsert", "SELECT id, lang FROM (SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'quality ' || max(quality) FROM labels GROUP BY doc_id)")
def st_upsert(spark, d):
    batch = S.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("lang"), F.col("quality").alias("seq"))
    return ST.upsert(S.documents(spark, d).select("id", "lang"), batch, "id", order="seq")


@_register("st_update", "SELECT c_custkey AS id, CASE WHEN total IS NOT NULL THEN 'ordered' ELSE c_mktsegment END AS segment, round(coalesce(total, c_acctbal), 2) AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def st_update(spark, d):
    customers = S.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    batch = S.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("balance")).withColumn("segment", F.lit("ordered"))
    return ST.update(customers, batch, "id", ["segment", "balance"]).withColumn("balance", F.round("balance", 2))


@_register("st_delete_chunk", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def st_delete_chunk(spark, d):
    return ST.delete(S.documents(spark, d), S.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "id").select("id", "source")


@_register("st_stats", f"WITH {GT.SQL} SELECT 'documents' AS view, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def st_stats(spark, d):
    return ST.view_stats(documents=S.documents(spark, d), vectors=S.vectors(spark, d), nodes=GT.nodes(spark, d), edges=GT.edges(spark, d))


@_register("st_facets", "SELECT lang, source, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL")
def st_facets(spark, d):
    return S.documents(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("bytes"))


@_register("e2e_write_counts", f"""WITH RECURSIVE {_claims_sql(" UNION ALL ".join((_SVO, _DEF, _CAU, _TEM)))}, {_PE.removeprefix(_TX + ", ")}, {_KE}, en0 AS (SELECT * FROM pe UNION ALL BY NAME SELECT * FROM ke), {_EN}, {_PACK.removeprefix(_TX + ", ")}
SELECT (SELECT count(*) FROM tx) AS documents, (SELECT sum(len(o))::BIGINT FROM pk) AS packs, (SELECT count(*) FROM en) AS entities, (SELECT count(*) FROM cl) AS claims""")
def e2e_write_counts(spark, d):
    """What a write of all texts stores: packed sentence chunks, entities, claims."""
    rows = texts(spark, d)
    packs = P.pack_sentences(rows, most=MOST, overlap=OVERLAP).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("packs")).alias("packs"))
    out = packs.withColumn("k", F.lit(1))
    for name, found in (("entities", X.entities(rows)), ("claims", X.claims(rows))):
        out = out.join(found.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1)), "k")  # one row each
    return out.drop("k")
