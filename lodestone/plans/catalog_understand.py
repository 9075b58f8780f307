"""Registered queries of query understanding. Their input is every benchmark text and a table of stated queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import ACRONYMS, PARAPHRASES, QUERY_STOP_WORDS, SPELLING, SYNONYMS
from ..functions.dialect import sql_list, sql_text
from ..operators import understand as U
from ..sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STATED = (
    "how to find a fast database", 'what is "machine learning" for the web', "type:claim confidence:high good results", "Ada Lovelace", "OpenAI research last week",
    "recieve the latest api docs", 'compare "big data" and "small data" recent', "ai and ml for sql", "source:blog source:news today", "why is json hard to use",
    "best way to create an index", "the of and", "x", "New York City", "2024 budget", 'show "easy set" unterminated "quote', "seperate old from new yesterday", "a:b:c key: :value tag:x",
    "update the ui", "when was the meeting last month", "who can help", "ssd vs hdd performace",
)


def queries(spark, d) -> DataFrame:
    stated = spark.createDataFrame([(100_000 + k, q) for k, q in enumerate(STATED)], "query_id long, query string")
    return S.text_queries(spark, d).unionByName(stated)


_SP = r"'[\t\n\x0B\f\r ]+'"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {_SP}), lambda x: x <> '')"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"


def _map(table) -> str:
    return "MAP {" + ", ".join(f"{sql_text(k)}: {sql_list(v if isinstance(v, tuple) else (v,))}" for k, v in table.items()) + "}"


_Q = "qs AS (SELECT item_id::BIGINT AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({100_000 + k}::BIGINT, {sql_text(q)})" for k, q in enumerate(STATED)) + "))"
_STOP = sql_list(QUERY_STOP_WORDS)
_P = rf"""{_Q}, q0 AS (SELECT query_id, query, lower({_trim("query")}) AS lowered FROM qs),
q1 AS (SELECT *, list_filter(list_transform(regexp_extract_all(lowered, '"([^"]*)"', 1), lambda x: {_trim("x")}), lambda x: x <> '') AS phrases,
  list_filter({_words("regexp_replace(lowered, '\"[^\"]*(\"|$)', '', 'g')")}, lambda x: strlen(x) >= 2 AND NOT list_contains({_STOP}, x)) AS terms,
  list_filter({_words("lowered")}, lambda x: regexp_matches(x, '^[^:]+:.+$')) AS pairs,
  list_filter({_words("query")}, lambda x: NOT list_contains({_STOP}, lower(x))) AS said, len({_words("query")}) AS n_words FROM q0),
pa AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(pairs, lambda x: split_part(x, ':', 1)))),
    lambda k: k || '=' || regexp_replace(list_filter(pairs, lambda x: split_part(x, ':', 1) = k)[-1], '^[^:]+:', '')) AS filters,
  CASE WHEN contains(lowered, 'today') THEN 'today' WHEN contains(lowered, 'yesterday') THEN 'yesterday' WHEN contains(lowered, 'last week') THEN 'last week'
    WHEN contains(lowered, 'last month') THEN 'last month' WHEN contains(lowered, 'recent') THEN 'recent' END AS time_range FROM q1),
pq AS (SELECT *, CASE WHEN len(phrases) > 0 THEN 'semantic' WHEN len(filters) > 0 THEN 'hybrid'
    WHEN n_words <= 3 AND len(said) > 0 AND len(list_filter(said, lambda x: regexp_matches(x[1], '\p{{Ll}}'))) = 0 THEN 'entity' ELSE 'keyword' END AS query_type,
  list_concat(list_filter(terms, lambda x: regexp_matches(x, '^[^a-z]') AND NOT regexp_matches(x, '^[^\x00-\x7F]')), phrases) AS entities FROM pa)"""


def _join(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


def _distinct(x: str) -> str:
    """The first of each, in order."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_SYN = f"""list_concat(
  flatten(list_transform(terms, lambda t: list_transform(coalesce({_map(SYNONYMS)}[t], []), lambda s: replace(query, t, s)))),
  flatten(list_transform(phrases, lambda p: flatten(list_transform({_words("p")}, lambda w: list_transform(coalesce({_map(SYNONYMS)}[w], []), lambda s:
    replace(query, p, array_to_string(list_transform({_words("p")}, lambda v: CASE WHEN v = w THEN s ELSE v END), ' '))))))))"""
_PAR = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(query), {sql_text(k)}) THEN replace(lower(query), {sql_text(k)}, {sql_text(v)}) END" for k, vs in PARAPHRASES.items() for v in vs) + "], lambda x: x IS NOT NULL AND x <> lower(query))"
_PAR = f"list_concat({_PAR}, CASE WHEN len(terms) > 1 AND array_to_string(list_reverse(terms), ' ') <> query THEN [array_to_string(list_reverse(terms), ' ')] ELSE [] END)"


def _swaps(table) -> str:
    w = _words("lower(query)")
    return f"flatten(list_transform({w}, lambda w, i: list_transform(coalesce({_map(table)}[w], []), lambda v: array_to_string(list_transform({w}, lambda x, j: CASE WHEN j = i THEN v ELSE x END), ' '))))"


_TYPO = """list_concat(list_transform(range(1, length(t)), lambda i: substring(t, 1, i - 1) || substring(t, i + 1, 1) || substring(t, i, 1) || substring(t, i + 2)),
  list_transform(range(1, length(t) + 1), lambda i: substring(t, 1, i - 1) || substring(t, i + 1)))[1:3]"""
_SPE = f"list_concat({_swaps(SPELLING)}, list_filter(flatten(list_transform(list_filter(terms, lambda t: strlen(t) > 3), lambda t: list_transform({_TYPO}, lambda v: replace(query, t, v)))), lambda x: x <> query))"
_INI = f"array_to_string(list_transform({_words('p')}, lambda w: w[1]), '')"
_ACR = f"""list_concat({_swaps(ACRONYMS)}, list_filter(list_transform(list_filter(phrases, lambda p: len({_words('p')}) >= 2), lambda p:
  CASE WHEN contains(query, '"' || p || '"') THEN replace(query, '"' || p || '"', {_INI}) ELSE replace(query, p, {_INI}) END), lambda x: x <> query))"""
_CON = """list_concat(CASE WHEN time_range IS NOT NULL THEN [query || ' recent', query || ' latest', query || ' current', query || ' updated'] ELSE [] END,
  CASE query_type WHEN 'entity' THEN [query || ' information', query || ' details', query || ' overview', 'about ' || query]
    WHEN 'semantic' THEN [query || ' explanation', query || ' meaning', query || ' definition', 'what is ' || query]
    WHEN 'keyword' THEN [query || ' examples', query || ' usage', query || ' applications'] ELSE [] END,
  ['what is ' || query, 'how does ' || query || ' work', 'why ' || query, 'when ' || query, 'where ' || query])"""
_ALL = f"""{_P}, k0 AS (SELECT *, list_filter({_SYN}, lambda x: x <> query) AS s0, {_PAR} AS p0, {_SPE} AS e0, {_ACR} AS a0, {_CON} AS c0 FROM pq),
k1 AS (SELECT query_id, {_distinct("s0")} AS synonyms, {_distinct("p0")} AS paraphrases, {_distinct("e0")} AS spellings, {_distinct("a0")} AS acronyms, {_distinct("c0")} AS context FROM k0),
k2 AS (SELECT *, list_concat(synonyms, paraphrases, spellings, acronyms, context) AS every FROM k1), k3 AS (SELECT *, list_transform(every, lambda x: lower({_trim("x")})) AS keys FROM k2),
k4 AS (SELECT *, list_filter(every, lambda x, i: list_position(keys, keys[i]) = i)[1:8] AS expansions FROM k3)"""


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _listed(*columns: str):
    return [F.array_join(c, " | ").alias(c) for c in columns]


@_register("q_parse_terms", f"WITH {_P} SELECT query_id, {_join('terms')} AS terms FROM pq")
def q_parse_terms(spark, d):
    return U.parse(queries(spark, d)).select("query_id", *_listed("terms"))


@_register("q_parse_phrases", f"WITH {_P} SELECT query_id, {_join('phrases')} AS phrases FROM pq")
def q_parse_phrases(spark, d):
    return U.parse(queries(spark, d)).select("query_id", *_listed("phrases"))


@_register("q_parse_filters", f"WITH {_P} SELECT query_id, {_join('filters')} AS filters FROM pq")
def q_parse_filters(spark, d):
    return U.parse(queries(spark, d)).select("query_id", *_listed("filters"))


@_register("q_time_range", f"""WITH {_P}, t AS (SELECT *, TIMESTAMP '{S.NOW}' AS now FROM pq) SELECT query_id, coalesce(time_range, '') AS time_range,
coalesce(strftime(CASE time_range WHEN 'today' THEN date_trunc('day', now)::TIMESTAMP WHEN 'yesterday' THEN date_trunc('day', now)::TIMESTAMP - INTERVAL 1 DAY WHEN 'last week' THEN now - INTERVAL 7 DAY WHEN 'last month' THEN now - INTERVAL 1 MONTH WHEN 'recent' THEN now - INTERVAL 3 DAY END, '%Y-%m-%d %H:%M:%S'), '') AS since,
coalesce(strftime(CASE WHEN time_range = 'yesterday' THEN date_trunc('day', now)::TIMESTAMP - INTERVAL 1 SECOND WHEN time_range IS NOT NULL THEN now END, '%Y-%m-%d %H:%M:%S'), '') AS until FROM t""")
def q_time_range(spark, d):
    out = U.time_bounds(U.parse(queries(spark, d)), S.NOW)
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c)
    return out.select("query_id", F.coalesce("time_range", F.lit("")).alias("time_range"), stamp("since"), stamp("until"))


@_register("q_type", f"WITH {_P} SELECT query_id, query_type FROM pq")
def q_type(spark, d):
    return U.parse(queries(spark, d)).select("query_id", "query_type")


@_register("q_entities", f"WITH {_P} SELECT query_id, {_join('entities')} AS entities, {_join(_distinct('list_concat(terms, phrases)'))} AS keywords FROM pq")
def q_entities(spark, d):
    return U.parse(queries(spark, d)).select("query_id", *_listed("entities", "keywords"))


def _kind(name: str):
    def f(spark, d):
        return U.expand(U.parse(queries(spark, d))).select("query_id", *_listed(name))

    return f


for _name, _column in (("q_synonyms", "synonyms"), ("q_paraphrases", "paraphrases"), ("q_spelling", "spellings"), ("q_acronyms", "acronyms"), ("q_context", "context"), ("q_expand", "expansions")):
    _register(_name, f"WITH {_ALL} SELECT query_id, {_join(_column)} AS {_column} FROM k4")(_kind(_column))
