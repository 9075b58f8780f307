"""Query understanding on a table of queries(query_id, query): phrases, filters, time range, type, terms, and expansions.

All are row expressions; lookups are literal maps of fixed size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.constants import ACRONYMS, PARAPHRASES, QUERY_STOP_WORDS, SPELLING, SYNONYMS

EXPANSIONS = 8
TYPO_VARIANTS = 3
_NONE = "array<string>"


def _lookup(table: Mapping[str, tuple[str, ...] | str]) -> Column:
    one = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.array(F.lit(v))
    return F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(one, table.values())))


def _several(key: Column, table) -> Column:
    return F.coalesce(F.try_element_at(_lookup(table), key), F.array().cast(_NONE))


def parse(queries: DataFrame) -> DataFrame:
    """query_id, query, lowered, phrases, terms, filters (array of key=value, sorted, last value wins), time_range, query_type,
    entities, keywords. An unpaired quote drops what follows it from the terms."""
    low = F.lower(T.trimmed(F.col("query")))
    rows = queries.select("query_id", "query", low.alias("lowered"))
    phrases = F.filter(F.transform(F.regexp_extract_all("lowered", F.lit('"([^"]*)"'), 1), T.trimmed), lambda x: x != "")
    rest = F.regexp_replace("lowered", '"[^"]*("|$)', "")
    terms = F.filter(T.words_of(rest), lambda x: (F.octet_length(x) >= 2) & ~x.isin(*QUERY_STOP_WORDS))
    pairs = F.filter(T.words_of(F.col("lowered")), lambda x: x.rlike(r"^[^:]+:.+$"))
    split = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), x.alias("x")))
    rows = rows.select("*", phrases.alias("phrases"), terms.alias("terms"), split.alias("pairs"))
    keys = F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["k"])))
    last = F.transform(keys, lambda k: F.element_at(F.filter("pairs", lambda p: p["k"] == k), -1)["x"])
    filters = F.transform(last, lambda x: F.concat(F.substring_index(x, ":", 1), F.lit("="), F.regexp_replace(x, "^[^:]+:", "")))
    rows = rows.withColumn("filters", filters)
    time_range = F.coalesce(*[F.when(F.col("lowered").contains(w), w) for w in ("today", "yesterday", "last week", "last month", "recent")])
    said = F.filter(T.words_of(F.col("query")), lambda x: ~F.lower(x).isin(*QUERY_STOP_WORDS))
    entity_like = (F.size(T.words_of(F.col("query"))) <= 3) & (F.size(said) > 0) & F.forall(said, lambda x: ~F.substring(x, 1, 1).rlike(r"\p{Ll}"))
    kind = F.when(F.size("phrases") > 0, "semantic").when(F.size("filters") > 0, "hybrid").when(entity_like, "entity").otherwise("keyword")
    entities = F.concat(F.filter("terms", lambda x: x.rlike("^[^a-z]") & ~x.rlike(r"^[^\x00-\x7F]")), F.col("phrases"))
    return rows.select(
        "query_id", "query", "lowered", "phrases", "terms", "filters", time_range.alias("time_range"), kind.alias("query_type"), entities.alias("entities"),
        F.array_distinct(F.concat("terms", "phrases")).alias("keywords"),
    )


def time_bounds(parsed: DataFrame, now: str) -> DataFrame:
    """since and until of the time range, from a stated now; whole days for today and yesterday."""
    t = F.to_timestamp(F.lit(now))
    day = F.date_trunc("day", t)
    since = (
        F.when(F.col("time_range") == "today", day).when(F.col("time_range") == "yesterday", day - F.expr("INTERVAL 1 DAY"))
        .when(F.col("time_range") == "last week", t - F.expr("INTERVAL 7 DAYS")).when(F.col("time_range") == "last month", t - F.expr("INTERVAL 1 MONTH"))
        .when(F.col("time_range") == "recent", t - F.expr("INTERVAL 3 DAYS"))
    )
    until = F.when(F.col("time_range") == "yesterday", day - F.expr("INTERVAL 1 SECOND")).when(F.col("time_range").isNotNull(), t)
    return parsed.withColumns({"since": since, "until": until})


def _other(variants: Column) -> Column:
    """Variants that differ from the query, the first of each."""
    return F.array_distinct(F.filter(variants, lambda x: x != F.col("query")))


def synonyms(parsed: DataFrame) -> Column:
    terms = F.flatten(F.transform("terms", lambda t: F.transform(_several(t, SYNONYMS), lambda s: F.replace(F.col("query"), t, s))))
    phrase = F.flatten(F.transform("phrases", lambda p: F.flatten(F.transform(T.words_of(p), lambda w: F.transform(_several(w, SYNONYMS), lambda s: F.replace(
        F.col("query"), p, F.array_join(F.transform(T.words_of(p), lambda v: F.when(v == w, s).otherwise(v)), " ")))))))
    return _other(F.concat(terms, phrase))


def paraphrases(parsed: DataFrame) -> Column:
    """Patterns in the order of the table, then the terms reversed."""
    low = F.lower("query")
    made = F.array(*[F.when(F.contains(low, F.lit(k)), F.replace(low, F.lit(k), F.lit(v))) for k, vs in PARAPHRASES.items() for v in vs])
    back = F.when(F.size("terms") > 1, F.array(F.array_join(F.reverse("terms"), " "))).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.concat(F.filter(F.array_compact(made), lambda x: x != low), F.filter(back, lambda x: x != F.col("query"))))


def _word_swaps(table) -> Column:
    """The lower-case words joined by single spaces, with one word replaced at a time."""
    words = T.words_of(F.lower("query"))
    swapped = F.transform(words, lambda w, i: F.transform(_several(w, table), lambda v: F.array_join(F.transform(words, lambda x, j: F.when(j == i, v).otherwise(x)), " ")))
    return F.flatten(swapped)


def spellings(parsed: DataFrame) -> Column:
    """Known corrections, then the first typo variants of terms of more than three bytes: neighbours swapped, then letters left out."""
    def typos(t: Column) -> Column:
        n = F.length(t)
        swaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(1)), F.substring(t, i, F.lit(1)), F.substring(t, i + 2, n)))
        drops = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))
        return F.slice(F.concat(swaps, drops), 1, TYPO_VARIANTS)

    made = F.flatten(F.transform(F.filter("terms", lambda t: F.octet_length(t) > 3), lambda t: F.transform(typos(t), lambda v: F.replace(F.col("query"), t, v))))
    return F.array_distinct(F.concat(_word_swaps(SPELLING), F.filter(made, lambda x: x != F.col("query"))))


def acronyms(parsed: DataFrame) -> Column:
    """Expansions of known acronyms; phrases of several words by their initials."""
    def initials(p: Column) -> Column:
        return F.array_join(F.transform(T.words_of(p), lambda w: F.substring(w, 1, 1)), "")

    long = F.filter("phrases", lambda p: F.size(T.words_of(p)) >= 2)
    quoted = lambda p: F.concat(F.lit('"'), p, F.lit('"'))
    short = F.transform(long, lambda p: F.when(F.contains(F.col("query"), quoted(p)), F.replace(F.col("query"), quoted(p), initials(p))).otherwise(F.replace(F.col("query"), p, initials(p))))
    return F.array_distinct(F.concat(_word_swaps(ACRONYMS), F.filter(short, lambda x: x != F.col("query"))))


def context(parsed: DataFrame) -> Column:
    q = F.col("query")
    after = lambda *xs: F.array(*[F.concat(q, F.lit(" " + x)) for x in xs])
    none = F.array().cast(_NONE)
    timed = F.when(F.col("time_range").isNotNull(), after("recent", "latest", "current", "updated")).otherwise(none)
    kind = F.col("query_type")
    typed = (
        F.when(kind == "entity", F.concat(after("information", "details", "overview"), F.array(F.concat(F.lit("about "), q))))
        .when(kind == "semantic", F.concat(after("explanation", "meaning", "definition"), F.array(F.concat(F.lit("what is "), q))))
        .when(kind == "keyword", after("examples", "usage", "applications")).otherwise(none)
    )
    asked = F.array(*[F.concat(F.lit(a), q, F.lit(b)) for a, b in (("what is ", ""), ("how does ", " work"), ("why ", ""), ("when ", ""), ("where ", ""))])
    return F.array_distinct(F.concat(timed, typed, asked))


def expand(parsed: DataFrame, limit: int = EXPANSIONS) -> DataFrame:
    """All kinds, and expansions: the first `limit` of them in order, by trimmed lower case."""
    kinds = {"synonyms": synonyms, "paraphrases": paraphrases, "spellings": spellings, "acronyms": acronyms, "context": context}
    parsed = T.bound(parsed)
    made = T.bound(parsed.withColumns({k: f(parsed) for k, f in kinds.items()}))
    same = lambda x: F.lower(T.trimmed(x))
    every = F.concat(*kinds)
    keyed = T.bound(made.withColumns({"every": every, "keys": F.transform(every, same)}))
    first = F.filter(F.transform("every", lambda x, i: F.when(F.array_position("keys", same(x)) == i + 1, x)), lambda x: x.isNotNull())
    return keyed.withColumn("expansions", F.slice(first, 1, limit)).drop("every", "keys")


def process(queries: DataFrame, limit: int = EXPANSIONS + 2) -> tuple[DataFrame, DataFrame]:
    """(processed, rejected). Queries of fewer than two bytes, trimmed, are rejected with an error; the others are parsed, with `expanded`:
    the query itself and its expansions, `limit` texts at most."""
    short = F.octet_length(T.trimmed(F.coalesce("query", F.lit("")))) < 2
    made = expand(parse(queries.where(~short)), limit - 1)
    return made.withColumn("expanded", F.concat(F.array("query"), "expansions")), queries.where(short).withColumn("error", F.lit("query is too short"))
