"""Entities and claims by patterns and word lists, from rows(id, content). Confidences are tenths or hundredths held as integers until the
end, so that thresholds are exact."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..functions.constants import (
    CAUSAL_PATTERNS, DEFINITION_PATTERNS, ENTITY_KEYWORDS, ENTITY_PATTERNS, FACTUAL_INDICATORS, NOT_A_PERSON, NOT_AN_ENTITY, PATTERN_CONFIDENCE, STRONG_VERBS,
    TEMPORAL_PATTERNS, TRIVIAL_CLAIMS, VERB_GROUPS,
)
from ..functions.dialect import java

TRIMMED = ".,!?;:()[]{}\"'"
REACH = 3
#: What every match of a built-in pattern holds.
NEEDED = {"EMAIL": "@", "URL": "http", "PHONE": "[0-9]{3}", "DATE": "[0-9]", "NUMBER": "[0-9]"}
#: A name of more words than this is over 100 bytes and so no entity.
LONGEST = 40
OPINIONS = ("think", "believe", "feel", "opinion", "seems", "appears")


def pattern_entities(rows: DataFrame, patterns: Mapping[str, str] = ENTITY_PATTERNS) -> DataFrame:
    """id, etype, name, confidence (hundredths), method, seq."""
    kinds = list(patterns)
    none = F.array().cast("array<string>")

    def names(k: str) -> Column:
        every = F.regexp_extract_all("content", F.lit(java(patterns[k])), 0)
        # a text without what each match of the pattern holds is not searched
        return F.when(F.col("content").rlike(NEEDED[k]), every).otherwise(none) if patterns[k] == ENTITY_PATTERNS.get(k) else every

    found = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(k).alias("etype"), names(k).alias("names")) for n, k in enumerate(kinds)])
    one = rows.select("id", F.explode(F.filter(found, lambda f: F.size(f["names"]) > 0)).alias("f")).select("id", "f.kind", "f.etype", F.posexplode("f.names").alias("n", "name"))
    known = F.coalesce(F.create_map(*[x for k, v in PATTERN_CONFIDENCE.items() for x in (F.lit(k), F.lit(round(100 * v)))])[F.col("etype")], F.when(F.octet_length("name") < 3, 60).otherwise(80))
    return one.select("id", "etype", "name", known.alias("confidence"), F.lit("pattern").alias("method"), (F.col("kind").cast("long") * 1_000_000_000 + F.col("n")).alias("seq"))


def _titled(w: Column) -> Column:
    """Every word start in upper case (or no letter), two bytes at least."""
    return (F.octet_length(w) >= 2) & ~w.rlike(r"(^|[^\p{L}\p{N}_])\p{Ll}")


def keyword_entities(rows: DataFrame, keywords: Mapping[str, tuple[str, ...]] = ENTITY_KEYWORDS) -> DataFrame:
    """id, etype, name, confidence (hundredths), method, seq. Near a keyword, from three words before to three after, the first capitalised
    word that suits the type, with the capitalised words around it."""
    table = [(k.strip(".").lower(), t, k) for t, ks in keywords.items() for k in ks]
    spark = rows.sparkSession
    known = spark.createDataFrame(table, "key string, etype string, keyword string")
    clean = F.transform(T.words_of(F.col("content")), lambda w: F.regexp_replace(w, r"^[.,!?;:()\[\]{}\"']+|[.,!?;:()\[\]{}\"']+$", ""))
    keys = F.array(*[F.lit(k) for k in sorted({x[0] for x in table})])
    # words are cleaned in texts alone that have a keyword among their runs of letters
    words = rows.where(F.arrays_overlap(F.split(F.lower("content"), "[^a-z]+"), keys)).select("id", clean.alias("w")) if all(k.isascii() and k.isalpha() for k, _, _ in table) else rows.select("id", clean.alias("w"))
    at = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains(keys, F.lower(x)), i + 1)), lambda i: i.isNotNull())
    near = words.where(F.arrays_overlap(F.transform("w", lambda x: F.lower(x)), keys)).select("id", "w", F.explode(at).alias("i"))
    near = near.withColumn("key", F.lower(F.element_at("w", F.col("i")))).join(known, "key")  # a few dozen rows: Catalyst broadcasts them
    suits = (
        f"octet_length(x) >= 2 AND NOT rlike(x, '(^|[^\\\\p{{L}}\\\\p{{N}}_])\\\\p{{Ll}}') AND CASE etype WHEN 'PERSON' THEN NOT array_contains(array({', '.join(repr(n) for n in NOT_A_PERSON)}), x) "
        "WHEN 'ORGANIZATION' THEN octet_length(x) > 2 WHEN 'LOCATION' THEN octet_length(x) > 2 ELSE true END"
    )
    places = f"filter(transform(array({', '.join(str(k) for k in range(-REACH, REACH + 1) if k)}), k -> i + k), j -> j >= 1 AND j <= size(w) AND exists(slice(w, greatest(j, 1), 1), x -> {suits}))"
    start = near.withColumn("j", F.expr(f"get({places}, 0)")).where("j IS NOT NULL")
    titled = "octet_length(x) >= 2 AND NOT rlike(x, '(^|[^\\\\p{L}\\\\p{N}_])\\\\p{Ll}')"
    side = lambda a: f"transform(array({a}), s -> slice(s, 1, CASE WHEN exists(s, x -> NOT ({titled})) THEN cast(array_position(transform(s, x -> {titled}), false) AS int) - 1 ELSE size(s) END))[0]"
    before = side(f"reverse(slice(w, greatest(j - {LONGEST}, 1), j - greatest(j - {LONGEST}, 1)))")
    after = side(f"slice(w, j + 1, {LONGEST})")
    named = start.withColumn("name", F.expr(f"array_join(concat(reverse({before}), array(w[j - 1]), {after}), ' ')"))
    confidence = F.lit(60) + F.when(F.octet_length("name") > 10, 10).otherwise(0) + F.when(F.octet_length("keyword") > 5, 10).otherwise(0)
    order = F.create_map(*[x for n, t in enumerate(keywords) for x in (F.lit(t), F.lit(n))])[F.col("etype")]
    return named.select("id", "etype", "name", confidence.alias("confidence"), F.lit("keyword").alias("method"), (F.lit(10**13) + F.col("i").cast("long") * 10 + order).alias("seq"))


def valid_entities(found: DataFrame, least: int = 50) -> DataFrame:
    """Names of 2 to 100 bytes that are no function word; of equal lower-case names of a type in a text the first."""
    name = T.trimmed(F.col("name"))
    fine = found.where((F.col("confidence") >= least) & F.octet_length(name).between(2, 100) & ~F.lower("name").isin(*NOT_AN_ENTITY))
    w = Window.partitionBy("id", "etype", F.lower("name")).orderBy("seq")
    return fine.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "seq")


def entities(rows: DataFrame) -> DataFrame:
    """id, etype, name, confidence, method: patterns first, then keywords."""
    out = valid_entities(pattern_entities(rows).unionByName(keyword_entities(rows)))
    return out.withColumn("confidence", F.col("confidence") / 100)


# ---------------------------------------------------------------- claims


def claim_sentences(rows: DataFrame) -> DataFrame:
    """id, s_no, sentence, tokens: pieces between terminators that white space follows, over ten bytes, and their lower-case runs of ASCII
    letters, digits and underscores, by which patterns are passed over that cannot match."""
    pieces = F.transform(F.split("content", r"[.!?]+[\t\n\f\r ]+"), T.trimmed)
    told = F.transform(pieces, lambda x: F.struct(x.alias("sentence"), F.array_distinct(F.split(F.lower(x), "[^0-9a-z_]+")).alias("tokens")))
    return rows.select("id", F.posexplode(told).alias("s_no", "p")).select("id", "s_no", "p.sentence", "p.tokens").where(F.octet_length("sentence") > 10)


def cleaned(c: Column) -> Column:
    """Without a leading article, a closing mark of each kind; at most 100 bytes, else the first 100 characters and an ellipsis."""
    c = T.trimmed(c)
    for edge in ("^the ", "^a ", "^an ", r"\.$", ",$", ";$"):  # patterns name the text once; a choice would repeat it
        c = F.regexp_replace(c, edge, "")
    return T.trimmed(T.cut(c, 100))


_NONE = "cast(array() as array<struct<c_no:int,s:string,p:string,o:string>>)"


def _sql(x: str) -> str:
    """A string as a Spark literal."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(xs) -> str:
    return f"array({', '.join(map(_sql, xs))})"


def _svo() -> list[str]:
    """Every match of every verb group: subject before it, object after it. A group whose verbs are not among the tokens is passed over;
    else the sentence is parted at its verbs once and joined again on either side of the k-th."""
    out = []
    for n, g in enumerate(VERB_GROUPS):
        verb = _sql(rf"(?i)(?<![0-9A-Za-z_])({g})(?![0-9A-Za-z_])")  # verbs begin and end with letters, so one side each will do
        parted = f"flatten(transform(split(sentence, {verb}), (p, i) -> array(p, coalesce(get(v, i), ''))))"
        each = f"transform(v, (x, k) -> named_struct('c_no', {n * 1000} + k, 's', array_join(slice(parts, 1, 2 * k + 1), ''), 'p', trim(x), 'o', array_join(slice(parts, 2 * k + 3, size(parts)), '')))"
        bound = f"transform(array(regexp_extract_all(sentence, {verb}, 0)), v -> transform(array({parted}), parts -> {each})[0])[0]"
        out.append(f"CASE WHEN arrays_overlap(tokens, {_words(g.split('|'))}) THEN {bound} ELSE {_NONE} END")
    return out


#: What must hold for the pattern of that place to match: one of these tokens, where white space stands around the word, or a condition.
_YEAR = "rlike(sentence, '[0-9]{4},')"
_DEFINITION_NEEDS = (("defined",), ("means",), ("refers",), "contains(sentence, ':')")
_CAUSAL_NEEDS = (("cause", "causes"), ("lead", "leads"), ("result", "results"), "rlike(sentence, '(?i)because')", "rlike(sentence, '(?i)due')")
_TEMPORAL_NEEDS = (("before",), ("after",), ("during",), _YEAR, _YEAR)


def _patterns(patterns: tuple[str, ...], needs: tuple[tuple[str, ...] | str, ...], predicate: str, base: int, swapped: bool = False) -> list[str]:
    """The first match of each pattern: groups 1 and 2 (swapped for temporal claims). A pattern that opens with any text can only match
    first from the start of a line, and is tried there alone: else a line without a match costs the square of its length."""
    out = []
    for n, (p, need) in enumerate(zip(patterns, needs, strict=True)):
        ready = _sql(("(?im)^" if p.startswith("(.+?)") else "(?i)") + java(p))
        gate = need if isinstance(need, str) else f"arrays_overlap(tokens, {_words(need)})"
        s, o = (2, 1) if swapped else (1, 2)
        one = f"array(named_struct('c_no', {base + n}, 's', regexp_extract(sentence, {ready}, {s}), 'p', '{predicate}', 'o', regexp_extract(sentence, {ready}, {o})))"
        out.append(f"CASE WHEN {gate} THEN {one} ELSE {_NONE} END")
    return out


def _claimed(sentences: DataFrame, found: list[str]) -> DataFrame:
    one = sentences.select("id", "s_no", "sentence", F.explode(F.expr(f"concat({', '.join(found)})")).alias("m")).where("m.s <> '' AND m.o <> ''")
    return one.select("id", "s_no", "sentence", F.col("m.c_no").alias("c_no"), cleaned(F.col("m.s")).alias("subject"), F.col("m.p").alias("predicate"), cleaned(F.col("m.o")).alias("object"))


_DEFINITIONS = lambda: _patterns(DEFINITION_PATTERNS, _DEFINITION_NEEDS, "is_defined_as", 1_000_000)
_CAUSES = lambda: _patterns(CAUSAL_PATTERNS, _CAUSAL_NEEDS, "causes", 2_000_000)
_TIMES = lambda: _patterns(TEMPORAL_PATTERNS, _TEMPORAL_NEEDS, "occurs_during", 3_000_000, True)


def svo_claims(sentences: DataFrame) -> DataFrame:
    return _claimed(sentences, _svo())


def definition_claims(sentences: DataFrame) -> DataFrame:
    return _claimed(sentences, _DEFINITIONS())


def causal_claims(sentences: DataFrame) -> DataFrame:
    return _claimed(sentences, _CAUSES())


def temporal_claims(sentences: DataFrame) -> DataFrame:
    return _claimed(sentences, _TIMES())


def _holds(c: Column, phrases) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(p)) for p in phrases])


def _proper(c: Column) -> Column:
    return F.exists(T.words_of(c), lambda w: (F.octet_length(w) > 1) & _titled(w))


def scored(claims: DataFrame) -> DataFrame:
    """tenths: 5, +1 for a factual indicator, +2 for a strong verb, +1 each for a proper noun in subject and object, -2 for an opinion word;
    0 to 10, and 1 more for a definition, beyond 10 too (and then not valid)."""
    low = F.lower("sentence")
    points = (
        F.lit(5) + F.when(_holds(low, FACTUAL_INDICATORS), 1).otherwise(0) + F.when(_holds(F.lower("predicate"), STRONG_VERBS), 2).otherwise(0)
        + F.when(_proper(F.col("subject")), 1).otherwise(0) + F.when(_proper(F.col("object")), 1).otherwise(0) - F.when(_holds(low, OPINIONS), 2).otherwise(0)
    )
    return claims.withColumn("tenths", F.greatest(F.least(points, F.lit(10)), F.lit(0)) + F.when(F.col("predicate") == "is_defined_as", 1).otherwise(0))


def valid_claims(claims: DataFrame, least: int = 6, most_bytes: int = 200) -> DataFrame:
    """Complete claims of 6 to 10 tenths, 200 bytes at most, not trivial; of equal ones (lower case) in a text the first."""
    line = F.concat_ws(" ", "subject", "predicate", "object")
    # a column of the row's place keeps the filter above the texts that it reads; below, each use would make them again
    fine = claims.withColumn("__place", F.monotonically_increasing_id()).where(
        (F.col("__place") >= 0) & (F.col("subject") != "") & (F.col("object") != "") & F.col("tenths").between(least, 10) & (F.octet_length(line) <= most_bytes)
        & (F.octet_length("subject") >= 3) & (F.octet_length("object") >= 3) & ~_holds(F.lower(line), TRIVIAL_CLAIMS)
    )
    w = Window.partitionBy("id", F.lower("subject"), F.lower("predicate"), F.lower("object")).orderBy("s_no", "c_no")
    return fine.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "__place")


def claims(rows: DataFrame) -> DataFrame:
    """id, s_no, subject, predicate, object, confidence: all kinds of claim in one pass over the sentences."""
    every = _claimed(claim_sentences(rows), _svo() + _DEFINITIONS() + _CAUSES() + _TIMES())
    return valid_claims(scored(every)).select("id", "s_no", "subject", "predicate", "object", (F.col("tenths") / 10).alias("confidence"))
