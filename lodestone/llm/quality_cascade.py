r"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

Base numbers (words are `[^\x20\x09-\x0D]+` of the whole text): n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words,
the words inside 8-word windows that occur twice or more in the text. A document fails the base when n_words < 20 or
100 * n_repeat_words > 30 * n_words. Those that pass meet the rules of `RULES`, each a boolean expression that is true for a
document to be rejected.

`plan` estimates each rule's selectivity (share rejected) and cost on a sample of about ``sample_rows`` rows, drawn by a hash of the
text from the whole table. The cost is measured there: each rule, with the numbers that it needs made inside it, runs between two
readings of the JVM's nanosecond clock for every sampled row, less the time of an empty rule. Rules are then ordered by rejection per
cost, highest first, as independent selectivities give the least expected cost that way. The chain is one CASE: Spark stops at the
first branch that holds, so later rules are not evaluated for a rejected document. The order changes the work and the name of the
first failed rule, never the verdict: a document is kept when no rule rejects it.

`keep` makes no number before the rule that needs it: the two base conditions are rules of the cascade there, and the dear count of
repeated windows takes the place that its measured cost gives it. `measure` returns all base numbers, so they are made once for each
row and the chain reads them.

The 8-word windows are compared by 64-bit fingerprints within one text; two different windows of a text of 20,000 words agree
with a probability of about 1e-11. Texts in which all windows differ (one hash set pass tells) skip the exact positions.

Edge cases: null text has no words and fails the base; empty text too; very long texts are whole; repeated rows are judged row
by row; an empty table gives no rows and a default order; further columns are not read by `measure` and pass through `keep`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

WINDOW = 8
SAMPLE_ROWS = 2_000
_WHITE = r"[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """expression: SQL, true to reject, over text, words and the base numbers."""

    name: str
    expression: str


#: Production rules.
RULES = (
    Rule("mean_word_length", "10 * word_chars < 20 * n_words OR word_chars > 12 * n_words"),
    Rule("symbol_share", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_letters", r"5 * length(regexp_replace(text, '[^\\p{L}]+', '')) < 3 * word_chars"),
    Rule("shouting", r"n_words >= 20 AND 2 * length(regexp_replace(text, '[^\\p{Lu}]+', '')) > word_chars"),
    Rule("bullet_lines", r"10 * regexp_count(text, '(?m)^[\\x20\\x09]*[-*•]') > 9 * n_lines"),
    # the words are bound once, as the optimizer may put what they are made of in their place
    Rule("stutter", "transform(array(words), v -> 4 * size(filter(v, (w, i) -> i > 0 AND w = v[greatest(i - 1, 0)])) > n_words)[0]"),
    Rule("low_variety", "20 * size(array_distinct(words)) < n_words"),
)


def _worded(docs: DataFrame, passed: list[str]) -> DataFrame:
    text = "coalesce(cast(text as string), '')"
    return docs.select(*passed, F.expr(text).alias("text"), F.expr(rf"filter(split({text}, '{_WHITE}'), w -> w != '')").alias("words"))


def _stats(docs: DataFrame, passed: list[str]) -> DataFrame:
    """Base numbers beside the columns `passed`; words stay for the rules."""
    one = _worded(docs, passed)
    lines = rf"filter(split(text, '\\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"
    two = one.select(
        *passed, "text", "words",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> named_struct('n', cast(size(l) as bigint), 'd', cast(size(l) - size(array_distinct(l)) as bigint)))[0]").alias("l"),
        F.expr(_REPEATED).alias("n_repeat_words"),
    )
    return two.select(*passed, "text", "words", "n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), "n_repeat_words")


def _let(name: str, value: str, body: str) -> str:
    """body with `name` bound to value, evaluated once: a lambda over a one-element array."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated(words: str, k: int) -> str:
    """Words inside k-word windows found twice or more. Fingerprints of windows are built by doubling: 1, 2, 4, 8 words."""
    if k & (k - 1):
        raise ValueError("the window must be a power of two")
    step, body = 1, None
    levels = []
    while step < k:
        levels.append(step)
        step *= 2
    # positions of repeated windows, ascending; each covers k words, or those up to the next position
    body = _let(
        "pairs",
        "array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))",
        _let(
            "at",
            "array_sort(transform(filter(pairs, (p, i) -> (i > 0 and p.x = pairs[greatest(i - 1, 0)].x) or (i < size(pairs) - 1 and p.x = pairs[least(i + 1, size(pairs) - 1)].x)), p -> p.i))",
            f"aggregate(transform(at, (p, i) -> cast(if(i < size(at) - 1, least({k}, at[least(i + 1, size(at) - 1)] - p), {k}) as bigint)), 0L, (a, b) -> a + b)",
        ),
    )
    body = f"if(size(array_distinct(h)) = size(h), 0L, {body})"
    for s in reversed(levels):
        prior = f"h{s}"
        body = _let("h" if s == levels[-1] else f"h{2 * s}", f"transform(slice({prior}, 1, greatest(size({prior}) - {s}, 0)), (x, i) -> xxhash64(x, {prior}[i + {s}]))", body)
    return f"if(size({words}) < {k}, 0L, {_let('h1', f'transform({words}, w -> xxhash64(w))', body)})"


_REPEATED = _repeated("words", WINDOW)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


#: The base as rules of the cascade.
BASE_RULES = (Rule("base_words", "n_words < 20"), Rule("base_repeats", "100 * n_repeat_words > 30 * n_words"))
_LINES = r"filter(split(text, '\\n'), l -> rlike(l, '[^\\x20\\x09-\\x0D]'))"
_NUMBERS = {
    "n_words": "cast(size(words) as bigint)",
    "word_chars": "cast(length(array_join(words, '')) as bigint)",
    "n_symbols": "cast(regexp_count(text, '[#*$%&|<>]') as bigint)",
    "n_repeat_words": _REPEATED,
}


def _inlined(rule: Rule) -> str:
    """The rule over text and words alone."""
    out = re.sub(r"\b(" + "|".join(_NUMBERS) + r")\b", lambda m: f"({_NUMBERS[m[0]]})", rule.expression)
    if re.search(r"\bn_(dup_)?lines\b", out):
        out = re.sub(r"\bn_dup_lines\b", "(size(lines) - size(array_distinct(lines)))", out)
        out = _let("lines", _LINES, re.sub(r"\bn_lines\b", "size(lines)", out))
    return out


def _timed(expression: str) -> str:
    clock = "cast(reflect('java.lang.System', 'nanoTime') as bigint)"
    return f"named_struct('a', {clock}, 'r', coalesce({expression}, false), 'b', {clock})"


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejection per measured cost on a sample of about `sample_rows` rows (the share of an average nanosecond's work that
    rejects); rules that reject nothing there go last, cheapest first. An empty sample leaves the rules as they are."""
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))
    # a row of copies counts once, so a hot text does not fill the sample; written, so that no rule pays for the words
    sample = C.written(_worded(chosen.select("text"), []).groupBy("text").agg(F.first("words").alias("words")), "rule-sample")
    timed = sample.select(F.expr(_timed("false")).alias("none"), *(F.expr(_timed(_inlined(r))).alias(f"r{k}") for k, r in enumerate(rules)))
    # the middle half of the rows' times: compiling and pauses fall on few rows
    cost = lambda c: F.expr(f"percentile(cast({c}.b - {c}.a as double), array(0.25, 0.5, 0.75))")
    row = timed.agg(F.count(F.lit(1)).alias("n"), cost("none").alias("none"), *(cost(f"r{k}").alias(f"c{k}") for k in range(len(rules))), *(F.avg(F.col(f"r{k}.r").cast("int")).alias(f"s{k}") for k in range(len(rules)))).first()
    C.dropped(sample)
    if not row["n"]:
        return list(rules)
    took = [max(sum(row[f"c{k}"]) - sum(row["none"]), 3.0) / 3 for k in range(len(rules))]
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-row[f"s{k}"] / took[k], took[k], rules[k].name))]


def _first_failed(order: list[Rule], inlined: bool = False) -> Column:
    chain = F.lit(None).cast("string")
    for r in reversed(order):
        chain = F.when(F.expr(_inlined(r) if inlined else r.expression), F.lit(r.name)).otherwise(chain)
    return chain


def measure(docs: DataFrame, *, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the five base numbers, base_failed, kept, and the rule that rejected first in the planned order (null: none)."""
    order = plan(docs, rules, sample_rows=sample_rows)
    stats = _stats(docs, [id_col])
    out = stats.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), F.when(F.expr(BASE_FAILED), F.lit("base")).otherwise(_first_failed(order)).alias("failed_rule"))
    return out.withColumn("kept", F.col("failed_rule").isNull())


def keep(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the cascade keeps, with all their columns."""
    order = plan(docs, BASE_RULES + rules, sample_rows=sample_rows)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))
    # a filter on the verdict would be pushed below the words that it is made of, and each of its uses would make them again;
    # beside a column that depends on the row's place it stays where it is
    judged = _worded(row, ["__row"]).select("__row", _first_failed(order, inlined=True).alias("__failed"), F.monotonically_increasing_id().alias("__place"))
    return judged.where(F.col("__failed").isNull() & (F.col("__place") >= 0)).select("__row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return measure(C.table(spark, sf_dir, "documents")).drop("failed_rule")


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM win
  WHERE (doc_id, g) IN (SELECT (doc_id, g) FROM win GROUP BY doc_id, g HAVING count(*) > 1)) GROUP BY doc_id),
b AS (SELECT d.doc_id, text, w, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
  cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
  NOT (base_failed
    OR 10 * word_chars < 20 * n_words OR word_chars > 12 * n_words
    OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 50 * n_lines
    OR 5 * length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) < 3 * word_chars
    OR (n_words >= 20 AND 2 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > word_chars)
    OR 10 * len(regexp_extract_all(text, '(?m)^[\x20\x09]*[-*•]')) > 9 * n_lines
    OR 4 * len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) > n_words
    OR 20 * len(list_distinct(w)) < n_words) AS kept
FROM s
"""
