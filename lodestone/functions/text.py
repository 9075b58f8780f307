"""Tokenizers, word sets, escapes and slices as column expressions. Lengths are UTF-8 bytes where a rule says so, slices are characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .constants import KEYWORD_STOP_WORDS

#: White space as words are split in queries and contents; written out because \s differs between dialects.
SPACES = r"[\t\n\x0B\f\r ]+"


def bound(rows: DataFrame) -> DataFrame:
    """The same rows, their columns made once each: expressions above cannot take their place, as they would inside lambdas, where what they
    say would be worked out again for each element."""
    return rows.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("r")).select("r.*")


def words_of(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, SPACES), lambda x: x != "")


def index_tokens(c: Column) -> Column:
    """Tokens of the index: lower case, runs of a-z and 0-9; nothing is dropped."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def keyword_tokens(c: Column) -> Column:
    """Tokens of keyword scoring: lower case, runs of letters and digits of any script, two bytes at least, no stop words."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda x: (F.octet_length(x) >= 2) & ~x.isin(*KEYWORD_STOP_WORDS))


def content_words(c: Column) -> Column:
    """The set that contents are compared by: lower-case words of three bytes at least."""
    return F.array_distinct(F.filter(words_of(F.lower(c)), lambda x: F.octet_length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def bigrams(c: Column) -> Column:
    """The set of two-character runs."""
    n = F.length(c)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def one_spaced(c: Column) -> Column:
    return F.regexp_replace(c, r"[\t\n\f\r ]+", " ")


def sanitized(c: Column) -> Column:
    """Trimmed, HTML-escaped once, without control characters, white space made single."""
    return one_spaced(without_controls(html_escaped(trimmed(c))))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")


def cut(c: Column, most: int) -> Column:
    """At most `most` bytes stay whole; longer text keeps its first characters and an ellipsis."""
    return F.when(F.octet_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
