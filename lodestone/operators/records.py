"""Helpers of chunk, entity and claim rows: names and triples as text, evidence lists, JSON, ids of transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TIME = "yyyy-MM-dd'T'HH:mm:ssXXX"


def normalized_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def triple(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, object_)


def evidence_count(evidence: Column) -> Column:
    return F.coalesce(F.size(evidence), F.lit(0))


def has_evidence(evidence: Column) -> Column:
    return evidence_count(evidence) > 0


def with_evidence(evidence: Column, chunk: Column) -> Column:
    return F.array_append(F.coalesce(evidence, F.array().cast("array<string>")), chunk)


def to_json(rows: DataFrame) -> DataFrame:
    """id, json: each row as JSON, timestamps as RFC 3339 seconds."""
    return rows.select("id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"timestampFormat": TIME}).alias("json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of `to_json`; what cannot be read has a null id."""
    return rows.select(F.from_json("json", schema, {"timestampFormat": TIME}).alias("r")).select("r.*")


def transformation_id(memory: Column, kind: Column, version: Column) -> Column:
    return F.concat(F.lit("trans_"), F.substring(F.sha2(F.concat_ws("_", memory.cast("string"), kind, version.cast("string")), 256), 1, 16))
