"""Inputs as the engine sees them, and the shared folder for what a plan writes between its steps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: "Now" for results that depend on age, so that they do not change from day to day.
NOW = "2024-02-01 00:00:00"
#: Documents carry no time; theirs is this day less doc_id mod 90 days.
LAST_DAY = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, lang, source, n_chars"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "n_chars")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, label"""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: every benchmark text, whole"""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding: every vector whose id is divisible by 20, numbered by the quotient"""
    return vectors(spark, sf_dir).where("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("query_id"), F.col("embedding").alias("qe"))


def age_days(doc_id: Column) -> Column:
    return F.lit(1) + F.pmod(doc_id, F.lit(90))


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` or `setCheckpointDir` names. A folder of our own is made on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        if named.isDefined():
            return named.get().rstrip("/")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: an iteration's result, read again without its lineage. It stays until `release` or the
    end of the program, as lazy results may read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no later result reads, such as the last round's."""
    for t in tables:
        if path := getattr(t, "_lodestone_path", None):
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _made[:] = [x for x in _made if x[1] != path]


def release() -> None:
    """Deletes the tables that `written` has made so far."""
    while _made:
        spark, path = _made.pop()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        _made.clear()
