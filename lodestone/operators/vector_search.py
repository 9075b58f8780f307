"""Exact vector search: queries come in bounded blocks, each block meets every row once as a matrix product, and a task passes on its k
best of each query only. Dimensions that differ, empty and zero vectors have cosine 0; cosines are computed in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of query vectors that go out together (one scan of the rows for each such block), and rows and queries of one product.
BLOCK_BYTES = 32 << 20
SLICE = 2048
LEAST_SIMILARITY = 0.1


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of two array columns, clamped to [-1, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.greatest(F.least(dot / size, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(0.0))


def normalize(vectors: DataFrame) -> DataFrame:
    n = norm(F.col("embedding"))
    return vectors.withColumn("embedding", F.when(n > 0, F.transform("embedding", lambda x: (x / n).cast("float"))).otherwise(F.col("embedding")))


def _unit(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        if v is not None and len(v) == dims:
            x = np.asarray([0.0 if y is None else y for y in v], np.float64)
            size = np.sqrt((x * x).sum())
            out[i] = x / size if size > 0 else 0.0
    return out


def _block_scores(vectors: DataFrame, ids: list, block: list, k: int | None) -> DataFrame:
    """query_id, id, similarity of one block of queries against all rows; with k, at least each task's k best of a query."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(block):
        groups.setdefault(len(v or ()), []).append(i)
    handle = vectors.sparkSession.sparkContext.broadcast([(d, np.array([ids[i] for i in own]), _unit([block[i] for i in own], d)) for d, own in groups.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                keys = np.asarray(batch.column(0).to_pylist())
                rows = batch.column(1).to_pylist()
                most = len(keys) if k is None else min(k, len(keys))
                for dims, every, all_queries in handle.value:
                    unit = _unit(rows, dims)  # rows of other dimensions are zero
                    for q in range(0, len(every), SLICE):
                        qids = every[q : q + SLICE]
                        sim = np.clip(unit @ all_queries[q : q + SLICE].T, -1, 1)
                        order = np.lexsort((np.broadcast_to(keys[:, None], sim.shape), -np.round(sim, 9)), axis=0)[:most]
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, most)), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(sim, order, 0).ravel())], names=["query_id", "id", "similarity"])

    return vectors.select("id", "embedding").mapInArrow(run, "query_id long, id long, similarity double")


def similarities(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    out, ids, block, held = None, [], [], 0
    rows = queries.select("query_id", "qe").orderBy("query_id").toLocalIterator()
    for row in _ended(rows):
        if row is not None:
            ids.append(row.query_id)
            block.append(row.qe)
            held += 8 * len(row.qe or ()) + 64
        if block and (row is None or held >= BLOCK_BYTES):
            part = _block_scores(vectors, ids, block, k)
            out = part if out is None else out.unionByName(part)
            ids, block, held = [], [], 0
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, id long, similarity double")


def _ended(rows) -> Iterator:
    yield from rows
    yield None


def _ranked(scored: DataFrame, k: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), F.asc("id")))
    out = scored.withColumn("rank", rank)
    return out if k is None else out.where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, where: Column | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest, after the filter; ties by id."""
    return _ranked(similarities(vectors if where is None else vectors.where(where), queries, k), k)


def min_max(scored: DataFrame, column: str, *keys: str) -> DataFrame:
    """score: the column scaled to [0, 1] within the keys; 1 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scored.withColumn("score", F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(1.0)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, least: float = LEAST_SIMILARITY, where: Column | None = None) -> DataFrame:
    """query_id, id, similarity, score, rank: the k nearest with a similarity of `least` or more (so maybe fewer), scored min-max."""
    found = nearest(vectors, queries, min(k or 10, 100), where=where).where(F.round("similarity", 9) >= least)
    return min_max(found, "similarity", "query_id")


def search_multiple(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One list for all queries: union by id, the first query wins, the k most similar."""
    first = search(vectors, queries, k)
    w = Window.partitionBy("id").orderBy("query_id")
    return first.withColumn("n", F.row_number().over(w)).where("n = 1").orderBy(F.desc(F.round("similarity", 9)), "id").limit(k).select("id", "query_id", "similarity")


def similarity_matrix(queries: DataFrame) -> DataFrame:
    """a, b, similarity of every ordered pair of a stated set of vectors (query_id, qe); 1 on the diagonal, for zero vectors too."""
    rows = queries.select(F.col("query_id").alias("id"), F.col("qe").alias("embedding"))
    return similarities(rows, queries).select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.when(F.col("query_id") == F.col("id"), 1.0).otherwise(F.col("similarity")).alias("similarity"))
