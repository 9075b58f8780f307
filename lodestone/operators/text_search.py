"""Inverted index, coordination-level search, keyword search with BM25.

All searches answer many queries at once: queries(query_id, query). Documents are tokenised in the scan; of a search for the k best, each task
hands on its own best alone, and other searches ship only tokens that are in some query. Ranks come from row_number over query_id, which
Spark cuts to the wanted number before the shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T

K1, B, AVERAGE_LENGTH, ASSUMED_CORPUS = 1.2, 0.75, 100.0, 1000.0
LEAST_BM25 = 0.1
#: Queries that go out together, and documents that are multiplied together.
BLOCK, SLICE = 512, 512


def postings(documents: DataFrame) -> DataFrame:
    """term, id: one row for each document that has the term."""
    return documents.select("id", F.explode(F.array_distinct(T.index_tokens(F.col("content")))).alias("term"))


def document_frequencies(documents: DataFrame) -> DataFrame:
    return postings(documents).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def token_counts(documents: DataFrame, tokens) -> DataFrame:
    t = tokens(F.col("content"))
    return documents.select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def query_terms(queries: DataFrame, tokens) -> DataFrame:
    """query_id, term, weight: how often a term stands in its query."""
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query by `order`, with rank."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def index_search(documents: DataFrame, queries: DataFrame, k: int | None = 10, *, where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank. score: query tokens, with repetition, that the document has. Ties by id.

    With k, queries go out in blocks, and a task multiplies its documents' terms with a block's and hands on its k best of each query: what
    is shuffled does not grow with how common a term is. Terms go by their 64-bit fingerprints there. Without k, every hit is a row."""
    if where is not None:
        documents = documents.where(where)
    if k is not None:
        return top(_best_hits(documents, queries, k), k, F.desc("score"), F.asc("id"))
    hits = postings(documents).join(query_terms(queries, T.index_tokens), "term")
    return hits.groupBy("query_id", "id").agg(F.sum("weight").alias("score"))


def _best_hits(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: at least the k best of each query among those with a score."""
    terms = query_terms(queries, T.index_tokens).select("query_id", F.xxhash64("term").alias("h"), "weight").groupBy("query_id").agg(F.collect_list(F.struct("h", "weight")).alias("terms"))
    source = documents.select("id", F.transform(F.array_distinct(T.index_tokens(F.col("content"))), lambda t: F.xxhash64(t)).alias("t"))
    schema = StructType([queries.schema["query_id"], StructField("id", documents.schema["id"].dataType), StructField("score", LongType())])
    out, block = None, []
    rows = terms.orderBy("query_id").toLocalIterator()
    for row in itertools.chain(rows, [None]):
        if row is not None:
            block.append((row.query_id, [(x.h, x.weight) for x in row.terms]))
        if block and (row is None or len(block) == BLOCK):
            part = source.mapInArrow(_multiplied(documents.sparkSession.sparkContext.broadcast(_weights(block)), k, schema["query_id"].dataType), schema)
            out = part if out is None else out.unionByName(part)
            block = []
    return out if out is not None else documents.sparkSession.createDataFrame([], schema)


def _weights(block: list) -> tuple[list, np.ndarray, np.ndarray]:
    """Query ids, the sorted fingerprints of all terms, and how often (terms x queries) each stands in each query."""
    known = np.unique(np.array([h for _, own in block for h, _ in own], np.int64))
    out = np.zeros((len(known), len(block)), np.float32)
    for q, (_, own) in enumerate(block):
        out[np.searchsorted(known, [h for h, _ in own]), q] = [n for _, n in own]
    return [q for q, _ in block], known, out


def _multiplied(handle, k: int, query_kind):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(query_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, known, weights = handle.value
        names = pa.array(qids, kind)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                ids, lists = batch.column(0).slice(a, SLICE), batch.column(1).slice(a, SLICE)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(known, flat)
                own = at < len(known)
                own[own] = known[at[own]] == flat[own]
                x = np.zeros((len(n), len(known)), np.float32)
                x[np.repeat(np.arange(len(n)), n)[own], at[own]] = 1
                score = (x @ weights).astype(np.int64)
                place = np.empty(len(n), np.int64)
                place[pc.sort_indices(ids).to_numpy()] = np.arange(len(n))
                key = score * (len(n) + 1) - place[:, None]  # by score, then by id
                most = min(k, len(n))
                best = np.argpartition(-key, most - 1, axis=0)[:most]
                won = np.take_along_axis(score, best, 0)
                i, q = np.nonzero(won > 0)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(best[i, q])), pa.array(won[i, q])], names=["query_id", "id", "score"])

    return run


def suggest(documents: DataFrame, prefix: str, limit: int) -> DataFrame:
    return postings(documents).where(F.col("term").startswith(prefix.lower())).select("term").distinct().orderBy("term").limit(limit)


def index_size(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("content")).alias("bytes"))


def highlights(documents: DataFrame, term: str, reach: int = 20) -> DataFrame:
    """id, highlight: the first occurrence with `reach` characters on either side, the term marked."""
    text, t = F.col("content"), term.lower()
    at = F.instr(F.lower(text), t)
    start = F.greatest(at - reach, F.lit(1))
    snippet = F.substring(text, start, at - start + F.lit(len(t) + reach))
    return documents.where(at > 0).select("id", F.replace(snippet, F.lit(t), F.lit(f"<em>{t}</em>")).alias("highlight"))


def bm25_term(tf: Column, length: Column, average: float = AVERAGE_LENGTH) -> Column:
    """One term's share: the corpus size and the average length are configured, not counted."""
    return F.log(F.lit(ASSUMED_CORPUS) / (1 + tf)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * (length / average)))


def bm25(documents: DataFrame, queries: DataFrame | None, *, average: float = AVERAGE_LENGTH, terms: DataFrame | None = None) -> DataFrame:
    """query_id, id, bm25, matched (distinct terms), bytes of the content; rows with a match only. terms(query_id, term, weight): those of the
    queries, where they are known already."""
    tokens = T.keyword_tokens(F.col("content"))
    rows = documents.select("id", F.octet_length("content").alias("bytes"), tokens.alias("t"))
    terms = query_terms(queries, T.keyword_tokens) if terms is None else terms
    counted = rows.select("id", "bytes", F.size("t").alias("length"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "bytes", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    share = bm25_term(F.col("tf").cast("double"), F.col("length").cast("double"), average) * F.col("weight")
    return counted.join(terms, "term").groupBy("query_id", "id", "bytes").agg(F.sum(share).alias("bm25"), F.count(F.lit(1)).alias("matched"))


def match(documents: DataFrame, queries: DataFrame, pairs: DataFrame, reach: int = 50) -> DataFrame:
    """query_id, id, matched (the query's terms that the content has, in the query's order), highlights (for each, the first occurrence with
    `reach` characters on either side) for pairs(query_id, id)."""
    terms = queries.select("query_id", F.array_distinct(T.keyword_tokens(F.col("query"))).alias("terms"))
    rows = pairs.select("query_id", "id").join(terms, "query_id").join(documents.select("id", "content"), "id")
    both = rows.withColumn("matched", F.array_intersect("terms", T.keyword_tokens(F.col("content"))))

    def snippet(t: Column) -> Column:
        at = F.instr(F.lower("content"), t)
        start = F.greatest(at - reach, F.lit(1))
        return F.when(at > 0, F.substring(F.col("content"), start, at - start + F.length(t) + reach))

    return both.select("query_id", "id", "matched", F.array_distinct(F.filter(F.transform("matched", snippet), lambda x: x.isNotNull())).alias("highlights"))


def page(found: DataFrame, limit: int, offset: int = 0, *, by: str = "score", descending: bool = True) -> DataFrame:
    """The rows offset + 1 to offset + limit of each query, by score or id in either direction; ties by id. With their place."""
    if limit < 0 or offset < 0 or by not in ("score", "id"):
        raise ValueError("limit and offset are not negative, and results are sorted by score or id")
    order = F.col(by).desc() if descending else F.col(by).asc()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, F.asc("id")))
    return found.withColumn("place", place).where((F.col("place") <= offset + limit) & (F.col("place") > offset))


def corpus_bm25(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Extension: BM25 with document frequencies and the average length of the corpus."""
    rows = documents.select("id", T.keyword_tokens(F.col("content")).alias("t"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("avg")).first()  # two numbers
    terms = query_terms(queries, T.keyword_tokens)
    counted = rows.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (stats["avg"] or 1.0))) * F.col("weight")
    scored = counted.join(df, "term").join(terms, "term").groupBy("query_id", "id").agg(F.sum(share).alias("score"))
    return top(scored, k, F.desc(F.round("score", 9)), F.asc("id"))


def keyword_search(documents: DataFrame, queries: DataFrame, k: int = 10, *, where: Column | None = None) -> DataFrame:
    """query_id, id, score, bm25, matched, rank: the index's 2 k best are scored by BM25 (0.1 at least), raised by the share of matched
    terms and lowered for contents over 1,000 bytes. k is at most 100; 0 means 10. Filters hold before the search."""
    k = min(k or 10, 100)
    if where is not None:
        documents = documents.where(where)
    candidates = index_search(documents, queries, 2 * k).select("query_id", "id")
    # candidates are few for each query: their contents are scored, not the corpus
    scored = bm25(documents.join(candidates.select("id").distinct(), "id", "left_semi"), queries).join(candidates, ["query_id", "id"])
    size = queries.select("query_id", F.size(T.keyword_tokens(F.col("query"))).alias("terms"))
    raised = F.col("bm25") * (1 + F.col("matched") / F.col("terms") * 0.5) * F.when(F.col("bytes") > 1000, 1000.0 / F.col("bytes")).otherwise(F.lit(1.0))
    found = scored.where(F.round("bm25", 9) >= LEAST_BM25).join(size, "query_id").withColumn("score", raised)
    return top(found, k, F.desc(F.round("score", 9)), F.desc("matched"), F.asc("id")).select("query_id", "id", "score", "bm25", "matched", "rank")


def keyword_search_multiple(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One list for all queries: the union of their finds, first query wins by id, scored again with all distinct terms, the k best."""
    found = keyword_search(documents, queries, k)
    first = found.groupBy("id").agg(F.min("query_id").alias("query_id"))
    # one query of all distinct terms: a row for each term, never all in one
    every = query_terms(queries, T.keyword_tokens).select("term").distinct().select(F.lit(0).alias("query_id"), "term", F.lit(1).cast("long").alias("weight"))
    again = bm25(documents.join(first.select("id"), "id", "left_semi"), None, terms=every)
    n = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    raised = F.col("bm25") * (1 + F.col("matched") / F.col("terms") * 0.5) * F.when(F.col("bytes") > 1000, 1000.0 / F.col("bytes")).otherwise(F.lit(1.0))
    scored = again.join(n, "query_id").withColumn("score", raised).drop("query_id").join(first, "id")
    return scored.orderBy(F.desc(F.round("score", 9)), F.asc("id")).limit(k).select("id", "query_id", "score", "matched")
