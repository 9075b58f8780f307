"""Registered queries over search, fusion, ranking and evidence, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..functions.constants import KEYWORD_STOP_WORDS
from ..functions.dialect import sql_list
from ..operators import evidence as EV, fusion as FU, rank as RK, text_search as TS, vector_search as VS
from ..sources import tables as S

K = 20
RANKING = RK.Ranking(topics=("the", "und"), sources=("src1",), limit=30)
_STOP = sql_list(KEYWORD_STOP_WORDS)


def _it(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda x: x <> '')"


def _kt(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: strlen(x) >= 2 AND NOT list_contains({_STOP}, x))"


def _cw(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '[\t\n\x0B\f\r ]+'), lambda x: strlen(x) >= 3))"


# ------------------------------------------------------------------ shared pieces: DataFrames and the SQL that says the same

_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_IX = f"""{_Q},
qi AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_it("query")}) AS term FROM q) GROUP BY ALL),
po AS (SELECT doc_id AS id, unnest(list_distinct({_it("text")})) AS term FROM documents),
ix AS (SELECT query_id, id, sum(weight)::BIGINT AS score FROM po JOIN qi USING (term) GROUP BY ALL)"""
_BM = f"""qk AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({_kt("query")}) AS term FROM q) GROUP BY ALL),
qn AS (SELECT query_id, len({_kt("query")}) AS terms FROM q),
dt AS (SELECT doc_id AS id, strlen(text) AS bytes, {_kt("text")} AS t FROM documents WHERE {{only}}),
tf AS (SELECT id, bytes, length, term, count(*)::DOUBLE AS tf FROM (SELECT id, bytes, len(t)::DOUBLE AS length, unnest(t) AS term FROM dt) GROUP BY ALL),
bm AS (SELECT query_id, id, bytes, sum(ln(1000.0::DOUBLE / (1 + tf)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / 100.0::DOUBLE))) * weight) AS bm25, count(*) AS matched
  FROM tf JOIN qk USING (term) GROUP BY ALL)"""


def _kw(k: int) -> str:
    return f"""{_IX},
ca AS (SELECT query_id, id FROM ix QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * k}),
{_BM.replace("{only}", "doc_id IN (SELECT id FROM ca)")},
kw AS (SELECT query_id, id, bm25 * (1 + matched / terms::DOUBLE * 0.5::DOUBLE) * CASE WHEN bytes > 1000 THEN 1000.0::DOUBLE / bytes ELSE 1.0 END AS score, bm25, matched
  FROM bm JOIN ca USING (query_id, id) JOIN qn USING (query_id) WHERE round(bm25, 9) >= 0.1),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, matched DESC, id) AS rank FROM kw QUALIFY rank <= {k})"""


_VQ = "vq AS (SELECT vec_id // 20 AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 20 = 0)"
_VS = f"""{_VQ},
si AS (SELECT query_id, vec_id AS id, label, list_cosine_similarity(qe, embedding::DOUBLE[]) AS similarity FROM vq, embeddings)"""


def _nearest(k: int, where: str = "TRUE") -> str:
    return f"vn AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM si WHERE {where} QUALIFY rank <= {k})"


_MINMAX = """vs AS (SELECT query_id, id, similarity, rank, CASE WHEN max(similarity) OVER w > min(similarity) OVER w
  THEN (similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w) ELSE 1.0 END AS score
  FROM vn WHERE round(similarity, 9) >= 0.1 WINDOW w AS (PARTITION BY query_id))"""


def _fu(vector: float = 1.0, keyword: float = 1.0) -> str:
    return f"""{_kw(K)}, {_VS}, {_nearest(K)}, {_MINMAX},
li AS (SELECT query_id, 'vector' AS m, 0 AS mo, {vector}::DOUBLE AS weight, id, score, rank AS position FROM vs UNION ALL SELECT query_id, 'keyword', 1, {keyword}::DOUBLE, id, score, rank FROM kr),
nz AS (SELECT query_id, m, mo, weight, id, position, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS score
  FROM li WINDOW w AS (PARTITION BY query_id, m)),
fa AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + position)) AS rrf, sum(score * weight) / sum(weight) AS combined, string_agg(m, ',' ORDER BY mo) AS methods, count(*) AS n FROM nz GROUP BY query_id, id),
fu AS (SELECT *, rrf * (1 + combined) AS final, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf * (1 + combined), 9) DESC, round(rrf, 9) DESC, id) AS rank FROM fa)"""


def fused(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    docs, vectors = S.documents(spark, sf_dir), S.vectors(spark, sf_dir)
    lists = FU.inputs(
        vector=VS.search(vectors, S.vector_queries(spark, sf_dir), K),
        keyword=TS.keyword_search(docs, S.text_queries(spark, sf_dir), K),
    )
    return FU.fuse(lists, **options)


def rankable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused results with their documents, labels and queries."""
    docs = S.documents(spark, sf_dir)
    labels = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"), (1 - F.col("toxic")).cast("double").alias("authority"))
    found = fused(spark, sf_dir).select("query_id", "id", F.col("final").alias("base_score"))
    return (
        found.join(docs, "id").join(labels, "id", "left").join(S.text_queries(spark, sf_dir), "query_id")
        .select("query_id", "id", "query", "content", "base_score", S.age_days(F.col("id")).cast("double").alias("age_days"), "source", F.col("lang").alias("title"), "authority", "quality")
    )


def _contains(x: str, y: str) -> str:
    return f"contains(lower({x}), {y})"


_RK = f"""{_fu()},
ra AS (SELECT query_id, id, query, text AS content, final AS base_score, (1 + id % 90)::DOUBLE AS age, source, lang AS title, 1 - toxic AS authority, quality
  FROM fu JOIN documents ON doc_id = id LEFT JOIN labels USING (doc_id) JOIN q USING (query_id)),
rc AS (SELECT *, least(base_score * CASE WHEN contains(lower(content), lower(query)) THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN contains(lower(title), lower(query)) THEN 1.3::DOUBLE ELSE 1 END, 1) AS relevance,
  exp(-ln(2.0::DOUBLE) * age / 30) AS freshness, coalesce(authority::DOUBLE, 0.5::DOUBLE) AS authority_score,
  CASE WHEN strlen(content) > 100 AND strlen(content) < 2000 THEN 0.7::DOUBLE WHEN strlen(content) < 50 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS q0,
  least(0.5::DOUBLE + CASE WHEN {_contains("content", "'the'")} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN {_contains("content", "'und'")} THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(source, 'src1') THEN 0.3::DOUBLE ELSE 0 END, 1) AS personal FROM ra),
rq AS (SELECT *, greatest(least(CASE WHEN strlen(content) < 20 THEN q1 * 0.5::DOUBLE WHEN strlen(content) > 5000 THEN q1 * 0.8::DOUBLE ELSE q1 END, 1), 0) AS quality_score
  FROM (SELECT *, CASE WHEN quality IS NOT NULL THEN (q0 + quality) / 2 ELSE q0 END AS q1 FROM rc)),
rw AS (SELECT query_id, id, unnest(w) AS word, len(w) AS n FROM (SELECT query_id, id, {_cw("content")} AS w FROM rq)),
rs AS (SELECT x.query_id, x.id, y.id AS other, count(*) / (x.n + y.n - count(*))::DOUBLE AS similarity FROM rw x JOIN rw y ON x.query_id = y.query_id AND x.word = y.word AND x.id <> y.id GROUP BY x.query_id, x.id, y.id, x.n, y.n),
rt AS (SELECT query_id, id, product(CASE WHEN similarity > 0.5 THEN 1 - similarity * 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS close, sum(similarity) AS total FROM rs GROUP BY ALL),
rd AS (SELECT rq.*, CASE WHEN count(*) OVER w <= 1 THEN 1.0 ELSE greatest(least(coalesce(close, 1) * (1 - coalesce(total, 0) / greatest(count(*) OVER w - 1, 1) * 0.3::DOUBLE), 1), 0.1::DOUBLE) END AS diversity
  FROM rq LEFT JOIN rt USING (query_id, id) WINDOW w AS (PARTITION BY query_id)),
rm AS (SELECT *, (relevance * 1.0::DOUBLE + freshness * 0.2::DOUBLE + authority_score * 0.3::DOUBLE + quality_score * 0.4::DOUBLE + diversity * 0.1::DOUBLE + personal * 0.2::DOUBLE) / 2.2::DOUBLE AS mean FROM rd),
ru AS (SELECT *, mean * CASE WHEN round(mean, 9) >= 0.8 THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN authority_score >= 0.8 THEN 1.05::DOUBLE ELSE 1 END * CASE WHEN round(freshness, 9) >= 0.9 THEN 1.03::DOUBLE ELSE 1 END AS raised FROM rm),
rf AS (SELECT *, greatest(least(raised * CASE WHEN round(raised, 9) <= 0.3 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN round(quality_score, 9) <= 0.3 THEN 0.95::DOUBLE ELSE 1 END, 1), 0) AS final,
  concat_ws(',', CASE WHEN round(mean, 9) >= 0.8 THEN 'high_score_boost' END, CASE WHEN authority_score >= 0.8 THEN 'authority_boost' END, CASE WHEN round(freshness, 9) >= 0.9 THEN 'freshness_boost' END) AS boosts,
  concat_ws(',', CASE WHEN round(raised, 9) <= 0.3 THEN 'low_score_penalty' END, CASE WHEN round(quality_score, 9) <= 0.3 THEN 'quality_penalty' END) AS penalties FROM ru),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, round(base_score, 9) DESC, round(relevance, 9) DESC, id) AS rank FROM rf QUALIFY rank <= {RANKING.limit})"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RK.rank(rankable(spark, sf_dir), RANKING)


def assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence inputs from ranked results."""
    none = F.array().cast("array<string>")
    own = F.array_sort(F.array_intersect(F.array_distinct(T.keyword_tokens(F.col("query"))), T.keyword_tokens(F.col("content"))))
    return ranked(spark, sf_dir).select(
        "query_id", "id", "content", F.col("final").alias("confidence"), "source", "age_days", F.col("rank").alias("position"), own.alias("matched"), none.alias("related"), none.alias("path")
    )


_EV = f"""{_RK},
ea AS (SELECT query_id, id, content, final AS confidence, source, age AS age_days, rank AS position, list_sort(list_distinct(list_intersect({_kt("query")}, {_kt("content")}))) AS matched FROM rr),
ec AS (SELECT * FROM ea WHERE round(confidence, 9) >= 0.1)"""
_TRIM = r"lower(regexp_replace(content, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g'))"
_EX = f"{_EV}, ed AS (SELECT * FROM ec QUALIFY row_number() OVER (PARTITION BY query_id, {_TRIM} ORDER BY position, id) = 1)"
_ND = f"""{_EX},
nw AS (SELECT query_id, id, position, unnest(w) AS word, len(w) AS n FROM (SELECT query_id, id, position, {_cw("content")} AS w FROM ed)),
ns AS (SELECT x.query_id, x.position, y.position AS earlier FROM nw x JOIN nw y ON x.query_id = y.query_id AND x.word = y.word AND y.position < x.position
  GROUP BY x.query_id, x.position, y.position, x.n, y.n HAVING round(count(*) / (x.n + y.n - count(*))::DOUBLE, 9) >= 0.8),
nl AS (SELECT ed.query_id, ed.position, row_number() OVER (PARTITION BY ed.query_id ORDER BY ed.position) AS step, coalesce(near, []) AS near
  FROM ed LEFT JOIN (SELECT query_id, position, list(earlier) AS near FROM ns GROUP BY ALL) x ON x.query_id = ed.query_id AND x.position = ed.position),
nf AS (SELECT query_id, step, [position] AS kept FROM nl WHERE step = 1 UNION ALL
  SELECT nl.query_id, nl.step, CASE WHEN list_has_any(nf.kept, nl.near) THEN nf.kept ELSE list_append(nf.kept, nl.position) END FROM nf JOIN nl ON nl.query_id = nf.query_id AND nl.step = nf.step + 1),
nk AS (SELECT query_id, unnest(kept) AS position FROM (SELECT query_id, kept FROM nf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step DESC) = 1)),
ne AS (SELECT * FROM ed JOIN nk USING (query_id, position))"""
_WHY = """concat_ws('; ', CASE WHEN round(confidence, 9) >= 0.8 THEN 'high relevance score' WHEN round(confidence, 9) >= 0.6 THEN 'good relevance score' ELSE 'moderate relevance score' END,
  CASE WHEN len(matched) > 3 THEN 'matches ' || len(matched) || ' terms including: ' || array_to_string(matched[1:3], ', ') WHEN len(matched) > 0 THEN 'matches terms: ' || array_to_string(matched, ', ') END,
  CASE WHEN age_days < 1 THEN 'very recent content' WHEN age_days < 7 THEN 'recent content' END)"""


def _six(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def _sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# ------------------------------------------------------------------ the queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


@_register("idx_tokenize_counts", f"SELECT doc_id AS id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_it('text')} AS t FROM documents)")
def idx_tokenize_counts(spark, d):
    return TS.token_counts(S.documents(spark, d), T.index_tokens)


@_register("idx_postings_df", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_it('text')})) AS term FROM documents) GROUP BY term")
def idx_postings_df(spark, d):
    return TS.document_frequencies(S.documents(spark, d))


@_register("idx_search", f"WITH {_IX} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ix QUALIFY rank <= 10")
def idx_search(spark, d):
    return TS.index_search(S.documents(spark, d), S.text_queries(spark, d))


@_register("idx_search_filtered", f"WITH {_IX} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ix JOIN documents ON doc_id = id WHERE lang = 'en' AND source = 'src1' QUALIFY rank <= 10")
def idx_search_filtered(spark, d):
    return TS.index_search(S.documents(spark, d), S.text_queries(spark, d), where=(F.col("lang") == "en") & (F.col("source") == "src1"))


@_register("idx_search_sorted_paged", f"WITH {_IX} SELECT query_id, id, score FROM ix QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) BETWEEN 6 AND 15")
def idx_search_sorted_paged(spark, d):
    every = TS.index_search(S.documents(spark, d), S.text_queries(spark, d), None)
    return TS.top(every, 15, F.asc("id")).where("rank > 5").drop("rank")


@_register("idx_multi_search", f"WITH {_IX} SELECT query_id, count(*) AS hits, max(score) AS best, sum(score)::BIGINT AS total FROM ix GROUP BY query_id")
def idx_multi_search(spark, d):
    return TS.index_search(S.documents(spark, d), S.text_queries(spark, d), None).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"), F.sum("score").alias("total"))


@_register("idx_suggest", f"SELECT DISTINCT term FROM (SELECT unnest({_it('text')}) AS term FROM documents) WHERE starts_with(term, 'tho') ORDER BY term LIMIT 20")
def idx_suggest(spark, d):
    return TS.suggest(S.documents(spark, d), "tho", 20)


@_register("idx_size", "SELECT count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents")
def idx_size(spark, d):
    return TS.index_size(S.documents(spark, d))


@_register("idx_highlight", """SELECT doc_id AS id, replace(substring(text, greatest(p - 20, 1), p - greatest(p - 20, 1) + 28), 'licensed', '<em>licensed</em>') AS highlight
FROM (SELECT doc_id, text, instr(lower(text), 'licensed') AS p FROM documents) WHERE p > 0""")
def idx_highlight(spark, d):
    return TS.highlights(S.documents(spark, d), "licensed")


@_register("kw_tokenize", f"SELECT doc_id AS id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_kt('text')} AS t FROM documents)")
def kw_tokenize(spark, d):
    return TS.token_counts(S.documents(spark, d), T.keyword_tokens)


@_register("kw_bm25", f"WITH {_Q}, {_BM.replace('{only}', 'TRUE')} SELECT query_id, id, round(bm25, 6) AS bm25, matched FROM bm")
def kw_bm25(spark, d):
    return TS.bm25(S.documents(spark, d), S.text_queries(spark, d)).select("query_id", "id", *_six("bm25"), "matched")


@_register("kw_search", f"WITH {_kw(10)} SELECT query_id, id, {_sql6('score', 'bm25')}, matched, rank::INTEGER AS rank FROM kr")
def kw_search(spark, d):
    return TS.keyword_search(S.documents(spark, d), S.text_queries(spark, d)).select("query_id", "id", *_six("score", "bm25"), "matched", "rank")


@_register("kw_search_multiple", f"""WITH {_kw(10)}, fi AS (SELECT id, min(query_id) AS query_id FROM kr GROUP BY id),
te AS (SELECT DISTINCT term FROM qk), mu AS (SELECT id, bytes, sum(ln(1000.0::DOUBLE / (1 + tf)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (length / 100.0::DOUBLE)))) AS bm25, count(*) AS matched
  FROM tf JOIN te USING (term) WHERE id IN (SELECT id FROM fi) GROUP BY ALL),
ms AS (SELECT id, bm25 * (1 + matched / (SELECT count(*) FROM te)::DOUBLE * 0.5::DOUBLE) * CASE WHEN bytes > 1000 THEN 1000.0::DOUBLE / bytes ELSE 1.0 END AS score, matched FROM mu)
SELECT id, query_id, round(score, 6) AS score, matched FROM ms JOIN fi USING (id) ORDER BY round(ms.score, 9) DESC, id LIMIT 10""")
def kw_search_multiple(spark, d):
    return TS.keyword_search_multiple(S.documents(spark, d), S.text_queries(spark, d)).select("id", "query_id", *_six("score"), "matched")


@_register("kw_corpus_bm25", f"""WITH {_Q}, {_BM.replace("{only}", "TRUE")}, st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM dt), dq AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qk) GROUP BY term),
sc AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / av)) * weight) AS score FROM tf JOIN dq USING (term) JOIN qk USING (term), st GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sc.score, 9) DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 10""")
def kw_corpus_bm25(spark, d):
    return TS.corpus_bm25(S.documents(spark, d), S.text_queries(spark, d), 10).select("query_id", "id", *_six("score"), "rank")


@_register("vec_cosine_pairs", f"WITH {_VS} SELECT query_id, id, round(similarity, 6) AS similarity FROM si")
def vec_cosine_pairs(spark, d):
    return VS.similarities(S.vectors(spark, d), S.vector_queries(spark, d)).select("query_id", "id", *_six("similarity"))


@_register("vec_knn", f"WITH {_VS}, {_nearest(10)} SELECT query_id, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM vn")
def vec_knn(spark, d):
    return VS.nearest(S.vectors(spark, d), S.vector_queries(spark, d), 10).select("query_id", "id", *_six("similarity"), "rank")


@_register("vec_search_minmax", f"WITH {_VS}, {_nearest(10)}, {_MINMAX} SELECT query_id, id, {_sql6('similarity', 'score')}, rank::INTEGER AS rank FROM vs")
def vec_search_minmax(spark, d):
    return VS.search(S.vectors(spark, d), S.vector_queries(spark, d)).select("query_id", "id", *_six("similarity", "score"), "rank")


@_register("vec_search_filtered", f"WITH {_VS}, {_nearest(10, 'label = 1')}, {_MINMAX} SELECT query_id, id, {_sql6('similarity', 'score')}, rank::INTEGER AS rank FROM vs")
def vec_search_filtered(spark, d):
    return VS.search(S.vectors(spark, d), S.vector_queries(spark, d), where=F.col("label") == 1).select("query_id", "id", *_six("similarity", "score"), "rank")


@_register("vec_search_multiple", f"""WITH {_VS}, {_nearest(10)}, {_MINMAX}, one AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_id) = 1)
SELECT id, query_id, round(similarity, 6) AS similarity FROM one ORDER BY round(one.similarity, 9) DESC, id LIMIT 10""")
def vec_search_multiple(spark, d):
    return VS.search_multiple(S.vectors(spark, d), S.vector_queries(spark, d)).select("id", "query_id", *_six("similarity"))


@_register("vec_similarity_matrix", f"WITH {_VQ} SELECT a.query_id AS a, b.query_id AS b, CASE WHEN a.query_id = b.query_id THEN 1.0 ELSE round(list_cosine_similarity(a.qe, b.qe), 6) END::DOUBLE AS similarity FROM vq a, vq b")
def vec_similarity_matrix(spark, d):
    return VS.similarity_matrix(S.vector_queries(spark, d)).select("a", "b", *_six("similarity"))


@_register("vec_normalize", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def vec_normalize(spark, d):
    v = S.vectors(spark, d)
    return VS.normalize(v).select("id", F.round(VS.norm(F.col("embedding")), 5).alias("unit")).join(v.select("id", F.round(VS.norm(F.col("embedding")), 5).alias("norm")), "id").select("id", "norm", "unit")


@_register("fuse_rrf", f"WITH {_fu()} SELECT query_id, id, round(rrf, 6) AS rrf, methods FROM fu")
def fuse_rrf(spark, d):
    return fused(spark, d).select("query_id", "id", *_six("rrf"), F.array_join("methods", ",").alias("methods"))


@_register("fuse_combined", f"WITH {_fu()} SELECT query_id, id, {_sql6('combined', 'final')}, rank::INTEGER AS rank FROM fu")
def fuse_combined(spark, d):
    return fused(spark, d).select("query_id", "id", *_six("combined", "final"), "rank")


@_register("fuse_weighted", f"WITH {_fu(0.7, 0.3)} SELECT query_id, id, {_sql6('combined', 'final')}, rank::INTEGER AS rank FROM fu WHERE rank <= 10")
def fuse_weighted(spark, d):
    return fused(spark, d, weights={"vector": 0.7, "keyword": 0.3}, limit=10).select("query_id", "id", *_six("combined", "final"), "rank")


@_register("fuse_overlap_matrix", f"WITH {_fu()} SELECT a.query_id, a.m AS method_a, b.m AS method_b, count(*) AS n FROM nz a JOIN nz b ON a.query_id = b.query_id AND a.id = b.id AND a.m <> b.m GROUP BY ALL")
def fuse_overlap_matrix(spark, d):
    return FU.overlap(fused(spark, d))


@_register("fuse_stats", f"WITH {_fu()} SELECT query_id, count(*) AS n_results, count(*) FILTER (n > 1) AS n_multi, round(avg(final), 6) AS average FROM fu GROUP BY query_id")
def fuse_stats(spark, d):
    return FU.stats(fused(spark, d)).select("query_id", "n_results", "n_multi", *_six("average"))


@_register("rank_factors", f"WITH {_RK} SELECT query_id, id, {_sql6('relevance', 'freshness', 'authority_score', 'quality_score', 'personal')} FROM rq")
def rank_factors(spark, d):
    return RK.factors(rankable(spark, d), RANKING).select("query_id", "id", *_six("relevance", "freshness", "authority_score", "quality_score", "personal"))


@_register("rank_diversity", f"WITH {_RK} SELECT query_id, id, round(diversity, 6) AS diversity FROM rd")
def rank_diversity(spark, d):
    return RK.diversity(rankable(spark, d)).select("query_id", "id", *_six("diversity"))


@_register("rank_final", f"WITH {_RK} SELECT query_id, id, round(final, 6) AS final, boosts, penalties, rank::INTEGER AS rank FROM rr")
def rank_final(spark, d):
    return ranked(spark, d).select("query_id", "id", *_six("final"), F.array_join("boosts", ",").alias("boosts"), F.array_join("penalties", ",").alias("penalties"), "rank")


@_register("rank_stats", f"""WITH {_RK} SELECT query_id, count(*) AS n, {', '.join(f'round(avg({x}), 6) AS avg_{x}' for x in ('relevance', 'freshness', 'authority_score', 'quality_score', 'diversity', 'personal'))},
sum(CASE WHEN boosts = '' THEN 0 ELSE len(string_split(boosts, ',')) END)::BIGINT AS boosts, sum(CASE WHEN penalties = '' THEN 0 ELSE len(string_split(penalties, ',')) END)::BIGINT AS penalties FROM rr GROUP BY query_id""")
def rank_stats(spark, d):
    out = RK.stats(ranked(spark, d))
    return out.select("query_id", "n", *_six(*(c for c in out.columns if c.startswith("avg_"))), "boosts", "penalties")


@_register("ev_confidence_filter", f"WITH {_EV} SELECT query_id, id, round(confidence, 6) AS confidence FROM ea WHERE round(ea.confidence, 9) >= 0.4")
def ev_confidence_filter(spark, d):
    return EV.confident(assembly(spark, d), 0.4).select("query_id", "id", *_six("confidence"))


@_register("ev_exact_dedup", f"WITH {_EX} SELECT query_id, id, position FROM ed")
def ev_exact_dedup(spark, d):
    return EV.exact_dedup(EV.confident(assembly(spark, d))).select("query_id", "id", F.col("position").cast("long").alias("position"))


@_register("ev_greedy_dedup", f"WITH RECURSIVE {_ND} SELECT query_id, id, position FROM ne")
def ev_greedy_dedup(spark, d):
    return EV.near_dedup(EV.confident(assembly(spark, d))).select("query_id", "id", F.col("position").cast("long").alias("position"))


@_register("ev_why_selected", f"WITH {_EV} SELECT query_id, id, {_WHY} AS why_selected FROM ea")
def ev_why_selected(spark, d):
    return assembly(spark, d).select("query_id", "id", EV.why_selected().alias("why_selected"))


@_register("ev_histogram", f"""WITH {_EV} SELECT query_id, CASE WHEN c >= 0.8 THEN '0.8-1.0' WHEN c >= 0.6 THEN '0.6-0.8' WHEN c >= 0.4 THEN '0.4-0.6' WHEN c >= 0.2 THEN '0.2-0.4' ELSE '0.0-0.2' END AS bucket, count(*) AS n
FROM (SELECT query_id, round(confidence, 9) AS c FROM ea) GROUP BY ALL""")
def ev_histogram(spark, d):
    return EV.histogram(assembly(spark, d))


@_register("ev_best_per_source", f"WITH {_EV} SELECT query_id, source, id, round(confidence, 6) AS confidence FROM ea QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY round(ea.confidence, 9) DESC, id) = 1")
def ev_best_per_source(spark, d):
    return EV.best_per_source(assembly(spark, d)).select("query_id", "source", "id", *_six("confidence"))


@_register("ev_conflicts", f"""WITH {_EV} SELECT a.query_id, a.id, b.id AS other FROM ea a JOIN ea b ON a.query_id = b.query_id AND a.position < b.position AND a.source <> b.source AND abs(round(a.confidence - b.confidence, 9)) > 0.2""")
def ev_conflicts(spark, d):
    return EV.conflicts(assembly(spark, d), gap=0.2)


@_register("ev_self_critique", f"""WITH {_EV} SELECT query_id, count(*) || ' results, ' || CASE WHEN round(avg(confidence), 9) < 0.3 THEN 'low' WHEN round(avg(confidence), 9) > 0.8 THEN 'high' ELSE 'moderate' END || ' confidence' AS critique FROM ea GROUP BY query_id""")
def ev_self_critique(spark, d):
    return EV.self_critique(assembly(spark, d))


@_register("e2e_recall", f"""WITH RECURSIVE {_ND}, nn AS (SELECT * FROM ne QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position, id) <= 50)
SELECT query_id, id, round(confidence, 6) AS confidence, source, {_WHY} AS why_selected, CASE WHEN strlen(content) > 2000 THEN substring(content, 1, 2000) || '...' ELSE content END AS content,
row_number() OVER (PARTITION BY query_id ORDER BY round(nn.confidence, 9) DESC, id)::INTEGER AS rank FROM nn WHERE content <> '' AND source <> ''""")
def e2e_recall(spark, d):
    return EV.assemble(assembly(spark, d)).select("query_id", "id", *_six("confidence"), "source", "why_selected", "content", "rank")
