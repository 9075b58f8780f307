"""Worked values and small cases."""

import math

import pytest
from pyspark.sql import Row, functions as F

from lodestone.functions import text as T
from lodestone.functions.dialect import java
from lodestone.operators import evidence as EV, extract as X, fusion as FU, graph as G, preprocess as P, provenance as PR, rank as RK, resolve as R, storage as ST, text_search as TS, understand as U, validate as V, vector_search as VS


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_fusion_of_two_lists(spark):
    schema = "query_id int, id string, score double, rank int"
    vector = rows(spark, schema, (1, "doc1", 0.92, 1), (1, "doc2", 0.85, 2), (1, "doc3", 0.78, 3))
    keyword = rows(spark, schema, (1, "doc2", 0.88, 1), (1, "doc4", 0.81, 2), (1, "doc5", 0.76, 3))
    got = {r.id: r for r in FU.fuse(FU.inputs(vector=vector, keyword=keyword)).collect()}
    want = {"doc2": (0.032522, 0.056914), "doc1": (0.016393, 0.032787), "doc4": (0.016129, 0.022849), "doc3": (0.015873, 0.015873), "doc5": (0.015873, 0.015873)}
    assert {k: (round(v.rrf, 6), round(v.final, 6)) for k, v in got.items()} == want
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1].rank)] == ["doc2", "doc1", "doc4", "doc3", "doc5"]
    assert got["doc2"].methods == ["vector", "keyword"]
    assert {(r.method_a, r.method_b, r.n) for r in FU.overlap(FU.fuse(FU.inputs(vector=vector, keyword=keyword))).collect()} == {("vector", "keyword", 1), ("keyword", "vector", 1)}
    with pytest.raises(ValueError):
        FU.inputs()


def test_bm25_by_hand(spark):
    docs = rows(spark, "id int, content string", (1, "machine learning systems process data machine models quickly learning"), (2, "nothing here"), (3, ""))
    queries = rows(spark, "query_id int, query string", (7, "machine learning"))
    got = TS.bm25(docs, queries, average=50.0).collect()
    share = lambda tf, n: math.log(1000 / (1 + tf)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 50))
    assert [(r.id, r.matched) for r in got] == [(1, 2)]
    assert got[0].bm25 == pytest.approx(2 * share(2, 9))


def test_freshness_and_penalties(spark):
    schema = "query_id int, id string, query string, content string, base_score double, age_days double, source string, title string, authority double, quality double"
    c = RK.Ranking(relevance=1, freshness=2, authority=0.5, diversity=0, quality=0.5, personal=0, boost_at=0, penalty_at=0)
    short = "x" * 30
    got = {r.id: r for r in RK.rank(rows(spark, schema, (1, "old", "", short + "a", 0.95, 365.0, "s", None, None, None), (1, "new", "", short + "b", 0.7, 1 / 24, "s", None, None, None)), c).collect()}
    assert round(got["old"].final, 6) == 0.352801 and round(got["new"].final, 6) == 0.833653
    assert got["new"].rank == 1 and "freshness_boost" in got["new"].boosts and got["old"].penalties == ["quality_penalty"]


def test_bigram_names(spark):
    pairs = rows(spark, "a string, b string", ("artificial intelligence", "artificial inteligence"), ("openai", "open ai"), ("machine learning", "deep learning"), ("Same ", "same"), ("a", "b"))
    got = [round(r[0], 6) for r in pairs.select(R.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.954545, 0.571429, 0.444444, 1.0, 0.0]
    people = rows(spark, "id string, etype string, name string, confidence double", ("1", "CONCEPT", "artificial intelligence", 0.5), ("2", "CONCEPT", "artificial inteligence", 0.5), ("3", "CONCEPT", "biology", 0.5), ("4", "PERSON", "biology", 0.9))
    assert sorted(r.id for r in R.deduplicate(people).collect()) == ["1", "3", "4"]


def test_pagerank_and_graph(spark):
    nodes = rows(spark, "id string, type string, name string", ("page1", "Entity", "a"), ("page2", "Entity", "b"), ("page3", "Claim", "c"))
    edges = rows(spark, "id string, src string, dst string, type string, weight double", ("e1", "page1", "page2", "RELATED_TO", 1.0), ("e2", "page1", "page3", "RELATED_TO", 1.0), ("e3", "page2", "page3", "SUPPORTS", 2.0))
    got = {r.id: round(r.score, 6) for r in G.pagerank(nodes, edges).collect()}
    assert got == {"page1": 0.197583, "page2": 0.281553, "page3": 0.520865}
    a, c = nodes.where("id = 'page1'"), nodes.where("id = 'page3'")
    assert {(tuple(r.nodes), r.cost) for r in G.paths(edges, a, c, 3).collect()} == {(("page1", "page3"), 1.0), (("page1", "page2", "page3"), 3.0)}
    assert G.shortest_paths(edges, a, c).first().cost == 1.0
    assert G.paths(edges, a, a, 3).first().cost == 0.0
    assert [(r.neighbor, r.type) for r in G.neighbors(nodes, edges, a, node_types=["Claim"]).collect()] == [("page3", "Claim")]
    kept, rest = G.delete_nodes(nodes, edges, nodes.where("id = 'page2'"))
    assert kept.count() == 2 and [r.id for r in rest.collect()] == ["e2"]
    lone = nodes.unionByName(rows(spark, "id string, type string, name string", ("z", "Event", "z")))
    assert {(r.component, r.size) for r in G.component_sizes(G.components(lone, edges)).collect()} == {("page1", 3), ("z", 1)}
    assert G.pagerank(nodes.limit(0), edges).count() == 0
    bad = edges.unionByName(rows(spark, edges.schema, ("x", "page1", "nowhere", "RELATED_TO", 1.0), ("y", "page1", "page2", "LIKES", 1.0), ("w", "page1", "page2", "SUPPORTS", -1.0)))
    assert sorted(r.id for r in G.rejected_edges(bad, nodes).collect()) == ["w", "x", "y"]


def test_vectors(spark):
    v = rows(spark, "id long, embedding array<float>", (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, None))
    q = rows(spark, "query_id long, qe array<float>", (1, [1.0, 0.0]))
    got = {r.id: round(r.similarity, 6) for r in VS.similarities(v, q).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.707107, 4: 0.0, 5: 0.0, 6: 0.0}
    assert [r.id for r in VS.nearest(v, q, 2).orderBy("rank").collect()] == [1, 3]
    assert [(r.id, r.score) for r in VS.search(v, q).orderBy("rank").collect()] == [(1, 1.0), (3, 0.0)]
    unit = VS.normalize(v.where("id = 3")).first().embedding
    assert [round(x, 5) for x in unit] == [0.70711, 0.70711]
    assert VS.nearest(v, q.limit(0), 2).count() == 0
    assert round(v.where("id = 3").select(VS.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0)))).first()[0], 6) == 0.707107


def test_chunks(spark):
    words = " ".join(f"w{i:03d}" for i in range(100))
    docs = rows(spark, "id int, content string", (1, words), (2, ""), (3, "x" * 250), (4, "One. Two is here. Three!  " + "y" * 130 + ". End."))
    got = P.chunk_by_size(docs, most=100, overlap=20).collect()
    for doc in (1, 3):
        own = sorted((r for r in got if r.id == doc), key=lambda r: r.ordinal)
        assert own[0].start == 0 and own[-1].end == len(docs.where(f"id = {doc}").first().content)
        assert all(b.start == max(a.end - 20, a.start + 1) and len(a.chunk) <= 100 for a, b in zip(own, own[1:]))
    assert not [r for r in got if r.id == 2]
    by = P.chunk(docs.where("id = 4"), "sentence", most=100, overlap=20).orderBy("ordinal").collect()
    assert [r.strategy for r in by] == ["sentence", "sentence-size", "sentence-size", "sentence"]
    assert by[0].chunk == "One. Two is here. Three!  " and by[-1].chunk == "End."
    para = rows(spark, "id int, content string", (1, "aa\n\nbb\n \ncc"), (2, "a" * 30 + ". " + "b" * 30 + ".\n\nshort"))
    out = [(r.id, r.chunk, r.strategy) for r in P.chunk(para, "paragraph", most=40, overlap=5).orderBy("id", "ordinal").collect()]
    assert out == [(1, "aa\n\nbb\n\ncc", "paragraph"), (2, "a" * 30 + ". ", "paragraph-sentence"), (2, "b" * 30 + ".", "paragraph-sentence"), (2, "short", "paragraph")]
    with pytest.raises(ValueError):
        P.chunk(docs, "size", most=10, overlap=10)


def test_entities_and_claims(spark):
    docs = rows(spark, "id int, content string", (1, "Dr. Ada Lovelace wrote to ada@example.com on 2024-01-15. The Acme Corporation paid 1,234 dollars."), (2, ""), (3, None))
    got = {(r.etype, r.name) for r in X.entities(docs).collect()}
    assert ("EMAIL", "ada@example.com") in got and ("DATE", "2024-01-15") in got and ("NUMBER", "1,234") in got and ("PERSON", "Ada Lovelace") in {(e, n.removeprefix("Dr ")) for e, n in got}
    said = rows(spark, "id int, content string", (1, "Entropy means disorder of a system. According to data, Heavy Rain increases floods. It is raining today. I think cats are animals."))
    claims = {(r.subject, r.predicate, r.object): r.confidence for r in X.claims(said).collect()}
    assert claims[("Entropy", "is_defined_as", "disorder of a system")] == 0.9
    assert claims[("According to data, Heavy Rain", "increases", "floods")] == 0.9
    assert not any("It" in k[0] for k in claims)


def test_queries_understood(spark):
    got = {r.query_id: r for r in U.expand(U.parse(rows(spark, "query_id int, query string", (1, 'find "big data" type:claim type:event'), (2, "Ada Lovelace"), (3, "fast ai last week"), (4, "")))).collect()}
    assert got[1].phrases == ["big data"] and got[1].filters == ["type=event"] and got[1].query_type == "semantic"
    assert got[2].query_type == "entity" and got[3].time_range == "last week"
    assert "quick ai last week" in got[3].synonyms and "fast artificial intelligence last week" in got[3].acronyms
    assert len(got[3].expansions) == 8 and got[4].terms == []


def test_validation(spark):
    q = rows(spark, "query string, max_results int, time_budget int", ("ok", 5, 0), ("<SCRIPT>", 101, -1), (None, 0, 0))
    assert [len(r[0]) for r in q.select(V.recall_errors()).collect()] == [0, 3, 1]
    assert q.limit(1).select(T.sanitized(F.lit(" a <b>\x00\t& 'c'\n"))).first()[0] == "a &lt;b&gt; &amp; &#39;c&#39;"
    assert q.limit(1).select(V.tags(F.array(F.lit(" -Foo Bar!_ "), F.lit("--")))).first()[0] == ["foobar"]
    assert [r[0] for r in rows(spark, "s string", ("ERROR",), ("info",), ("odd",)).select(V.severity(F.col("s"))).collect()] == ["high", "low", "medium"]
    assert "[\\t\\n\\f\\r ]" in java(r"\bx[\s]\s") and "\\b" not in java(r"\bx")


def test_evidence_folds(spark):
    schema = "query_id int, id int, content string, confidence double, source string, age_days double, position int, matched array<string>, related array<string>, path array<string>"
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    data = [(1, 1, text, 0.95, "official site", 0.5, 1, ["alpha"], ["x"], ["a", "b", "c"]), (1, 2, text + " more", 0.9, "b", 5.0, 2, [], [], []), (1, 3, "unlike words here", 0.3, "c", 50.0, 3, ["p", "q", "r", "s"], [], []), (1, 4, text.upper(), 0.2, "d", 1.0, 4, [], [], [])]
    out = EV.assemble(rows(spark, schema, *data)).orderBy("rank").collect()
    assert [r.id for r in out] == [1, 3]
    assert out[0].why_selected == "high relevance score; matches terms: alpha; connected via 2-hop graph path; related to 1 entities; from official source; very recent content"
    assert out[1].why_selected == "moderate relevance score; matches 4 terms including: p, q, r" and out[0].relation_map == {"x": "related_entity"}
    assert {(r.id, r.other) for r in EV.conflicts(rows(spark, schema, *data)).collect()} == {(1, 3), (1, 4), (2, 3), (2, 4)}
    assert {(r.bucket, r.n) for r in EV.histogram(rows(spark, schema, *data)).collect()} == {("0.8-1.0", 2), ("0.2-0.4", 2)}


def test_storage_and_provenance(spark, tmp_path):
    t = rows(spark, "id int, v string", (1, "a"), (2, "b"))
    b = rows(spark, "id int, v string, seq int", (2, "x", 1), (2, "y", 2), (3, "z", 1))
    assert sorted((r.id, r.v) for r in ST.upsert(t, b, "id", order="seq").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted((r.id, r.v) for r in ST.update(t, rows(spark, "id int, v string", (2, "q"), (9, "q")), "id", ["v"]).collect()) == [(1, "a"), (2, "q")]
    assert [r.id for r in ST.missing(t, rows(spark, "id int", (9,), (1,)), "id").collect()] == [9]
    assert ST.load(spark, str(tmp_path / "none"), "id int").count() == 0 and not ST.healthy(spark, str(tmp_path / "none"))
    ST.save(t, str(tmp_path / "t"))
    assert ST.load(spark, str(tmp_path / "t"), "id int, v string").count() == 2
    ST.save(t, str(tmp_path / "j"), form="json")
    assert ST.load(spark, str(tmp_path / "j"), "id int, v string", form="json").count() == 2
    ev = rows(spark, "memory_id int, event_id int, at long, kind string", *[(1, k, k, "update") for k in range(12)], (2, 99, 5, "create"))
    v = PR.versions(ev)
    assert v.where("memory_id = 1").count() == 12 and PR.verified(v).where("NOT sound").count() == 0
    assert PR.current(v).where("memory_id = 1").first().history.count("update") == 10


def test_recall_and_write(spark, tmp_path):
    from lodestone.plans import recall as RC

    docs = rows(spark, "id int, content string, source string", (1, "Machine learning improves search. Entropy means disorder of things.", "a"), (2, "Gardens need water and sun.", "b"), (3, "<script>x</script>", "c"), (4, "", "d"))
    q, bad = RC.valid_queries(rows(spark, "query_id int, query string, max_results int, time_budget int", (1, "machine learning", 0, 0), (2, "", 0, 0)))
    assert bad.count() == 1
    v = rows(spark, "id long, embedding array<float>", (1, [1.0, 0.0]), (2, [0.0, 1.0]))
    qv = rows(spark, "query_id int, qe array<float>", (1, [1.0, 0.1]))
    out = RC.recall(docs, v, q, qv).orderBy("rank").collect()
    assert [r.id for r in out] == [1]
    assert RC.recall(docs, v, q, expand=True).count() >= 1
    # both searches see the filtered documents alone: the other one is nearer and holds the words
    assert [r.id for r in RC.recall(docs, v, q, rows(spark, "query_id int, qe array<float>", (1, [1.0, 0.9])), filters={"source": "b"}).collect()] == [2]
    assert RC.recall(docs, v, q, qv, filters={"source": "none"}).count() == 0
    stored = RC.write(docs, str(tmp_path / "w"))
    assert stored["rejected"].count() == 2 and stored["chunks"].count() == 2 and stored["claims"].count() >= 1
    left = RC.forget(stored, stored["chunks"].where("document = 1"))
    assert left["chunks"].count() == 1 and left["claims"].count() == 0


def test_writes_add_up(spark, tmp_path):
    from lodestone.operators import storage as ST
    from lodestone.plans import recall as RC

    path, schema = str(tmp_path / "w"), "id int, content string, source string"
    RC.write(rows(spark, schema, (1, "First text of one document.", "a"), (2, "Second text of another.", "a")), path)
    out = RC.write(rows(spark, schema, (3, "Third text comes later.", "b"), (1, "First text, revised.", "a"), (1, "First text, earlier.", "a"), (4, "Second text of another.", "c"), (5, "", "c")), path)
    held = {r.document: r.content for r in out["chunks"].collect()}
    assert held == {1: "First text, revised.", 2: "Second text of another.", 3: "Third text comes later.", 4: "Second text of another."}
    assert [(r.id, r.other) for r in out["duplicates"].collect()] == [(4, 2)] and [r.id for r in out["rejected"].collect()] == [5]
    assert {r.document for r in out["provenance"].collect()} == {1, 2, 3, 4}
    # a write that ended before its heads is not seen, and the next one goes on
    spark.read.parquet(f"{path}/chunks/segment=1").withColumn("document", F.lit(9)).write.parquet(f"{path}/chunks/segment=2")
    assert {r.document for r in RC.open_tables(spark, path)["chunks"].collect()} == {1, 2, 3, 4}
    again = RC.write(rows(spark, schema, (9, "Ninth text.", "a")), path)
    assert {r.document for r in again["chunks"].collect()} == {1, 2, 3, 4, 9} and again["chunks"].where("document = 9").first().content == "Ninth text."
    assert ST.health(spark, path, (*RC.TABLES, "lost")) == {t: True for t in RC.TABLES} | {"lost": False}


def test_upsert_has_one_row_for_a_key(spark):
    from lodestone.operators import storage as ST

    old = rows(spark, "id int, v string", (1, "a"), (2, "b"))
    got = ST.upsert(old, rows(spark, "id int, v string", (2, "x"), (2, "z"), (2, "y"), (3, "c")), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "z"), (3, "c")]


def test_equal_names_in_linear_work(spark):
    from lodestone.operators import resolve as R

    many = spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit("LOCATION").alias("etype"), F.lit(" New York ").alias("name"), (F.col("id") % 7).cast("int").alias("confidence"))
    few = rows(spark, "id string, etype string, name string, confidence int", ("x", "LOCATION", "new york", 9), ("y", "LOCATION", "new yorks", 3), ("z", "PERSON", "new york", 1))
    kept = R.deduplicate(many.unionByName(few))
    assert {r.id for r in kept.collect()} == {"x", "z"}
    assert R.similar_pairs(many.unionByName(few), 0.5).count() == 1 and R.classes(many).select("rep").distinct().count() == 1


def test_name_search_by_classes(spark, monkeypatch):
    names = [(f"c{i}", "Entity", f"Customer#{i:09d}") for i in range(300)] + [("c7", "Entity", "Store of MAPS"), ("x", "Entity", None), (None, "Entity", "tom"), ("e", "Entity", ""), ("s", "Source", "Customer"), ("ñ", "Entity", "Peña to")]
    asked = [(1, "To customer to"), (2, "map st\u00f1 ña"), (3, "0011 er"), (4, ""), (5, None), (6, "customers # zzz"), (7, "tom\tST"), (8, "e")]
    nodes, queries = rows(spark, "id string, type string, name string", *names), rows(spark, "query_id int, query string", *asked)
    held = {(q, i) for q, text in asked for i, kind, name in names if kind == "Entity" and name is not None and any(w in name.lower() for w in (text or "").lower().split())}
    first = lambda q: sorted((i for p, i in held if p == q), key=lambda i: (i is not None, (i or "").encode()))[:3]
    for most_rows in (G.BROADCAST_ROWS, 0):  # and without a broadcast
        monkeypatch.setattr(G, "BROADCAST_ROWS", most_rows)
        got = G.name_search(nodes, queries)
        if most_rows:  # no row for each pair of query and name is shuffled
            assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        found = [(r.query_id, r.id) for r in got.collect()]
        assert len(found) == len(set(found)) > 1000 and set(found) == held
        few = [(r.query_id, r.id) for r in G.name_search(nodes, queries, most=3).collect()]
        assert sorted(few, key=str) == sorted(((q, i) for q, _ in asked for i in first(q)), key=str)


def test_multi_view_cuts_classes(spark):
    from lodestone.plans import recall as RC

    nodes = spark.range(2000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.lit("Entity").alias("type"), F.lit("Customer").alias("name"))
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.lit("to be").alias("query"))
    documents, vectors = rows(spark, "id long, content string", (1, "to")), rows(spark, "id long, embedding array<float>", (1, [1.0]))
    out = RC.multi_view(documents, vectors, nodes, queries, rows(spark, "query_id long, qe array<float>", (1, [1.0])), 2).where("view = 'graph'")
    assert [tuple(r) for r in out.where("query_id = 9").select("id", "rank").orderBy("rank").collect()] == [("c0", 1), ("c1", 2)] and out.count() == 400
    joined = [int(n) for n in _made(out, "Join")]
    assert max(joined) <= 400  # two names of the class for each query, not all 2,000


def _made(df, kind: str) -> list[int]:
    """Rows that the plan's nodes of a kind made."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        x = todo.pop()
        if kind in x.nodeName():
            found.append(x.metrics().apply("numOutputRows").value())
        todo += [x.executedPlan()] if x.nodeName() == "AdaptiveSparkPlan" else [x.plan()] if "QueryStage" in x.nodeName() else [x.children().apply(i) for i in range(x.children().size())]
    return found


def test_linking(spark):
    from lodestone.operators import resolve as R

    schema = "id string, etype string, name string, confidence double, source string, properties map<string,string>"
    new = rows(spark, schema, ("n1", "ORG", "Acme Corporation", 0.5, "a", {"k": "new"}), ("n2", "ORG", "Nobody Knows", 0.4, "a", None), ("n3", "PERSON", "Acme Corporations", 0.3, "a", None))
    old = rows(spark, schema, ("s1", "ORG", "ACME Corporation", 0.95, "store", {"k": "old", "p": "1"}), ("s2", "ORG", "Acme Limited", 0.9, "store", None))
    entities, edges = R.resolve(new, old)
    got = {r.id: r for r in entities.collect()}
    assert got["n1"].name == "ACME Corporation" and got["n1"].confidence == 1.0 and got["n1"].properties == {"k": "old", "p": "1"} and got["n1"].source == "store"
    assert got["n2"].confidence == 0.4 and got["n3"].name == "Acme Corporations"
    assert [(r.id, r.type, r.weight) for r in edges.collect()] == [("link_n1_s1", "RELATED_TO", 1.0)]
    vec = "id long, etype string, name string, embedding array<float>"
    a, b = rows(spark, vec, (1, "ORG", "Acme", [1.0, 0.0]), (2, "ORG", "None", None)), rows(spark, vec, (7, "ORG", "Acme", [0.9, 0.1]), (8, "ORG", "Other", [0.0, 1.0]), (9, "ORG", "Acme", [1.0, 0.0, 0.0]))
    assert [(r.id, r.candidate, r.place) for r in R.candidates_by_embedding(a, b).collect()] == [(1, 7, 1)]


def test_long_texts_are_cut_in_linear_time(spark):
    import time

    from lodestone.operators import preprocess as P

    def took(n):
        text = spark.range(1).select(F.col("id"), F.repeat(F.lit("some words and more "), n).alias("content"))
        began = time.time()
        assert P.chunk_by_size(text, most=400, overlap=80).count() > n // 20
        return time.time() - began

    took(1000)
    assert took(250_000) < 10  # five million characters


def test_match_and_page(spark):
    from lodestone.operators import text_search as TS

    docs = rows(spark, "id int, content string", (1, "x" * 80 + " Quick brown foxes run. " + "y" * 80), (2, "nothing here"))
    q = rows(spark, "query_id int, query string", (1, "brown quick the missing"))
    pairs = rows(spark, "query_id int, id int", (1, 1), (1, 2))
    got = {r.id: r for r in TS.match(docs, q, pairs).collect()}
    assert got[1].matched == ["brown", "quick"] and all("brown foxes" in h and len(h) <= 105 for h in got[1].highlights) and got[2].matched == []
    found = rows(spark, "query_id int, id int, score int", (1, 1, 5), (1, 2, 5), (1, 3, 9), (1, 4, 1))
    assert [r.id for r in TS.page(found, 2, 1).orderBy("place").collect()] == [1, 2]
    assert [r.id for r in TS.page(found, 2, 0, by="id", descending=True).orderBy("place").collect()] == [4, 3]
    with pytest.raises(ValueError):
        TS.page(found, 1, -1)


def test_whole_recall(spark):
    from lodestone.plans import recall as RC

    docs = rows(spark, "id long, content string, source string", (1, "machine learning improves search", "a"), (2, "machine gardens", "b"))
    vectors = rows(spark, "id long, embedding array<float>", (1, [1.0, 0.0]))
    asked = rows(spark, "query_id int, query string, max_results int, time_budget int", (1, "machine learning", 1, 0), (2, "<script>", 0, 0), (3, "unheard", 0, 0))
    out = RC.handle(docs, vectors, asked)
    assert [r.query_id for r in out["rejected"].collect()] == [2]
    assert [(r.query_id, r.id) for r in out["evidence"].collect()] == [(1, 1)] and out["critique"].count() == 1 and out["conflicts"].count() == 0 and out["formatted"].count() == 1
    nodes = rows(spark, "id string, type string, name string, chunk_id long", ("e1", "Entity", "Gardens", 2))
    by_graph = RC.recall(docs, vectors, rows(spark, "query_id int, query string", (1, "learning gardens")), nodes=nodes)
    assert {r.id for r in by_graph.collect()} == {1, 2}


def test_scratch_folder_off_a_local_master(monkeypatch):
    from lodestone.sources import tables as S

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("J", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        S.shared_dir(Session)


def test_streams(spark, tmp_path):
    import datetime as dt

    from lodestone.streaming import ingest as I

    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([Row(ts=base + dt.timedelta(minutes=20 * k), user_id=1, event_type="view", value=1.0) for k in range(9)])
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = I.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == 9
    assert I.sessions(events).count() == 1
    docs = spark.createDataFrame([Row(id=1, content="a b c " * 100)])
    docs.write.parquet(str(tmp_path / "docs"))
    seen = []
    q = I.upserts(I.chunk_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), most=100, overlap=10), lambda b, e: seen.append(b.count()), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == I.chunk_stream(docs, most=100, overlap=10).count()


def test_config(tmp_path):
    from lodestone import config as CF

    c = CF.Config(processing=CF.Processing(chunk_size=500, overlap=50))
    CF.save(c, str(tmp_path / "c.json"))
    assert CF.load(str(tmp_path / "c.json")) == c
    for bad in (lambda: CF.Processing(chunk_size=10, overlap=10), lambda: CF.Retrieval(max_results=0), lambda: CF.Storage(form="xml")):
        with pytest.raises(ValueError):
            bad()


def test_options():
    from lodestone import options as O

    assert O.RecallOptions().with_filter("lang", "fr").filters == {"lang": "fr"}
    assert O.WriteOptions("a").with_tag("x").with_tag("x").with_tag("y").without_tag("x").tags == ("y",)
    for bad in (
        lambda: O.RecallOptions(max_results=0), lambda: O.RecallOptions(max_results=1001), lambda: O.RecallOptions(time_budget=0), lambda: O.RecallOptions(sort_by="size"), lambda: O.RecallOptions(min_confidence=1.1),
        lambda: O.WriteOptions(""), lambda: O.WriteOptions("a", confidence=2), lambda: O.WriteOptions("a", language="eng"), lambda: O.ManageOptions("drop"), lambda: O.ManageOptions("pin", batch_size=0),
        lambda: O.SearchOptions(""), lambda: O.SearchOptions("q", offset=-1), lambda: O.SearchOptions("q", search_type="x"), lambda: O.GraphOptions(max_depth=11), lambda: O.GraphOptions(max_nodes=0), lambda: O.GraphOptions(algorithm="x"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_format(spark):
    from lodestone.operators import format as FM

    schema = "query_id int, id int, content string, confidence double, source string, why_selected string"
    out = FM.evidence(rows(spark, schema, (1, 1, "x" * 600, 0.5, "a", " "), (1, 2, "y", 0.9, "a", "because"), (1, 3, "z", 0.05, "b", None)), least=0.1)
    got = {r.id: r for r in out.collect()}
    assert got[2].rank == 1 and len(got[1].content) == 503 and got[1].why_selected == "selected based on relevance" and 3 not in got
    assert "0.900 a: y" in FM.display(out)
    assert FM.merged_conflicts(rows(spark, "id string, kind string, severity string", ("1", "a", "severe")), rows(spark, "id string, kind string, severity string", ("1", "b", "low"), ("2", "c", "??"))).orderBy("id").collect()[0].severity == "high"
