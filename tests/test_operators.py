"""Hand-made inputs with results worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import career, diversity, evaluate, kg, rag, recency, retrieval, roles, tensor, trajectory


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_tensor_skips_and_counts(spark):
    papers = spark.createDataFrame([(1, 2000), (2, 2000), (3, 1949), (4, 2020), (5, None), (6, 2001), (7, 2001)], "paper_id int, year int")
    links = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (7, "a")], "paper_id int, author_id string")
    topics = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "x"), (5, "x"), (6, "x")], "paper_id int, topic string")
    t = tensor.tensor(papers, links, topics)
    assert rows(t, "author_id", "year", "topic_id", "frequency", "binary") == [("a", 2000, "x", 2, 1), ("a", 2000, "y", 1, 1), ("b", 2000, "x", 1, 1), ("b", 2000, "y", 1, 1)]
    shares = tensor.normalized(t).groupBy("author_id", "year").agg(F.sum("normalized").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)
    names = spark.createDataFrame([("x", "Ex")], "topic string, topic_name string")
    assert {(r.topic_id, r.topic_name) for r in tensor.tensor(papers, links, topics, names).collect()} == {("x", "Ex"), ("y", "y")}
    assert tensor.stats(t).first().asDict() == {"n_rows": 4, "n_authors": 2, "n_topics": 2, "min_year": 2000, "max_year": 2000, "max_frequency": 2}
    assert rows(tensor.top_authors(t, 1), "author_id") == [("a",)]


def test_careers(spark):
    years = spark.createDataFrame([("a", 2000), ("a", 2000), ("a", 2060), ("b", 2014), ("b", 2013)], "author_id string, year int")
    assert rows(career.profile(years), "author_id", "total_pubs", "first_year", "last_year", "active_years", "career_span") == [("a", 3, 2000, 2060, 2, 60), ("b", 2, 2013, 2014, 2, 1)]
    assert rows(career.realistic(years), "author_id", "career_span") == [("a", 0), ("b", 1)]
    # the window's first year counts: 2014 = 2019 - 5
    assert rows(career.recency_of_papers(years.where("author_id = 'b'")), "n_recent", "recency_ratio") == [(1, 0.5)]
    assert rows(career.calendar_slices(spark.createDataFrame([("a", 2000), ("a", 2001), ("a", 2005)], "author_id string, year int")), "n_slices", "avg_pubs_per_slice") == [(3, 1.0)]


def test_coverage_order(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (1, 5), (1, 6), (1, 0)], "t int, p int")
    assert [r[0] for r in df.select(career.coverage(F.col("t"), F.col("p"))).collect()] == ["none", "none", "full", "partial", "full"]


def test_regimes_fill_authors_without_tensor(spark):
    authors = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "author_id int, name string, n_citation double")
    profiles = spark.createDataFrame([(1, 9, 2000, 2006, 3, 6), (2, 8, 2000, 2005, 3, 5)], "author_id int, total_pubs long, first_year int, last_year int, active_years long, career_span int")
    t = spark.createDataFrame([(1, 2015, "q", 2)], "author_id int, year int, topic_name string, frequency long")
    got = {r.author_id: (r.recency_ratio, r.tensor_total, r.year_coverage, r.regime) for r in career.regimes(authors, profiles, t).collect()}
    assert got == {1: (1.0, 2, "full", "B"), 2: (0.0, 0, "none", "A")}
    assert rows(career.cascade(profiles), "step", "n_authors") == [("all", 2), ("span", 1), ("span_pubs", 1), ("span_pubs_active", 1)]
    assert rows(career.histogram(profiles, "career_span", 2, 5)) == [(4, 2)]


def cells_of(spark, data, size=5):
    t = spark.createDataFrame(data, "author_id string, year int, topic_name string, frequency long")
    first = spark.createDataFrame([("a", 2000), ("b", 2000), ("c", 2000)], "author_id string, first_year int")
    return trajectory.sliced(t, first, size)


def test_trajectories(spark):
    data = [("a", 1999, "x", 50), ("a", 2000, "y", 2), ("a", 2001, "x", 2), ("a", 2015, "x", 4), ("b", 2003, "x", 1), ("c", 2000, "x", 3), ("c", 2006, "x", 3)]
    cells = cells_of(spark, data)
    meta = trajectory.metadata(cells)
    # pre-career rows drop, b has one slice, ties go to the first topic by name
    assert rows(meta, "author_id", "slice_id", "year_start", "year_end", "pub_count", "dominant_topic", "n_topics_active") == [
        ("a", 0, 2000, 2004, 4, "x", 2), ("a", 3, 2015, 2019, 4, "x", 1), ("c", 0, 2000, 2004, 3, "x", 1), ("c", 1, 2005, 2009, 3, "x", 1),
    ]
    cont = {r.author_id: r for r in trajectory.continuity(cells).collect()}
    assert abs(cont["a"].avg_continuity - 1 / math.sqrt(2)) < 1e-12 and abs(cont["c"].max_drift) < 1e-12
    # constant counts: slope 0 and r2 0
    assert rows(trajectory.productivity(meta)) == [("a", 0.0, 0.0), ("c", 0.0, 0.0)]
    grow = trajectory.productivity(trajectory.metadata(cells_of(spark, [("a", 2000, "x", 1), ("a", 2005, "x", 3), ("a", 2019, "x", 5)])))
    assert rows(grow) == [("a", 2.0, 1.0)]
    apart = trajectory.continuity(cells_of(spark, [("a", 2000, "x", 1), ("a", 2005, "y", 3)])).first()
    assert (apart.avg_continuity, apart.avg_drift, apart.max_drift) == (0.0, 1.0, 1.0)
    assert {r.author_id: r.topic_breadth for r in trajectory.breadth(meta).collect()} == {"a": 1.5, "c": 1.0}


def test_overlapping_slices(spark):
    t = spark.createDataFrame([("a", 2000, "x", 1), ("a", 2003, "x", 1)], "author_id string, year int, topic_name string, frequency long")
    first = spark.createDataFrame([("a", 2000)], "author_id string, first_year int")
    got = trajectory.sliced(t, first, size=4, step=2)
    assert rows(got, "slice_id", "year_start", "year_end", "frequency") == [(0, 2000, 2003, 2), (1, 2002, 2005, 1)]


def test_recency(spark):
    t = spark.createDataFrame([("a", 2019, "x", 1), ("a", 2009, "y", 2), ("b", 2014, "x", 3)], "author_id string, year int, topic_name string, frequency long")
    v = {(r.author_id, r.topic_name): r for r in recency.vectors(t).collect()}
    assert abs(v["a", "x"].weight_slow - 1 / (1 + 2 * math.exp(-1))) < 1e-12 and abs(v["a", "y"].weight_raw - 2 / 3) < 1e-12
    assert rows(recency.topic_shift(recency.vectors(t)), "author_id", "dominant_topic", "raw_topic", "topic_shift") == [("a", "x", "y", 1), ("b", "x", "x", 0)]
    e = dict(rows(recency.entropy(recency.vectors(t), recency.vocabulary(t))))
    p = v["a", "x"].weight_slow
    assert abs(e["a"] + (p * math.log(p) + (1 - p) * math.log(1 - p)) / math.log(2)) < 1e-12 and e["b"] == 0.0
    one = t.where("author_id = 'b'")
    assert rows(recency.entropy(recency.vectors(one), recency.vocabulary(one))) == [("b", 0.0)]
    assert rows(recency.activity(t), "author_id", "recent_pubs", "tensor_total") == [("a", 1, 3), ("b", 3, 3)]


def test_positions(spark):
    a = spark.createDataFrame([(1, "s", 1, 1), (2, "s", 1, 3), (2, "m", 2, 3), (2, "l", 3, 3)], "paper_id int, author_id string, pos int, n_authors int")
    got = {r.author_id: (r.kg_papers, r.n_first, r.n_middle, r.n_last, r.n_sole, r.pct_last, r.pos_reliable) for r in roles.positions(a).collect()}
    assert got == {"s": (2, 2, 0, 1, 1, 0.5, 0.4), "m": (1, 0, 1, 0, 0, 0.0, 0.2), "l": (1, 0, 0, 1, 0, 1.0, 0.2)}
    assert roles.position_roles(a).first().asDict() == {"n_sole": 1, "n_first": 1, "n_last": 1, "n_middle": 1}


def test_zscore_of_what_does_not_vary_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert rows(roles.zscores(df, ("a", "b")), "z_a", "z_b") == sorted([(-1 / math.sqrt(2), 0.0), (1 / math.sqrt(2), 0.0)], key=str)


def test_probabilities(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1000.0, 0.0, -5.0), (0.0, 1.0, 1.0)], "score_emerging double, score_collaborating double, score_supervising double")
    got = roles.probabilities(df).collect()
    assert [r.dominant_role for r in got] == ["emerging", "emerging", "collaborating"]
    assert got[0].prob_emerging == 0.3333 and got[1].prob_emerging == 1.0
    assert all(abs(r.prob_emerging + r.prob_collaborating + r.prob_supervising - 1) < 2e-4 for r in got)


def pool_of(spark, groups, extra=()):
    data = [(f"{r[0]}{i}", i, r, 1 - i / 100, i + 1) for r, n in groups.items() for i in range(n)]
    return spark.createDataFrame([*data, *extra], "author_id string, pos int, role string, prob double, rn int")


def sequential(groups):
    """Quotas dealt one by one, as a list."""
    order = ["emerging", "collaborating", "supervising"]
    buckets = {r: [f"{r[0]}{i}" for i in range(groups.get(r, 0))] for r in order}
    n = sum(map(len, buckets.values()))
    quota = {r: n // 3 for r in order}
    for r in sorted(order, key=lambda r: -len(buckets[r]))[: n % 3]:
        quota[r] += 1
    seg = {r: buckets[r][: quota[r]] for r in order}
    spare = [x for r in order for x in buckets[r][quota[r] :]]
    for r in order:
        while len(seg[r]) < quota[r] and spare:
            seg[r].append(spare.pop(0))
    return [x for r in order for x in seg[r]]


@pytest.mark.parametrize("sizes", [(6, 1, 0), (3, 3, 1), (0, 0, 5), (2, 2, 2), (1, 7, 3), (0, 4, 4), (1, 0, 0)])
def test_role_diverse_is_the_sequential_dealing_and_a_permutation(spark, sizes):
    groups = dict(zip(roles.ROLES, sizes, strict=True))
    pool = pool_of(spark, groups)
    got = [r.author_id for r in diversity.role_diverse(pool).orderBy("rank").collect()]
    assert got == sequential(groups) and sorted(got) == sorted(r.author_id for r in pool.collect())


def test_equal_quota_drops_the_remainder_at_most(spark):
    assert [r.author_id for r in diversity.equal_quota(pool_of(spark, {"emerging": 6, "collaborating": 1})).orderBy("rank").collect()] == ["e0", "e1", "e2", "e3", "e4", "c0"]
    assert diversity.equal_quota(pool_of(spark, {"emerging": 3, "collaborating": 3, "supervising": 1})).count() == 6 + 0


def test_pool_defaults_and_repeats(spark):
    c = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2), ("z", 3)], "author_id string, pos int")
    r = spark.createDataFrame([("a", "supervising", 0.1, 0.2, 0.7), ("b", "odd", 0.1, 0.2, 0.7)], "author_id string, dominant_role string, prob_emerging double, prob_collaborating double, prob_supervising double")
    assert rows(diversity.role_pool(c, r)) == [("a", 0, "supervising", 0.7, 1), ("b", 1, "collaborating", 0.333, 1), ("z", 3, "collaborating", 0.333, 2)]
    ranked = spark.createDataFrame([("a", 1), ("q", 2)], "author_id string, rank int")
    assert diversity.role_diversity(ranked, r).first()[0] == 0.0
    assert diversity.role_diversity(ranked.where("rank > 5"), r).first()[0] == 0.0


def test_metrics(spark):
    pred = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("none", "x", 1)], "query string, id string, rank int")
    truth = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "d"), ("none", "y")], "query string, id string")
    j = evaluate.judged(pred, truth)
    get = lambda df: {r["query"]: r["value"] for r in df.collect()}
    assert get(evaluate.precision(j, 10)) == {"q": 2 / 3, "none": 0.0}  # over what was returned
    assert abs(get(evaluate.average_precision(j, 10))["q"] - (1 / 2 + 2 / 3) / 2) < 1e-12
    assert abs(get(evaluate.average_precision(j, 10, "gt", truth))["q"] - (1 / 2 + 2 / 3) / 3) < 1e-12
    assert get(evaluate.reciprocal_rank(j, 10)) == {"q": 0.5, "none": 0.0}
    assert get(evaluate.recall(j, truth)) == {"q": 2 / 3, "none": 0.0}
    best = 1 + 1 / math.log2(3) + 1 / 2
    assert abs(get(evaluate.ndcg(j, truth, 5))["q"] - (1 / math.log2(3) + 1 / 2) / best) < 1e-12
    assert get(evaluate.ndcg(j, truth.where("query = 'q'"), 5))["none"] == 0.0


def test_candidates_without_a_tag_go(spark):
    candidates = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "author_id string, pos int")
    authors = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y"), ("c", "z")], "author_id string, tag string")
    assert rows(diversity.tagged(candidates, authors)) == [("a", 0), ("c", 2)]


def test_summary_is_the_mean_of_its_parts(spark):
    predicted = spark.createDataFrame([(q, i, r) for q in "xyz" for r, i in enumerate([5, 3, 9, 1, 2, 8, 7, 4, 6, 11, 12, 13], 1)], "query string, id int, rank int")
    truth = spark.createDataFrame([("x", 3), ("x", 12), ("x", 8), ("y", 99), ("w", 1)], "query string, id int")
    got = evaluate.summary(predicted, truth).first().asDict()
    judged = evaluate.judged(predicted, truth)
    parts = {"map_10": evaluate.average_precision(judged, 10), "mrr_10": evaluate.reciprocal_rank(judged, 10), "mp_5": evaluate.precision(judged, 5), "mp_10": evaluate.precision(judged, 10), "ndcg_5": evaluate.ndcg(judged, truth, 5), "ndcg_10": evaluate.ndcg(judged, truth, 10)}
    assert got == {n: pytest.approx(p.agg(F.avg("value")).first()[0]) for n, p in parts.items()} and got["mrr_10"] == pytest.approx(0.5 / 3)


def test_ground_truth_tags(spark):
    a = spark.createDataFrame([(1, "Data  Mining", 5.0), (2, "data–mining", 9.0), (3, None, 9.0), (4, "Women’s health", 1.0)], "author_id int, tag string, n_citation double")
    assert [r.author_id for r in evaluate.ground_truth(a, "data mining").collect()] == [1]
    assert [r.author_id for r in evaluate.ground_truth(a, "Data-Mining").collect()] == [2]
    assert [r.author_id for r in evaluate.ground_truth(a, "womens health").collect()] == [4]
    assert [r.author_id for r in evaluate.ground_truth(a, "big data mining", "contained").collect()] == [1]
    listed = spark.createDataFrame([(1, ["x", "Data Mining", "data-mining", "data mining"], 5.0), (2, [], 9.0), (3, None, 9.0), (4, [None, "DATA  mining"], 7.0)], "author_id int, tag array<string>, n_citation double")
    assert [r.author_id for r in evaluate.ground_truth(listed, "data mining").collect()] == [4, 1]


def graph(spark):
    data = [
        ("a1", "rdf:type", "ex:Author", "uri", None), ("a1", "dcterms:title", "Ann", "literal", "xsd:string"), ("a2", "rdf:type", "ex:Author", "uri", None),
        ("p1", "ex:hasAuthor", "a1", "uri", None), ("p1", "ex:hasAuthor", "a2", "uri", None), ("p2", "ex:hasAuthor", "a1", "uri", None), ("p2", "ex:hasAuthor", "a2", "uri", None),
        ("p3", "ex:hasAuthor", "a1", "uri", None), ("p3", "ex:hasAuthor", "a3", "uri", None), ("p1", "dcterms:title", "Paper one", "literal", "xsd:string"),
        ("p1", "ex:publicationYear", "2001", "literal", "xsd:gYear"), ("p2", "ex:publicationYear", "bad", "literal", "xsd:gYear"), ("p3", "ex:publicationYear", "1999", "literal", "xsd:gYear"),
        ("p1", "ex:hasSubTopic", "s1", "uri", None), ("a2", "ex:hasSubTopic", "s2", "uri", None), ("t1", "ex:hasSubTopic", "s1", "uri", None), ("t1", "rdf:type", "ex:Topic", "uri", None),
        ("t2", "ex:hasSubTopic", "s2", "uri", None), ("s1", "dcterms:title", "Sub", "literal", "xsd:string"),
    ]
    return spark.createDataFrame(data, "s string, p string, o string, kind string, dtype string")


def test_graph_patterns(spark):
    g = graph(spark)
    assert kg.pattern(g, p="ex:hasAuthor", o="a3").count() == 1
    assert rows(kg.career_window(g)) == [("a1", 1999, 2001), ("a2", 2001, 2001), ("a3", 1999, 1999)]
    assert rows(kg.main_topics(g)) == [("a1", "t1"), ("a2", "t1")]  # t2 is no topic by type
    pairs = kg.objects(g, "ex:hasAuthor", "author").withColumnRenamed("s", "paper")
    assert rows(kg.coauthors(pairs)) == [("a1", "a2", 2), ("a2", "a1", 2)]
    assert kg.coauthors(pairs, 1).count() == 4
    asked = spark.createDataFrame([(" ANN ",), ("http://x/author/9",), ("nobody",)], "input string")
    assert rows(kg.lookup(g, asked)) == [(" ANN ", "a1"), ("http://x/author/9", "http://x/author/9")]
    assert kg.add(g, g).count() == g.count()


def test_upsert_twice_is_once(spark):
    roled = spark.createDataFrame([(1, 0.5, 0.25, 0.25, "emerging"), (2, 0.1, 0.2, 0.7, "supervising")], "author_id int, prob_emerging double, prob_collaborating double, prob_supervising double, dominant_role string")
    new = kg.role_triples(roled)
    once = kg.upsert(graph(spark), kg.ROLE_PREDICATES, new)
    twice = kg.upsert(once, kg.ROLE_PREDICATES, new)
    assert rows(once) == rows(twice) and once.count() == graph(spark).count() + 8
    star = rows(kg.roles(twice), "s", "prob_emerging", "dominant_role")
    assert star == [("http://example.org/author/1", 0.5, "emerging"), ("http://example.org/author/2", 0.1, "supervising")]
    # an author that lacks one of the four disappears
    assert kg.roles(twice.where("not (s like '%/1' and p = 'ex:probEmerging')")).count() == 1
    assert rows(kg.role_top(kg.together(twice, kg.literals(roled, kg.uri("author", F.col("author_id")), "dcterms:title", F.lit("N"))), "supervising"), "s") == [("http://example.org/author/2",)]


def test_authorship_triples_of_a_list_with_gaps(spark):
    from tessella.functions.literals import authors_of

    text = "[{'id': '7', 'name': \"O'Neil\"}, 5, {'id': None, 'name': 'Ünal & Co'}, {'id': '7'}]"
    papers = spark.createDataFrame([("x", text), ("y", "[broken"), ("z", None), ("e", "[]")], "paper_id string, authors string")
    found = authors_of(papers)
    assert rows(found, "paper_id", "pos", "n_authors", "author_id", "name") == sorted([("x", 1, 4, "7", "O'Neil"), ("x", 3, 4, None, "Ünal & Co"), ("x", 4, 4, "7", None)], key=str)
    g = kg.add(kg.authorship_triples(found))
    assert kg.subjects(g, "rdf:type", "ex:Authorship").count() == 2  # the repeated author has one node
    assert rows(kg.pattern(g, p="ex:hasLastAuthor"), "o") == [("http://example.org/author/7",)]
    assert g.where("s like '%nal_Co'").count() == 5


def test_rag_texts(spark):
    g = graph(spark)
    authors = spark.createDataFrame([("a1",), ("a2",), ("a9",)], "author string")
    got = dict(rows(rag.texts(g, authors)))
    assert got["a1"] == "Author: Ann\nPapers: Paper one; p2; p3\nSubtopics: Sub\nCoauthors: a2 (2)"
    assert got["a2"] == "Papers: Paper one; p2\nSubtopics: Sub, s2\nCoauthors: Ann (2)" and got["a9"] == ""
    ids = spark.createDataFrame([(0, "a2"), (1, "zz"), (2, "a2")], "pos int, id string")
    assert [r.text for r in rag.texts_in_order(g, ids).orderBy("pos").collect()] == [got["a2"], "", got["a2"]]
    roled = spark.createDataFrame([("a1", 0.9981, 0.001, 0.0009, "emerging")], "s string, prob_emerging double, prob_collaborating double, prob_supervising double, dominant_role string")
    texts = spark.createDataFrame([("a1", "T"), ("a2", "U")], "author string, text string")
    assert dict(rows(rag.enrich(texts, roled))) == {"a1": "T\nExpert Role: Emerging Expert (confidence=0.998)\nRole Scores: Emerging=0.998 | Collaborating=0.001 | Supervising=0.001", "a2": "U"}


def test_caps_of_rag_texts(spark):
    data = [(f"p{i:02d}", "ex:hasAuthor", a, "uri", None) for i in range(15) for a in ("me", *[f"c{j:02d}" for j in range(12)])]
    g = spark.createDataFrame(data, "s string, p string, o string, kind string, dtype string")
    text = rag.texts(g, spark.createDataFrame([("me",)], "author string")).first().text
    papers, co = text.split("\n")
    assert papers.count(";") == 9 and co.count("(15)") == 10 and "c09" in co and "c10" not in co


def test_hybrid_falls_back_when_nothing_reaches_the_threshold(spark):
    docs = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "blue sky", [1.0, 0.0]), (3, "x", [0.0, 1.0])], "doc_id long, text string, embedding array<float>")
    got = retrieval.hybrid(docs, [1.0, 0.0], "red fox", k=2)
    assert [r.doc_id for r in got.collect()] == [1, 2] and abs(got.first().score - 1.0) < 1e-6
    flat = docs.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0)))
    assert [(r.doc_id, r.score) for r in retrieval.hybrid(flat, [1.0, 0.0], "zz", k=5).collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert retrieval.cosine_topk(docs, [1.0, 0.0], 1).first().doc_id == 1
    with pytest.raises(ValueError):
        retrieval.rank_documents(docs)


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, "c c c c")], "doc_id long, text string")
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 3))
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, "a b A").collect()}
    assert abs(got[1] - (2 * idf(1) * part(2, 3) + idf(2) * part(1, 3))) < 1e-12 and abs(got[2] - idf(2) * part(1, 2)) < 1e-12 and 3 not in got
    assert retrieval.bm25(docs, " ").count() == 0


def test_union_and_first_places(spark):
    a = spark.createDataFrame([(" T1 ", 5), ("T2", 6)], "title string, doc_id long")
    b = spark.createDataFrame([("T1", 4), ("T3", 7)], "title string, doc_id long")
    assert rows(retrieval.union_by_title(a, b)) == [("T1", 4, "cosine,llm"), ("T2", 6, "cosine"), ("T3", 7, "llm")]
    listed = spark.createDataFrame([("x", 3), ("y", 1), ("x", 0)], "id string, at int")
    assert rows(retrieval.keep_first(listed, "id", "at")) == [("x", 0), ("y", 1)]
