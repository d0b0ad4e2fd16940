from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import scorers
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import kg
from tessella.sources import rdf, tables


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_years_and_numbers(spark):
    assert apply(spark, T.year, "2010", "+2010-05", "abcd", "1949", "2020", None, "x1999y2001") == [2010, 2010, None, None, None, None, 1999]
    assert apply(spark, T.number_or, "2.5", "x", None, "-3") == [2.5, 0.0, 0.0, -3.0]
    assert apply(spark, T.number_0_100, "Score: 85.", "100.0", "about 7.5 of 10", "none", "101", "-5") == [85.0, 100.0, 7.5, None, None, 5.0]


def test_similarities(spark):
    jac = lambda c: T.jaccard(c, F.lit("a b"))
    assert apply(spark, jac, "A  b", "b c", "", None) == [1.0, 1 / 3, 0.0, 0.0]
    assert [r[0] for r in spark.range(1).select(T.jaccard(F.lit(""), F.lit(" "))).collect()] == [0.0]
    lev = lambda c: T.levenshtein_similarity(c, F.lit("abc"))
    assert apply(spark, lev, "abd", "ABC", "", None, "é") == [1 - 1 / 3, 0.0, 0.0, 0.0, 0.0]


def test_normalize_and_slugs(spark):
    assert apply(spark, T.normalize, "  It’s–A  Test!", "ﬁne", None, "A.B") == ["its-a test", "fine", "", "a b"]
    assert apply(spark, T.slug, "O'Neil, J.", "--", "a" * 100)[0] == "O_Neil_J"
    import hashlib

    assert apply(spark, T.slug, "--", "a" * 100) == [hashlib.sha1(b"--").hexdigest()[:8], "a" * 80]


def test_sentences_stopwords_json(spark):
    assert apply(spark, T.sentences, "One. Two? three! Four") == [["One.", "Two? three!", "Four"]]
    assert apply(spark, T.without_stopwords, "The cat  AND Dog", None) == ["cat Dog", ""]
    assert apply(spark, T.is_stopword, " The ", "cat") == [True, False]
    parsed = lambda c: T.json_or_raw(c, "struct<a:int>")[0]["a"]
    raw = lambda c: T.json_or_raw(c, "struct<a:int>")[1]
    answers = ('{"a": 1}', '```json\n{"a": 2}\n```', "```\n{\"a\": 3}\n```", '{"a": ', "plain", None)
    assert apply(spark, parsed, *answers) == [1, 2, 3, None, None, None]
    assert apply(spark, raw, *answers) == [None, None, None, '{"a": ', "plain", None]


def test_vectors(spark):
    df = spark.createDataFrame([("k", [1.0, 0.0]), ("k", [0.0, 2.0]), ("z", [0.0, 0.0])], "k string, v array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("v"), V.literal([1.0, 1.0]))).collect()][2] is None
    assert {r.k: r.centroid for r in V.centroid(df, "k", "v").collect()} == {"k": [0.5, 1.0], "z": [0.0, 0.0]}
    titled = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0]), ([1.0, 2.0], None)], "t array<float>, m array<double>")
    assert [r.x for r in titled.select(V.with_title(F.col("t"), F.col("m")).alias("x")).collect()] == [[2.0, 1.0], [0.5, 1.0]]
    same = V.minmax(spark.range(3).select(F.lit(4.0).alias("x")), {"x": "y"})
    assert {r.y for r in same.collect()} == {0.0}


TURTLE = """@prefix ex: <http://example.org/schema#> .
@prefix dcterms: <http://purl.org/dc/terms/> .
# a comment
<http://x/p1> a ex:Paper ; dcterms:title "A \\"quoted\\"\\nline", "B"@en ;
  ex:year 2001 ; ex:p 0.5 ; ex:ok true ; ex:when "2001"^^<http://www.w3.org/2001/XMLSchema#gYear> .
ex:q ex:knows <http://x/p1> , ex:r ; .
"""


def test_rdf_round_trips(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    g = rdf.read_turtle(spark, str(tmp_path / "g.ttl"))
    got = sorted((r.s, r.p, r.o, r.dtype) for r in g.collect())
    assert ("http://x/p1", "dcterms:title", 'A "quoted"\nline', "xsd:string") in got and ("http://x/p1", "rdf:type", "ex:Paper", None) in got
    assert ("http://x/p1", "ex:when", "2001", "xsd:gYear") in got and ("ex:q", "ex:knows", "ex:r", None) in got and len(got) == 9
    rdf.write_ntriples(g, str(tmp_path / "nt"))
    back = rdf.read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, g.collect()), key=str)
    rdf.write(kg.together(g, g), str(tmp_path / "store"))
    stored = rdf.read(spark, str(tmp_path / "store"))
    assert stored.count() == 9
    scan = stored.where("p = 'rdf:type'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in scan
    with pytest.raises(Exception, match="N-Triples"):
        rdf.parse_ntriples(spark.createDataFrame([("nonsense",)], "value string")).collect()
    with pytest.raises(Exception, match="(?i)path"):
        rdf.read_turtle(spark, str(tmp_path / "missing.ttl")).collect()


def test_tables(spark, tmp_path):
    papers = spark.createDataFrame([("1", 'A "t"\nline', "é", "2001", "[{'id': '1'}]", 3, "[0.5, 1]", "x")], tables.PAPERS)
    tables.write_csv(papers, str(tmp_path / "p"))
    back = tables.read_csv(spark, str(tmp_path / "p"), tables.PAPERS)
    assert back.collect() == papers.collect()
    assert back.select(tables.vector(F.col("embeddings"))).first()[0] == [0.5, 1.0]
    (tmp_path / "l.csv").write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    assert tables.read_csv(spark, str(tmp_path / "l.csv"), "id string, name string", "ISO-8859-1").first().name == "café"
    tables.write_parquet(papers, str(tmp_path / "q"), ["topics"])
    assert tables.read_parquet(spark, str(tmp_path / "q")).count() == 1
    tables.write_json(papers.select("abstract"), str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part-*")) == '{"abstract":"é"}\n'
    (tmp_path / "s.json").write_text('{"a": [1, 2]}')
    assert tables.read_settings(str(tmp_path / "s.json")) == {"a": [1, 2]} and tables.read_json(spark, str(tmp_path / "s.json")).first().a == [1, 2]
    (tmp_path / "ids.txt").write_text(" 1 \n\n2\n")
    assert [r.value for r in tables.read_lines(spark, str(tmp_path / "ids.txt")).collect()] == ["1", "2"]
    tables.write_texts(spark.createDataFrame([("Ann É. O'Neil/x", "text of\na"), ("b%2", "")], "k string, t string"), str(tmp_path / "rag"), "k", "t")
    assert {p.name: p.read_text() for p in (tmp_path / "rag").glob("*.txt")} == {"Ann_É._O'Neil_x.txt": "text of\na\n", "b%2.txt": "\n"}


def test_scorers(spark):
    class Length:  # local, so that it travels to the workers by value
        def score(self, query, texts):
            return [min(1.0, len(t) / 10) for t in texts]

    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None), (4, "a b c d")], "doc_id long, text string")
    assert [r.doc_id for r in scorers.rerank(docs, "a b", 2).collect()] == [1, 2]
    assert [r.doc_id for r in scorers.rerank(docs, "q", scorer=Length).collect()] == [4, 1, 2, 3]
    assert [r.doc_id for r in scorers.relevant(docs, "a b", 0.5).collect()] == [1]
    got = scorers.pairwise(docs, "a b").collect()
    assert [(r.doc_id, r.rank) for r in sorted(got, key=lambda r: r.rank)][0] == (1, 1) and sum(r.wins for r in got) == 6
    with pytest.raises(Exception, match="more than 3"):
        scorers.pairwise(docs, "a b", most=3).collect()
    said = spark.createDataFrame([(1, "85"), (2, "It is 60."), (3, "none")], "k int, answer string")
    assert [(r.k, r.score) for r in scorers.scored_by_answer(said).collect()] == [(1, 85)]
    prompts = spark.createDataFrame([(1, "x\nlast")], "key int, prompt string")
    assert scorers.generated(prompts).first().answer == "last"
    vectors = scorers.embedded(docs, lambda: lambda texts: [[len(t)] for t in texts])
    assert {r.doc_id: r.embedding for r in vectors.collect()}[4] == [7.0]
    asked = spark.createDataFrame([(1, "the query")], "key int, text string")
    assert scorers.expanded(asked).first().expanded == "the query"

    class Terse(scorers.Lexical):
        def answer(self, prompts):
            return [f"{p}\n\n  A clear definition. \n\nMore." for p in prompts]

    class Silent(scorers.Lexical):
        def answer(self, prompts):
            return prompts

    assert [scorers.expanded(asked, model=m).first().expanded for m in (Terse, Silent, scorers.Lexical)] == ["A clear definition.", "the query", "the query"]
    assert apply(spark, T.keywords, "[the cat] of", None) == ["cat", ""]
    assert apply(spark, T.says_yes, " Answer: Yes.", "answer: no", "yes", None) == [True, False, False, False]
    authors = spark.createDataFrame([("a", ["Cats and Dogs"], None), ("b", [], ["birds", "cats"]), ("c", None, [])], "author string, papers array<string>, topics array<string>")
    assert sorted(r.author for r in scorers.validated(authors, "cats").collect()) == ["a", "b"]
    assert [r.author for r in scorers.validated(authors, "birds fish").collect()] == ["b"]


def test_comparator_sorts_of_any_judge(spark):
    class Cycle:  # 1 beats 2, 2 beats 3, 3 beats 1
        def prefers(self, query, pairs):
            return [(int(b) - int(a)) % 3 == 1 for a, b in pairs]

    class Never:
        def prefers(self, query, pairs):
            return [False for _ in pairs]

    docs = spark.createDataFrame([(i, str(i), -i) for i in range(1, 6)], "doc_id long, text string, at int")
    order = lambda judge, **how: [r.doc_id for r in sorted(scorers.ordered(docs, "q", [F.desc("at")], judge=judge, **how).collect(), key=lambda r: r.rank)]
    assert order(Never) == [1, 2, 3, 4, 5]
    assert order(Never, k=2) == [1, 2]
    assert order(Never, method="merge") == [1, 2, 3, 4, 5] and order(Never, method="merge", batch=2) == [5, 3, 4, 1, 2]
    # By hand: 3 beats 1, so it comes first; 4 is like 1 and beats only 2; 5 is like 2 and beats 3.
    assert order(Cycle) == [5, 3, 1, 4, 2] and order(Cycle, k=3) == [3, 1, 2]
    assert order(scorers.Lexical) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="more than 3"):
        order(Never, most=3)
