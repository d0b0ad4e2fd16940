"""What keeps a step within the memory of one process, whatever the size of its tables."""

from __future__ import annotations

import tracemalloc

from pyspark.sql import functions as F

from tessella.functions import literals
from tessella.operators import evaluate, kg, rag, spread, trajectory
from tessella.plans.expert import Expert
from tessella.sources import rdf, store

SF = "/root/testdata/sf0.001"


class Long(Expert):
    """A ranking of 150 authors, each of the same tag."""

    def ranking(self):
        return self.spark.range(1, 151).selectExpr("id as author_id", "cast(id as int) as rank")

    def authors(self):
        return self.spark.range(1, 301).selectExpr("id as author_id", "'a' as tag")


def test_recall_counts_the_whole_ranking(spark):
    e = Long(spark, SF)
    assert [tuple(r) for r in evaluate.recall(evaluate.judged(e.predicted(), e.truth()), e.truth()).collect()] == [("a", 0.5)]  # 1 / 3 with the first 100


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_kept_table_is_not_broadcast_whatever_its_files_weigh(spark, tmp_path):
    found = store.kept(spark, (str(tmp_path),), "ids", lambda: spark.range(1000).withColumnRenamed("id", "author_id"))
    assert "BroadcastHashJoin" not in plan(found.where("author_id > 5").join(spark.range(10).withColumnRenamed("id", "author_id"), "author_id"))


def test_slices_join_the_map_of_authors_without_a_broadcast(spark):
    e = Expert(spark, SF)
    t, members = e.of_regime("B")
    assert "BroadcastHashJoin" not in plan(t) and "BroadcastHashJoin" not in plan(trajectory.sliced(t, members, 2))


def test_roles_and_contexts_join_all_authors_without_a_broadcast(spark):
    e = Expert(spark, SF)
    joined = e.authors().select("author_id", "name").join(e.roled().select("author_id", "dominant_role"), "author_id", "left")
    assert "SortMergeJoin" in plan(joined) and plan(joined).count("BroadcastHashJoin") == 1  # the nations


ODD = ["[]", "[{'id': 1}, None, 'x', ]", "[{'id': 'a]}, {', 'name': \"O'Neil\"}]", "[{'id': 'O\\'N'}]", "[,]", "[{'id': 1} {'id': 2}]", "[{'id': 'a' 'b'}]", "[1, [2], {'id': {3}}]", "[{'id': '''a'}, {'b'''}]", "({'id': 1},)", "[{'id': 1}] + [2]", "nonsense", "", " [{'id': 2}]", "[{'id': r'\\'}]", "[{'id': 1}, # x\n{'id': 2}]", "[{'id': b'x'}]"]


def test_lists_parsed_some_entries_at_a_time_are_those_parsed_whole():
    for text in [*ODD, "[" + ", ".join(f"{{'id': '{i}', 'name': None}}" for i in range(2500)) + "]"]:
        whole = literals._literal(text)
        want = [(None if not isinstance(d, dict) or d.get("id") is None else str(d["id"]),) for d in whole] if isinstance(whole, list) else None
        assert literals.entries(text, ("id",)) == want, text[:80]


def test_a_long_list_takes_little_more_than_its_text():
    text = "[" + ", ".join(f"{{'id': '{i}', 'name': None}}" for i in range(50_000)) + "]"
    tracemalloc.start()
    try:
        assert len(literals.entries(text, ("id", "name"))) == 50_000
        assert tracemalloc.get_traced_memory()[1] < 25e6  # 272 MB where the list is parsed whole, without its rows
    finally:
        tracemalloc.stop()


def test_a_line_is_matched_once_and_long_literals_do_not_recurse(spark):
    text = "a>b<" + 'x\\"\\n' * 20_000
    found = rdf.parse_ntriples(spark.createDataFrame([(f'<ex:a> <ex:b> "{text}"^^<http://www.w3.org/2001/XMLSchema#string> .',), ("<> <ex:b> <> .",)], "value string"))
    assert [tuple(r) for r in found.collect()] == [("ex:a", "ex:b", "a>b<" + 'x"\n' * 20_000, "literal", "xsd:string"), ("", "ex:b", "", "uri", None)]
    assert plan(found).count(rdf._LINE) == 1


def test_more_rows_are_dealt_to_more_tasks(spark):
    g = spark.range(1000).selectExpr("'s' || id % 10 as s", "'p' || id % 2 as p")
    assert spread.dealt(g, 1000, "p", "s", at_once=20).rdd.getNumPartitions() == 50
    assert sorted(tuple(r) for r in kg.predicate_counts(g).collect()) == [("p0", 500, 5), ("p1", 500, 5)]


def test_topics_reach_authors_without_shuffling_each_pair(spark):
    links = spark.range(300).selectExpr("id % 7 as s", "id % 50 as author")
    topics = spark.range(60).selectExpr("id % 7 as s", "id % 11 as topic")
    found = [spread.gathered(links, topics, "s", "author", "topic", small=n).groupBy("author", "topic").count() for n in (100, 0)]
    assert plan(found[0]).count("hashpartitioning(author") == 1  # the links; each pair of author and topic stays where it is made
    few, many = [sorted(tuple(r) for r in x.collect()) for x in found]
    assert few == many and len(few) > 50


def test_a_query_s_candidates_are_not_broadcast(spark):
    e = Expert(spark, SF)
    assert "BroadcastHashJoin" not in plan(kg.roles(kg.role_triples(e.roled()), e.candidates().select(kg.uri("author", F.col("author_id")).alias("s"))))


def test_many_authors_asked_for_are_not_broadcast(spark):
    links, authors = spark.range(1000).selectExpr("cast(id % 50 as string) as author"), spark.range(60).selectExpr("cast(id % 30 as string) as author")
    found = {n: links.join(rag._asked(authors, n), "author", "left_semi") for n in (30, 29)}
    assert [("BroadcastHashJoin" in plan(x), x.count()) for x in found.values()] == [(True, 600), (False, 600)]


def test_parts_are_not_broadcast_to_lines(spark):
    assert "p_partkey" not in "".join(x for x in plan(Expert(spark, SF).topics(3)).splitlines() if "BroadcastHashJoin" in x)
