from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing
from tessella.llm.queries import op6_mixing

SF = "/root/testdata/sf0.01"


def slow_targets(sizes: dict, cap=3.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, got, free = float(sum(sizes.values())), {}, set(order)
    while free:
        level = (total - sum(got.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            got |= {s: w[s] * level for s in free}
            break
        got |= {s: cap * sizes[s] for s in over}
        free -= over
    return got


def check(rows, docs):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, s, t in docs:
        sizes[s] = sizes.get(s, 0) + n(t)
    want = slow_targets(sizes)
    source_of = {d: s for d, s, _ in docs}
    size_of = {d: n(t) for d, _, t in docs}
    taken: dict = {}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.size == size_of[r.doc_id] and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    return {s: (taken[s], want[s]) for s in taken}


def test_targets_are_met_and_runs_agree(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op6_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    for taken, target in check(rows, docs).values():
        assert abs(taken - target) <= 1.01
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op6_mixing(spark, SF).collect()))


def test_capped_sources_null_source_and_edge_rows(spark):
    docs = [(i, "big", "w " * 50) for i in range(60)] + [(100, "a", "one two"), (101, "b", None), (102, None, "x y z"), (103, None, ""), (104, "é", "q " * 9000), (None, "big", "w w")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, source string, text string, target int")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    check(rows, docs)
    assert next(r for r in rows if r.doc_id == 100).taken <= 6
    assert mixing.mix(df.limit(0)).count() == 0
    kept = mixing.mixed(df)
    assert kept.columns == df.columns
    got = {}
    for r in kept.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {r.doc_id: round(r.taken / r.size + 1e-9) for r in rows if r.size and 2 * r.taken >= r.size}


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"s{rng.random()}": int(10 ** rng.uniform(0, 6)) for _ in range(400)} | {None: 77, "é": 5, "zero": 0, "tie1": 1000, "tie2": 1000, "tie3": 1000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = slow_targets(sizes)
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)
    alone = spark.createDataFrame([("a", 0)], "source string, source_size long")
    assert mixing.targets(alone).first().target == 0 and mixing.targets(alone.limit(0)).count() == 0


def test_heavier_documents_are_likelier(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word " * 3).alias("text"), (F.col("id") % 2).cast("string").alias("source"), (F.when(F.col("id") % 4 < 2, 5.0).otherwise(0.5)).alias("q"))
    rows = mixing.mix(df, weights=(1, 3), weight=F.col("q")).where("target < source_size").groupBy((F.col("doc_id") % 4 < 2).alias("heavy")).agg(F.avg((F.col("taken") > 0).cast("int")).alias("share"))
    share = {r.heavy: r.share for r in rows.collect()}
    assert share[True] > 1.5 * share[False]


@pytest.mark.parametrize("few", [1, 50, 1000])
@pytest.mark.parametrize("weight", ["1", "0.02", "0.001", "1e-6", "1e-6 + doc_id % 7", "case when doc_id % 3 = 0 then 1e-6 else 1 end"])
def test_the_sample_is_that_of_sorted_exponential_keys(spark, monkeypatch, weight, few):
    whole = mixing._plan
    monkeypatch.setattr(mixing, "_plan", lambda *a: whole(*a, few=few))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 5 + 1).cast("int")), " ").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(df, weights=(1, 3), weight=F.expr(weight)).collect()
    key = {r.doc_id: r.key for r in df.select("doc_id", mixing.exponential(F.col("doc_id"), F.expr(weight), 1).alias("key")).collect()}
    for source in (0, 1):
        mine = sorted((r for r in rows if r.doc_id % 2 == source), key=lambda r: key[r.doc_id])
        left = mine[0].target - mine[0].target // mine[0].source_size * mine[0].source_size
        for r in mine:
            take = min(r.size, int(left))
            assert r.taken == take + r.size * (r.target // r.source_size)
            left = left - take if take == r.size else 0


def test_odd_weights_and_names(spark):
    q = [None, float("nan"), 0.0, -1.0, float("inf"), 1.0]
    df = spark.createDataFrame([(i, "w " * 10, "s", q[i % 6], i, f"v{i}", -i) for i in range(60)], "doc_id long, text string, source string, q double, __key long, `a.b` string, c0 long")
    rows = mixing.mix(df, weights=(1,), weight=F.col("q")).collect()
    assert sum(r.taken for r in rows) == 600
    kept = mixing.mixed(df, weight=F.col("q"))
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    more = df.unionByName(df.limit(0).unionByName(spark.createDataFrame([(900 + i, "w " * 10, "t", q[i % 6], i, "x", i) for i in range(600)], df.schema)))
    rows = mixing.mix(more, weights=(1, 1), weight=F.col("q")).where("doc_id >= 900").collect()
    taken = [[r.taken for r in rows if r.doc_id % 6 == k] for k in range(6)]
    assert [sum(taken[k]) for k in (0, 1, 4, 5)] == [1000] * 4 and sum(taken[2]) + sum(taken[3]) == 800  # 4800 in all
