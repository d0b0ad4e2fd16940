from __future__ import annotations

import corpus_pipeline
import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_near_stage import brute

from tessella.llm import mixing, packing, quality
from tessella.llm.common import written
from tessella.llm.queries import RANKS, TOKENIZER

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    out = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = current = written(stage(spark, current, SF), name)
        if name != "packing":
            assert current.columns == docs.columns

    model = quality.train(docs, labels)
    x = np.array([quality.statistics(r.text.encode()) for r in rows.values()])
    good = {i for i, s in zip(rows, model.score(x), strict=True) if s >= 0.3}
    assert {r.doc_id for r in out["quality"].collect()} == good
    bad = {r.doc_id for r in labels.where("quality = 1").collect()} - good
    assert len(bad) <= 0.03 * len(rows)

    from tessella.llm.linededup import SQL

    con = duckdb.connect()
    documents = out["quality"].toPandas()
    con.register("documents", documents)
    want = {d: t for d, t, *_ in con.sql(f"SELECT doc_id, text FROM ({SQL}) q").fetchall()}
    cleaned = {r.doc_id: r.text for r in out["lines"].collect()}
    assert cleaned == want

    kept = {r.doc_id for r in out["simhash"].collect()}
    assert len(kept) < len(cleaned) and sorted(kept, key=str) == brute(sorted(cleaned.items()))

    plan = {r.doc_id: r for r in mixing.mix(out["simhash"]).collect()}
    copies = {}
    for r in out["mixing"].collect():
        assert r.text == cleaned[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: round(r.taken / r.size + 1e-9) for i, r in plan.items() if r.size and 2 * r.taken >= r.size}

    enc = packing.encoder(TOKENIZER, RANKS)
    tokens = sum((len(enc.encode([cleaned[i]])[0]) + 1) * n for i, n in copies.items())
    assert sum(r.length for r in out["packing"].collect()) == tokens


def test_run_gives_the_last_stages_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and got.count() > 0


def test_columns_of_any_name_pass_every_stage_but_the_last(spark):
    names = ["__lines", "__host", "__kept", "__key", "__id", "__0", "a.b", "c0", "n", "key", "kept", "common"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        assert docs.count() and docs.where(" or ".join(f"`{c}` <> '{c}-' || doc_id" for c in names)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_no_documents(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF), name)
        assert empty.count() == 0
