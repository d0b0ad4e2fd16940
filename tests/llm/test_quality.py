from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import quality

SF = "/root/testdata/sf0.01"


def test_statistics_of_edge_texts():
    assert quality.statistics(b"") == [0.0] * len(quality.FEATURES)
    assert len(quality.statistics(b" \n ")) == len(quality.FEATURES)
    got = dict(zip(quality.FEATURES, quality.statistics(b"AB ab ab!!\nab"), strict=True))
    assert got["distinct_words"] == 3 / 4 and got["top_word"] == 2 / 4 and got["adjacent_repeats"] == 0
    assert got["all_caps_words"] == 0.25 and got["marked_words"] == 0.25 and got["bang"] == 2 / 13


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    m = quality.fit(x, y, trees=12, depth=3)

    def walk(row):
        total = m.prior
        for t in range(len(m.feature)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + int(row[m.feature[t, node]] > m.threshold[t, node])
            total += m.value[t, node - m.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(m.score(x), [walk(r) for r in x])
    assert ((m.score(x) > 0.5) == (y == 1)).mean() > 0.85


def test_fit_without_labels_or_with_one_class():
    x = np.zeros((4, 3))
    assert quality.fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 4
    assert (quality.fit(x, np.ones(4)).score(x) > 0.5).all()


def test_held_out_accuracy_and_contract(spark):
    from tessella.llm.queries import op2_quality

    rows = op2_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    judged = rows.join(labels, "doc_id").toPandas()
    assert (judged.held_out == judged.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (judged.predicted == (judged.score >= 0.3)).all() and judged.score.between(0, 1).all()
    out = judged[judged.held_out]
    assert (out.predicted == out.quality).mean() >= 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 9), (1, "fine words here", 9), (None, None, 9), (2, "", 9), (3, "w " * 100_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.keep_good(docs, labels, threshold=1.1)
    assert none.count() == 0


def test_labels_of_the_held_out_fifth_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert (a.threshold == b.threshold).all() and (a.value == b.value).all()
