"""Retrieval metrics. predicted(query, id, rank from 1), truth(query, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import normalize


def ground_truth(authors: DataFrame, tag: str, match: str = "equals") -> DataFrame:
    """(author_id, n_citation), most cited first: authors whose normalized tag equals the query's, or with match='contained' lies in it.

    Ties by id. Authors without a tag are left out. A column of tag lists counts an author once if any tag fits.
    """
    listed = authors.schema["tag"].dataType.simpleString().startswith("array")
    authors = authors.withColumn("tag", F.explode("tag")) if listed else authors
    mine, asked = normalize(F.col("tag")), normalize(F.lit(tag))
    fits = mine == asked if match == "equals" else F.instr(asked, mine) > 0
    kept = authors.where(F.col("tag").isNotNull() & fits)
    kept = kept.select("author_id", "n_citation")
    return (kept.distinct() if listed else kept).orderBy(F.desc("n_citation"), "author_id")


def judged(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, rank, rel)"""
    hit = truth.select("query", "id").distinct().withColumn("hit", F.lit(1))
    return predicted.join(hit, ["query", "id"], "left").select("query", "rank", F.coalesce("hit", F.lit(0)).alias("rel"))


def precision(rows: DataFrame, k: int) -> DataFrame:
    """(query, value): hits over what was returned within k."""
    return rows.where(F.col("rank") <= k).groupBy("query").agg(F.avg("rel").alias("value"))


def average_precision(rows: DataFrame, k: int, normalize_by: str = "hits", truth: DataFrame | None = None) -> DataFrame:
    """(query, value): precision at each hit, averaged over the hits found, or with 'gt' over the smaller of k and all relevant."""
    top = rows.where(F.col("rank") <= k)
    hits = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    by = top.withColumn("p", F.when(F.col("rel") == 1, hits / F.col("rank")).otherwise(0.0)).groupBy("query").agg(F.sum("p").alias("p"), F.sum("rel").alias("n"))
    if normalize_by == "gt":
        by = by.join(truth.groupBy("query").agg(F.countDistinct("id").alias("all")), "query", "left").withColumn("n", F.least(F.coalesce("all", F.lit(0)), F.lit(k)))
    return by.select("query", F.when(F.col("n") > 0, F.col("p") / F.greatest("n", F.lit(1))).otherwise(0.0).alias("value"))


def reciprocal_rank(rows: DataFrame, k: int) -> DataFrame:
    """(query, value): one over the rank of the first hit within k, else 0."""
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    return rows.where(F.col("rank") <= k).groupBy("query").agg(F.coalesce(1 / first, F.lit(0.0)).alias("value"))


def ndcg(rows: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query, value): gains 2^rel - 1 over log2(rank + 1), over the best possible; 0 without relevant items."""
    dcg = rows.where(F.col("rank") <= k).groupBy("query").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    by = dcg.join(truth.groupBy("query").agg(F.countDistinct("id").alias("n")), "query", "left")
    return by.select("query", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("value"))


def recall(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(query, value): hits over all relevant, without a cutoff."""
    hits = rows.groupBy("query").agg(F.sum("rel").alias("hits"))
    by = truth.groupBy("query").agg(F.countDistinct("id").alias("n")).join(hits, "query", "left")
    return by.select("query", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("value"))


def summary(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: means over the queries of MAP@10, MRR@10, MP@5, MP@10, NDCG@5 and NDCG@10, from one pass over the judged rows."""
    rows = judged(predicted.where(F.col("rank") <= 10), truth)
    hits = F.sum("rel").over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"hits": hits, "gain": F.col("rel") / F.log2(F.col("rank") + 1)})
    hit, early = F.col("rel") == 1, F.col("rank") <= 5
    by = rows.groupBy("query").agg(
        F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("hits") / F.col("rank"))), F.sum("rel")), F.lit(0.0)).alias("map_10"),
        F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr_10"),
        F.avg(F.when(early, F.col("rel"))).alias("mp_5"), F.avg("rel").alias("mp_10"), F.sum(F.when(early, F.col("gain"))).alias("g5"), F.sum("gain").alias("g10"),
    ).join(truth.groupBy("query").agg(F.countDistinct("id").alias("n")), "query", "left")
    best = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ndcg_at = lambda c, k: F.when(F.col("n") > 0, F.col(c) / best(k)).otherwise(0.0)
    return by.agg(*[F.avg(c).alias(c) for c in ("map_10", "mrr_10", "mp_5", "mp_10")], F.avg(ndcg_at("g5", 5)).alias("ndcg_5"), F.avg(ndcg_at("g10", 10)).alias("ndcg_10"))
