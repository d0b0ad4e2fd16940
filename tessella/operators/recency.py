"""Recency-weighted expertise of short careers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectors(t: DataFrame, end_year: int = 2019, slow: float = 0.1, fast: float = 0.3) -> DataFrame:
    """(author_id, topic_name, weight_slow, weight_fast, weight_raw), unrounded: shares of exponentially decayed frequencies."""
    age = end_year - F.col("year")
    sums = t.groupBy("author_id", "topic_name").agg(
        F.sum(F.col("frequency") * F.exp(-slow * age)).alias("s"), F.sum(F.col("frequency") * F.exp(-fast * age)).alias("f"), F.sum(F.col("frequency").cast("double")).alias("r")
    )
    author = Window.partitionBy("author_id")
    return sums.select("author_id", "topic_name", *[(F.col(c) / F.sum(c).over(author)).alias(n) for c, n in (("s", "weight_slow"), ("f", "weight_fast"), ("r", "weight_raw"))])


def dominant(v: DataFrame, weight: str = "weight_slow") -> DataFrame:
    """(author_id, topic_name) of the largest weight to 9 digits; ties go to the first topic by name."""
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc(F.round(weight, 9)), "topic_name"))
    return v.withColumn("r", rank).where("r = 1").select("author_id", "topic_name")


def entropy(v: DataFrame, n_topics: DataFrame) -> DataFrame:
    """(author_id, expertise_entropy): of the slow weights, over the log of the whole vocabulary; 0 with one topic.

    n_topics: one row, one column `n_topics`.
    """
    h = v.groupBy("author_id").agg(F.sum(-F.col("weight_slow") * F.ln("weight_slow")).alias("h"), F.count("*").alias("n"))
    return h.crossJoin(F.broadcast(n_topics)).select("author_id", F.when(F.col("n") > 1, F.col("h") / F.ln("n_topics")).otherwise(0.0).alias("expertise_entropy"))


def vocabulary(t: DataFrame) -> DataFrame:
    return t.agg(F.countDistinct("topic_name").alias("n_topics"))


def activity(t: DataFrame, end_year: int = 2019, window: int = 5) -> DataFrame:
    """(author_id, weighted_year, recent_pubs, tensor_total, n_active_topics)"""
    recent = F.sum(F.when(end_year - F.col("year") <= window, F.col("frequency")).otherwise(0))
    return t.groupBy("author_id").agg(
        (F.sum(F.col("year") * F.col("frequency")) / F.sum("frequency")).alias("weighted_year"), recent.alias("recent_pubs"), F.sum("frequency").alias("tensor_total"),
        F.countDistinct("topic_name").alias("n_active_topics"),
    )


def topic_shift(v: DataFrame) -> DataFrame:
    """(author_id, dominant_topic, raw_topic, topic_shift): 1 where decay changes the dominant topic."""
    raw = dominant(v, "weight_raw").withColumnRenamed("topic_name", "raw_topic")
    both = dominant(v).withColumnRenamed("topic_name", "dominant_topic").join(raw, "author_id")
    return both.withColumn("topic_shift", (F.col("dominant_topic") != F.col("raw_topic")).cast("int"))


def features(t: DataFrame, regime_a: DataFrame, end_year: int = 2019, window: int = 5, slow: float = 0.1, fast: float = 0.3) -> DataFrame:
    """The feature table of regime A; t holds only its authors. Entropy has 4 digits, the weighted year 2."""
    v = vectors(t, end_year, slow, fast)
    rows = topic_shift(v).drop("raw_topic").join(entropy(v, vocabulary(t)), "author_id").join(activity(t, end_year, window), "author_id")
    kept = regime_a.select("author_id", "name", "total_pubs", "career_span", "active_years", "recency_ratio", "first_year", "last_year", "year_coverage")
    return rows.withColumns({"expertise_entropy": F.round("expertise_entropy", 4), "weighted_year": F.round("weighted_year", 2)}).join(kept, "author_id", "left")


def entropy_bands(features_a: DataFrame) -> DataFrame:
    """One row: authors, mean entropy, percentages of specialists, the focused and generalists, and of shifts."""
    from tessella.operators.career import share

    e = F.col("expertise_entropy")
    return features_a.agg(
        F.count("*").alias("n_authors"), F.avg(e).alias("mean_entropy"), share(e < 0.3).alias("pct_specialist"), share((e >= 0.3) & (e < 0.6)).alias("pct_focused"), share(e >= 0.6).alias("pct_generalist"),
        share(F.col("topic_shift") == 1).alias("pct_shift"),
    )


def top_topics(features_a: DataFrame, k: int = 5) -> DataFrame:
    """(dominant_topic, n_authors) of the k most frequent; ties by name."""
    return features_a.groupBy("dominant_topic").agg(F.count("*").alias("n_authors")).orderBy(F.desc("n_authors"), "dominant_topic").limit(k)
