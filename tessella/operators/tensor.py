"""The sparse author x year x topic tensor, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import spread


def tensor(papers: DataFrame, links: DataFrame, topics: DataFrame, names: DataFrame | None = None, first_year: int = 1950, last_year: int = 2019) -> DataFrame:
    """(author_id, year, topic_id, topic_name, frequency, binary): papers of an author in a year on a topic.

    papers(paper_id, year), links(paper_id, author_id), topics(paper_id, topic); repeats count once. A paper
    without a year in range, an author or a topic counts nowhere. names(topic, topic_name) gives labels;
    a topic without one is its own label.
    """
    dated = papers.where(F.col("year").between(first_year, last_year)).select("paper_id", "year").distinct()
    pairs = dated.join(topics.select("paper_id", "topic").distinct(), "paper_id")
    rows = spread.gathered(links.select("paper_id", "author_id").distinct(), pairs, "paper_id", "author_id", "topic")
    counts = rows.groupBy("author_id", "year", F.col("topic").alias("topic_id")).agg(F.count("*").alias("frequency"))
    if names is not None:
        counts = counts.join(names.withColumnRenamed("topic", "topic_id"), "topic_id", "left")
    label = F.coalesce(F.col("topic_name"), F.col("topic_id")) if names is not None else F.col("topic_id")
    return counts.select("author_id", "year", "topic_id", label.alias("topic_name"), "frequency", F.lit(1).alias("binary"))


def normalized(t: DataFrame) -> DataFrame:
    """Adds `normalized`: the frequency's share of its author and year."""
    total = F.sum("frequency").over(Window.partitionBy("author_id", "year"))
    return t.withColumn("normalized", F.col("frequency") / total)


def stats(t: DataFrame) -> DataFrame:
    return t.agg(
        F.count("*").alias("n_rows"), F.countDistinct("author_id").alias("n_authors"), F.countDistinct("topic_id").alias("n_topics"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.max("frequency").alias("max_frequency"),
    )


def top_authors(t: DataFrame, k: int = 3) -> DataFrame:
    """The k authors with most rows; ties by id."""
    by = t.groupBy("author_id").agg(F.count("*").alias("n_rows"), F.countDistinct("topic_id").alias("n_topics"), F.sum("frequency").alias("total"))
    return by.orderBy(F.desc("n_rows"), "author_id").limit(k)
