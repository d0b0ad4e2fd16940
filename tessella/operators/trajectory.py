"""Trajectories of long careers: topic vectors by career slice, continuity, drift and productivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _author():
    return Window.partitionBy("author_id")


def sliced(t: DataFrame, first_years: DataFrame, size: int = 5, step: int | None = None) -> DataFrame:
    """(author_id, slice_id, year_start, year_end, topic_name, frequency): slices counted from the author's first year.

    Slices don't overlap unless `step` is less than `size`. Rows before the first year drop out, as do
    authors with fewer than two slices.
    """
    step = step or size
    rows = t.join(first_years.select("author_id", "first_year"), "author_id")
    age = F.col("year") - F.col("first_year")
    if step == size:
        rows = rows.withColumn("slice_id", F.floor(age / size))
    else:
        rows = rows.withColumn("slice_id", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((age - size) / step) + 1), F.greatest(F.floor(age / step), F.lit(0)))))
    rows = rows.where((F.col("slice_id") >= 0) & (age >= 0))
    cells = rows.groupBy("author_id", "slice_id", "first_year", "topic_name").agg(F.sum("frequency").alias("frequency"))
    many = F.max("slice_id").over(_author()) > F.min("slice_id").over(_author())
    start = F.col("first_year") + F.col("slice_id") * step
    return cells.withColumn("many", many).where("many").select("author_id", "slice_id", start.alias("year_start"), (start + size - 1).alias("year_end"), "topic_name", "frequency")


def weights(cells: DataFrame) -> DataFrame:
    """Adds `weight`: each topic's unrounded share of its slice."""
    return cells.withColumn("weight", F.col("frequency") / F.sum("frequency").over(Window.partitionBy("author_id", "slice_id")))


def metadata(cells: DataFrame) -> DataFrame:
    """(author_id, slice_id, year_start, year_end, pub_count, dominant_topic, n_topics_active); ties go to the first topic by name."""
    first = F.row_number().over(Window.partitionBy("author_id", "slice_id").orderBy(F.desc("frequency"), "topic_name"))
    ranked = cells.withColumn("r", first)
    return ranked.groupBy("author_id", "slice_id", "year_start", "year_end").agg(
        F.sum("frequency").alias("pub_count"), F.max(F.when(F.col("r") == 1, F.col("topic_name"))).alias("dominant_topic"), F.count("*").alias("n_topics_active")
    )


def continuity(cells: DataFrame) -> DataFrame:
    """(author_id, avg_continuity, avg_drift, max_drift): cosine of each populated slice with the next; 0 without a pair."""
    order = F.dense_rank().over(_author().orderBy("slice_id"))
    v = cells.select("author_id", "topic_name", "frequency", order.alias("i"))
    norms = v.groupBy("author_id", "i").agg(F.sqrt(F.sum(F.col("frequency") * F.col("frequency"))).alias("norm"))
    following = v.select("author_id", "topic_name", (F.col("i") - 1).alias("i"), F.col("frequency").alias("f2"))
    dots = v.join(following, ["author_id", "topic_name", "i"]).groupBy("author_id", "i").agg(F.sum(F.col("frequency") * F.col("f2")).alias("dot"))
    paired = norms.join(norms.select("author_id", (F.col("i") - 1).alias("i"), F.col("norm").alias("norm2")), ["author_id", "i"]).join(dots, ["author_id", "i"], "left")
    cos = F.coalesce("dot", F.lit(0)) / (F.col("norm") * F.col("norm2"))
    pairs = paired.select("author_id", cos.alias("c"))
    found = pairs.groupBy("author_id").agg(F.avg("c").alias("avg_continuity"), F.avg(1 - F.col("c")).alias("avg_drift"), F.max(1 - F.col("c")).alias("max_drift"))
    return cells.select("author_id").distinct().join(found, "author_id", "left").na.fill(0.0, ["avg_continuity", "avg_drift", "max_drift"])


def productivity(meta: DataFrame) -> DataFrame:
    """(author_id, productivity_slope, productivity_r2): least squares of a slice's count on its ordinal; constant counts have r2 0."""
    x = meta.select("author_id", F.col("pub_count").alias("y"), (F.row_number().over(_author().orderBy("slice_id")) - 1).alias("x"))
    fit = x.groupBy("author_id").agg(F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    return fit.select("author_id", F.coalesce("slope", F.lit(0.0)).alias("productivity_slope"), F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.coalesce("r2", F.lit(0.0))).alias("productivity_r2"))


def breadth(meta: DataFrame) -> DataFrame:
    """(author_id, n_slices, first_slice_year, last_slice_year, topic_breadth)"""
    return meta.groupBy("author_id").agg(
        F.count("*").alias("n_slices"), F.min("year_start").alias("first_slice_year"), F.max("year_start").alias("last_slice_year"), F.avg("n_topics_active").alias("topic_breadth")
    )


def features(cells: DataFrame, regime_b: DataFrame) -> DataFrame:
    """The feature table of regime B: one row per author with at least two slices, figures rounded to 4 digits."""
    meta = metadata(cells)
    rows = breadth(meta).join(continuity(cells), "author_id").join(productivity(meta), "author_id")
    rounded = {c: F.round(c, 4) for c in ("avg_continuity", "avg_drift", "max_drift", "productivity_slope", "productivity_r2", "topic_breadth")}
    kept = regime_b.select("author_id", "name", "total_pubs", "career_span", "active_years", "recency_ratio", "first_year", "last_year")
    return rows.withColumns(rounded).join(kept, "author_id", "left")


def continuity_bands(features_b: DataFrame) -> DataFrame:
    """One row: authors, means of the signals, and percentages by continuity."""
    from tessella.operators.career import share

    c = F.col("avg_continuity")
    return features_b.agg(
        F.count("*").alias("n_authors"), F.avg(c).alias("mean_continuity"), F.avg("avg_drift").alias("mean_drift"), F.avg("productivity_slope").alias("mean_slope"), F.avg("topic_breadth").alias("mean_breadth"),
        share(c >= 0.8).alias("pct_stable"), share((c >= 0.5) & (c < 0.8)).alias("pct_moderate"), share(c < 0.5).alias("pct_shifting"), share(F.col("productivity_slope") > 0).alias("pct_growing"),
    )
