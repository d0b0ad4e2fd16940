"""Careers: spans, recency, slices, regimes, and the distributions reported over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def author_years(papers: DataFrame, links: DataFrame) -> DataFrame:
    """(author_id, year), one row for each paper of an author that has a year."""
    return links.select("paper_id", "author_id").join(papers.where("year is not null").select("paper_id", "year"), "paper_id").select("author_id", "year")


def profile(years: DataFrame) -> DataFrame:
    """(author_id, total_pubs, first_year, last_year, career_span, active_years)"""
    return (
        years.groupBy("author_id")
        .agg(F.count("*").alias("total_pubs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("year").alias("active_years"))
        .withColumn("career_span", F.col("last_year") - F.col("first_year"))
    )


def realistic(years: DataFrame, max_span: int = 50) -> DataFrame:
    """`profile` of the papers no later than max_span years after the author's first."""
    first = years.groupBy("author_id").agg(F.min("year").alias("first"))
    return profile(years.join(first, "author_id").where(F.col("year") <= F.col("first") + max_span).select("author_id", "year"))


def recency_of_papers(years: DataFrame, end_year: int = 2019, window: int = 5) -> DataFrame:
    """(author_id, n_papers, n_recent, recency_ratio); the window's first year, end_year - window, is recent."""
    recent = F.sum((F.col("year") >= end_year - window).cast("long"))
    return years.groupBy("author_id").agg(F.count("*").alias("n_papers"), recent.alias("n_recent")).withColumn("recency_ratio", F.col("n_recent") / F.col("n_papers"))


def recency_of_tensor(t: DataFrame, end_year: int = 2019, window: int = 5) -> DataFrame:
    """(author_id, tensor_total, recent_pubs, recency_ratio) over paper-topic frequencies."""
    recent = F.sum(F.when(F.col("year") >= end_year - window, F.col("frequency")).otherwise(0))
    return t.groupBy("author_id").agg(F.sum("frequency").alias("tensor_total"), recent.alias("recent_pubs")).withColumn("recency_ratio", F.col("recent_pubs") / F.col("tensor_total"))


def calendar_slices(years: DataFrame, size: int = 3) -> DataFrame:
    """(author_id, n_slices, avg_pubs_per_slice): slices of `size` calendar years, from the first year floored to a multiple."""
    first = years.groupBy("author_id").agg((F.floor(F.min("year") / size) * size).alias("start"))
    cut = years.join(first, "author_id").select("author_id", F.floor((F.col("year") - F.col("start")) / size).alias("slice"))
    return cut.groupBy("author_id").agg(F.countDistinct("slice").alias("n_slices"), F.count("*").alias("n")).select("author_id", "n_slices", (F.col("n") / F.col("n_slices")).alias("avg_pubs_per_slice"))


def coverage(tensor_total: Column, total_pubs: Column, partial_below: float = 0.20) -> Column:
    """none without tensor rows, partial below the share, else full; no publications count as one."""
    pubs = F.when(total_pubs == 0, 1).otherwise(total_pubs)
    return F.when(tensor_total == 0, "none").when(tensor_total / pubs < partial_below, "partial").otherwise("full")


def is_b(min_span: int = 6, min_pubs: int = 8, min_active: int | None = 3) -> Column:
    cond = (F.col("career_span") >= min_span) & (F.col("total_pubs") >= min_pubs)
    return cond & (F.col("active_years") >= min_active) if min_active is not None else cond


def regimes(
    authors: DataFrame, profiles: DataFrame, t: DataFrame, end_year: int = 2019, window: int = 5, partial_below: float = 0.20, min_span: int = 6, min_pubs: int = 8, min_active: int = 3
) -> DataFrame:
    """One row per author with a career: its profile, recency, coverage and regime A or B.

    authors(author_id, name, n_citation). An author without tensor rows has ratio and total 0.
    """
    recency = recency_of_tensor(t, end_year, window).select("author_id", "recency_ratio", "tensor_total")
    rows = (
        profiles.join(authors.select("author_id", "name", F.col("n_citation").alias("total_cit")), "author_id")
        .join(recency, "author_id", "left")
        .withColumns({"recency_ratio": F.coalesce("recency_ratio", F.lit(0.0)), "tensor_total": F.coalesce("tensor_total", F.lit(0)).cast("long")})
    )
    return rows.select(
        "author_id", "name", "total_pubs", "total_cit", "first_year", "last_year", "career_span", "active_years", "recency_ratio", "tensor_total",
        coverage(F.col("tensor_total"), F.col("total_pubs"), partial_below).alias("year_coverage"), F.when(is_b(min_span, min_pubs, min_active), "B").otherwise("A").alias("regime"),
    )


def share(cond: Column) -> Column:
    """The percentage of rows for which cond holds."""
    return F.avg(F.when(cond, 100.0).otherwise(0.0))


def cascade(profiles: DataFrame, min_span: int = 6, min_pubs: int = 8, min_active: int = 3) -> DataFrame:
    """(step, n_authors, pct): how many authors pass the first condition, the first two, all three."""
    steps = [F.lit(True), F.col("career_span") >= min_span, F.col("total_pubs") >= min_pubs, F.col("active_years") >= min_active]
    passed = [steps[0]]
    for s in steps[1:]:
        passed.append(passed[-1] & s)
    names = ["all", "span", "span_pubs", "span_pubs_active"]
    counts = profiles.agg(*[F.sum(c.cast("long")).alias(n) for n, c in zip(names, passed, strict=True)])
    stacked = counts.select("all", F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) as (step, n_authors)"))
    return stacked.select("step", "n_authors", (100.0 * F.col("n_authors") / F.col("all")).alias("pct"))


def coverage_by_regime(regime_map: DataFrame) -> DataFrame:
    """(regime, year_coverage, n_authors, pct of the regime)"""
    from pyspark.sql import Window

    counts = regime_map.groupBy("regime", "year_coverage").agg(F.count("*").alias("n_authors"))
    return counts.withColumn("pct", 100.0 * F.col("n_authors") / F.sum("n_authors").over(Window.partitionBy("regime")))


def partial_top(regime_map: DataFrame, k: int = 10) -> DataFrame:
    """The k authors of partial coverage with most publications; ties by id."""
    return regime_map.where("year_coverage = 'partial'").select("author_id", "name", "total_pubs", "tensor_total").orderBy(F.desc("total_pubs"), "author_id").limit(k)


def distribution(profiles: DataFrame, ratios: DataFrame, slices: DataFrame, end_year: int = 2019) -> DataFrame:
    """One row of medians, means and percentage bands of spans, years, recency and publications per slice."""
    rows = profiles.join(ratios.select("author_id", "recency_ratio"), "author_id").join(slices, "author_id")
    s, fy, ly, rr, aps = (F.col(c) for c in ("career_span", "first_year", "last_year", "recency_ratio", "avg_pubs_per_slice"))
    return rows.agg(
        F.median(s).alias("median_span"), F.avg(s).alias("mean_span"), share(s < 5).alias("pct_span_lt5"), share(s.between(5, 10)).alias("pct_span_5_10"),
        share((s > 10) & (s <= 20)).alias("pct_span_11_20"), share(s > 20).alias("pct_span_gt20"),
        F.min(fy).alias("min_first"), F.max(fy).alias("max_first"), F.median(fy).alias("median_first"), share(fy >= 2000).alias("pct_first_2000"), share(fy >= 2010).alias("pct_first_2010"),
        F.min(ly).alias("min_last"), F.max(ly).alias("max_last"), F.median(ly).alias("median_last"), share(ly < end_year - 10).alias("pct_inactive"), share(ly >= end_year - 3).alias("pct_active"),
        F.median(rr).alias("median_recency"), F.avg(rr).alias("mean_recency"), share(rr < 0.1).alias("pct_recency_low"), share(rr.between(0.1, 0.5)).alias("pct_recency_mid"), share(rr > 0.5).alias("pct_recency_high"),
        F.median(aps).alias("median_per_slice"), F.avg(aps).alias("mean_per_slice"), share(aps < 2).alias("pct_slice_lt2"), share(aps.between(2, 5)).alias("pct_slice_2_5"), share(aps > 5).alias("pct_slice_gt5"),
    )


def slice_stability(profiles: DataFrame, slices: DataFrame, size: int = 3, want: float = 50.0) -> DataFrame:
    """Shares of authors in two slices or more (a), of two papers a slice or more (b), and of short careers in one slice (c)."""
    rows = profiles.join(slices, "author_id")
    one = F.avg(F.when(F.col("career_span") <= size, F.when(F.col("n_slices") == 1, 100.0).otherwise(0.0)))
    out = rows.agg(share(F.col("n_slices") >= 2).alias("cond_a"), share(F.col("avg_pubs_per_slice") >= 2).alias("cond_b"), one.alias("cond_c"))
    return out.withColumn("stable", (F.col("cond_a") >= want) & (F.col("cond_b") >= want))


def emerging(profiles: DataFrame, ratios: DataFrame, end_year: int = 2019, recent: int = 5, high: float = 0.7) -> DataFrame:
    """One row: authors that began lately or published mostly lately, against all."""
    rows = profiles.join(ratios.select("author_id", "recency_ratio"), "author_id")
    pick = (F.col("first_year") >= end_year - recent) | (F.col("recency_ratio") > high)
    return rows.agg(
        F.count("*").alias("n_authors"), F.sum(pick.cast("long")).alias("n_emerging"), share(pick).alias("pct_emerging"),
        F.median(F.when(pick, F.col("career_span"))).alias("median_span"), F.median(F.when(pick, F.col("recency_ratio"))).alias("median_recency"),
    )


def regime_profile(regime_map: DataFrame) -> DataFrame:
    """Per regime: authors and medians."""
    cols = ("total_pubs", "total_cit", "career_span", "active_years", "recency_ratio")
    return regime_map.groupBy("regime").agg(F.count("*").alias("n_authors"), *[F.median(c).alias(f"median_{c}") for c in cols])


def histogram(df: DataFrame, column: str, width: float = 1, upper: float | None = None) -> DataFrame:
    """(bin, n): counts by bins of one width; values over `upper` count at `upper`, null values nowhere."""
    x = F.least(F.col(column), F.lit(upper)) if upper is not None else F.col(column)
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(x / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def publication_bands(df: DataFrame, column: str = "total_pubs", low: int = 5, mid: int = 20, high: int = 50) -> DataFrame:
    """One row: how many authors publish less than low, low to mid, high or more."""
    c = F.col(column)
    return df.agg(F.sum((c < low).cast("long")).alias("n_low"), F.sum(c.between(low, mid).cast("long")).alias("n_mid"), F.sum((c >= high).cast("long")).alias("n_high"), F.count("*").alias("n_authors"))
