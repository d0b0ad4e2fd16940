"""Authorship positions and soft roles: emerging, collaborating, supervising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles in order, the features that are z-scored, what stands for a feature that an author's regime
#: lacks, and the weights of each role's score, where positions are reliable and where they aren't.
ROLES = ("emerging", "collaborating", "supervising")
FEATURES = ("pct_first", "pct_middle", "pct_last", "recency_ratio", "log_span", "log_pubs", "log_active", "productivity_slope")
NEUTRAL = {0.0: ("pct_first", "pct_middle", "pct_last", "pct_sole", "pos_reliable", "kg_papers", "productivity_slope"), 0.5: ("avg_continuity", "avg_drift")}
RELIABLE = {
    "emerging": {"pct_first": 1, "recency_ratio": 1, "productivity_slope": 0.5, "log_span": -0.5, "log_pubs": -0.5, "pct_last": -0.5},
    "collaborating": {"pct_middle": 1, "log_active": 0.5},
    "supervising": {"pct_last": 1, "log_span": 1, "log_pubs": 0.5, "log_active": 0.5, "recency_ratio": -0.5, "productivity_slope": -0.5},
}
UNRELIABLE = {
    "emerging": {"recency_ratio": 1, "log_span": -0.5, "log_pubs": -0.5},
    "collaborating": {"log_active": 0.5},
    "supervising": {"log_span": 1, "log_pubs": 0.5, "log_active": 0.5, "recency_ratio": -0.5},
}


def positions(authorship: DataFrame, reliable: int = 5) -> DataFrame:
    """Per author: papers and counts of positions, their shares to 4 digits, and how reliable they are.

    A sole author counts as sole, first and last.
    """
    sole, first, last = F.col("n_authors") == 1, F.col("pos") == 1, F.col("pos") == F.col("n_authors")
    count = lambda c: F.sum(c.cast("long"))
    by = authorship.groupBy("author_id").agg(
        F.count("*").alias("kg_papers"), count(first).alias("n_first"), count(~first & ~last).alias("n_middle"), count(last).alias("n_last"), count(sole).alias("n_sole")
    )
    pct = {f"pct_{k}": F.round(F.col(f"n_{k}") / F.col("kg_papers"), 4) for k in ("first", "middle", "last", "sole")}
    return by.withColumns(pct).withColumn("pos_reliable", F.least(F.lit(1.0), F.col("kg_papers") / reliable))


def position_roles(authorship: DataFrame) -> DataFrame:
    """One row: sole authors apart from first, last and middle ones."""
    sole, first, last = F.col("n_authors") == 1, F.col("pos") == 1, F.col("pos") == F.col("n_authors")
    count = lambda c: F.sum(c.cast("long"))
    return authorship.agg(count(sole).alias("n_sole"), count(first & ~sole).alias("n_first"), count(last & ~sole).alias("n_last"), count(~first & ~last).alias("n_middle"))


def inputs(regime_map: DataFrame, pos: DataFrame, features_b: DataFrame, features_a: DataFrame) -> DataFrame:
    """Every author with all its features; what a regime lacks is filled with neutral values."""
    rows = (
        regime_map.join(pos, "author_id", "left")
        .join(features_b.select("author_id", "productivity_slope", "avg_continuity", "avg_drift"), "author_id", "left")
        .join(features_a.select("author_id", "expertise_entropy", "weighted_year", "n_active_topics"), "author_id", "left")
    )
    for value, columns in NEUTRAL.items():
        rows = rows.na.fill(value, [*columns])
    return rows


def logs(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"log_span": F.log1p("career_span"), "log_pubs": F.log1p("total_pubs"), "log_active": F.log1p("active_years")})


def zscores(rows: DataFrame, columns: tuple[str, ...] = FEATURES, digits: int = 12) -> DataFrame:
    """Adds z_<column> for each column: over all rows, with the sample deviation; 0 where nothing varies.

    The means are one row, made by one aggregate and joined back, so no task sees all rows.
    """
    one = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    flat = lambda c: F.coalesce(F.round(f"s_{c}", digits), F.lit(0.0)) == 0
    z = {f"z_{c}": F.when(flat(c), 0.0).otherwise((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(one)).withColumns(z).drop(*[f"{p}_{c}" for c in columns for p in "ms"])


def scores(z: DataFrame) -> DataFrame:
    """Adds score_<role>: the weighted sums of both tables, blended by pos_reliable."""
    total = lambda weights: sum((F.col(f"z_{c}") * w for c, w in weights.items()), F.lit(0.0))
    w = F.col("pos_reliable")
    return z.withColumns({f"score_{r}": w * total(RELIABLE[r]) + (1 - w) * total(UNRELIABLE[r]) for r in ROLES})


def softmax(values: list[Column], temperature: float = 1.0) -> list[Column]:
    scaled = [v / temperature for v in values]
    exps = [F.exp(v - F.greatest(*scaled)) for v in scaled]
    return [e / sum(exps[1:], exps[0]) for e in exps]


def first_max(values: list[Column], names: tuple[str, ...]) -> Column:
    """The name of the largest value; of equal ones the first."""
    top = F.greatest(*values)
    out = F.lit(names[-1])
    for v, n in reversed(list(zip(values[:-1], names[:-1], strict=True))):
        out = F.when(v == top, F.lit(n)).otherwise(out)
    return out


def probabilities(scored: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds prob_<role> to 4 digits, dominant_role (of the unrounded ones, to 9 digits) and role_confidence."""
    p = softmax([F.col(f"score_{r}") for r in ROLES], temperature)
    raw = scored.withColumns({f"__{r}": c for r, c in zip(ROLES, p, strict=True)})
    cols = [F.col(f"__{r}") for r in ROLES]
    out = raw.withColumns({f"prob_{r}": F.bround(f"__{r}", 4) for r in ROLES})
    out = out.withColumn("dominant_role", first_max([F.round(c, 9) for c in cols], ROLES)).withColumn("role_confidence", F.bround(F.greatest(*cols), 4))
    return out.drop(*[f"__{r}" for r in ROLES])


def summary(roled: DataFrame) -> DataFrame:
    """(dominant_role, n_authors, pct, avg_confidence)"""
    one = roled.agg(F.count("*").alias("all"))
    by = roled.groupBy("dominant_role").agg(F.count("*").alias("n_authors"), F.avg("role_confidence").alias("avg_confidence"))
    return by.crossJoin(F.broadcast(one)).select("dominant_role", "n_authors", (100.0 * F.col("n_authors") / F.col("all")).alias("pct"), "avg_confidence")


def by_regime(roled: DataFrame) -> DataFrame:
    return roled.groupBy("regime", "dominant_role").agg(F.count("*").alias("n_authors"))


def spread(roled: DataFrame) -> DataFrame:
    """(role, mean, std, min, max) of each probability over all authors."""
    long = roled.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"prob_{r}").alias("p")) for r in ROLES])).alias("x")).select("x.*")
    return long.groupBy("role").agg(F.avg("p").alias("mean"), F.stddev_samp("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max"))
