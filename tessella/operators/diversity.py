"""Role-diverse rankings: quotas per role as set operations, without a loop.

A pool is one query's candidates, the authors of a few dozen papers, so one task numbers it as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.roles import ROLES


def role_order(role: Column) -> Column:
    out = F.lit(len(ROLES))
    for i, r in enumerate(ROLES):
        out = F.when(role == r, i).otherwise(out)
    return out


def role_pool(candidates: DataFrame, roled: DataFrame, missing_role: str = "collaborating", missing_prob: float = 0.333) -> DataFrame:
    """candidates(author_id, pos) -> (author_id, pos, role, prob, rn): rank in its role by probability, then by position.

    roled(author_id, dominant_role, prob_*). Each id counts at its first position. An author without a
    known role gets the missing one and its probability.
    """
    first = candidates.groupBy("author_id").agg(F.min("pos").alias("pos"))
    rows = first.join(roled.select("author_id", "dominant_role", *[f"prob_{r}" for r in ROLES]), "author_id", "left")
    known = F.coalesce(F.col("dominant_role").isin(*ROLES), F.lit(False))
    prob = F.lit(float(missing_prob))
    for r in ROLES:
        prob = F.when(F.col("dominant_role") == r, F.col(f"prob_{r}")).otherwise(prob)
    rows = rows.select("author_id", "pos", F.when(known, F.col("dominant_role")).otherwise(missing_role).alias("role"), prob.alias("prob"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("prob"), "pos")))


def tagged(candidates: DataFrame, authors: DataFrame) -> DataFrame:
    """The candidates whose author has a tag, as the citation baseline takes them."""
    return candidates.join(authors.where("tag is not null").select("author_id"), "author_id", "left_semi")


def _sizes(pool: DataFrame) -> DataFrame:
    """(role, ord, size) for all three roles: three rows."""
    spark = pool.sparkSession
    all_roles = spark.createDataFrame([(r, i) for i, r in enumerate(ROLES)], "role string, ord int")
    return all_roles.join(pool.groupBy("role").agg(F.count("*").alias("size")), "role", "left").na.fill(0, ["size"])


def role_diverse(pool: DataFrame) -> DataFrame:
    """(author_id, role, prob, rank): a permutation of the pool with near-equal quotas.

    A third of the pool each, the remainder to the largest roles in order. Roles short of their quota
    take, in role order, what the others have left over, in role order too, into their own segment.
    Segments follow each other in role order.
    """
    sizes = _sizes(pool)
    everyone, by_size, by_ord = Window.partitionBy(), Window.orderBy(F.desc("size"), "ord"), Window.orderBy("ord")
    n = F.sum("size").over(everyone)
    quotas = sizes.withColumn("n", n).withColumn("quota", F.floor(F.col("n") / 3) + (F.row_number().over(by_size) <= F.col("n") % 3).cast("int"))
    quotas = quotas.withColumn("need", F.greatest(F.col("quota") - F.col("size"), F.lit(0))).withColumn("hi", F.sum("need").over(by_ord)).withColumn("lo", F.col("hi") - F.col("need"))
    rows = pool.join(F.broadcast(quotas.select("role", "ord", "quota")), "role")
    kept = rows.where(F.col("rn") <= F.col("quota")).select("author_id", "role", "prob", F.col("ord").alias("segment"), F.lit(0).alias("extra"), F.col("rn").cast("long").alias("at"))
    surplus = rows.where(F.col("rn") > F.col("quota")).withColumn("e", F.row_number().over(Window.orderBy("ord", "rn")) - 1)
    short = F.broadcast(quotas.where("need > 0").select(F.col("ord").alias("segment"), "lo", "hi"))
    moved = surplus.join(short, (F.col("e") >= F.col("lo")) & (F.col("e") < F.col("hi"))).select("author_id", "role", "prob", "segment", F.lit(1).alias("extra"), F.col("e").cast("long").alias("at"))
    return kept.unionByName(moved).select("author_id", "role", "prob", F.row_number().over(Window.orderBy("segment", "extra", "at")).alias("rank"))


def equal_quota(pool: DataFrame) -> DataFrame:
    """(author_id, role, prob, rank): floor(n / 3) of each role; a shortfall goes to the roles in order, each to its own segment.

    Up to n mod 3 candidates drop out.
    """
    sizes = _sizes(pool)
    by_ord = Window.orderBy("ord")
    q = sizes.withColumn("quota", F.floor(F.sum("size").over(Window.partitionBy()) / 3)).withColumn("take", F.least("size", "quota"))
    q = q.withColumn("shortfall", F.sum(F.col("quota") - F.col("take")).over(Window.partitionBy())).withColumn("spare", F.col("size") - F.col("take"))
    q = q.withColumn("before", F.sum("spare").over(by_ord) - F.col("spare"))
    q = q.withColumn("limit", F.col("take") + F.greatest(F.lit(0), F.least(F.col("spare"), F.col("shortfall") - F.col("before"))))
    rows = pool.join(F.broadcast(q.select("role", "ord", "limit")), "role").where(F.col("rn") <= F.col("limit"))
    return rows.select("author_id", "role", "prob", F.row_number().over(Window.orderBy("ord", "rn")).alias("rank"))


def role_diversity(ranked: DataFrame, roled: DataFrame, k: int = 10) -> DataFrame:
    """One row, role_diversity: entropy of the roles among the first k, over ln 3, to 4 digits; 0 when none has a role."""
    top = ranked.where(F.col("rank") <= k).select("author_id").join(roled.select("author_id", "dominant_role"), "author_id")
    counts = top.groupBy("dominant_role").agg(F.count("*").alias("n"))
    total = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return total.agg(F.round(F.coalesce(F.sum(-F.col("p") * F.ln("p")) / F.ln(F.lit(3.0)), F.lit(0.0)), 4).alias("role_diversity"))
