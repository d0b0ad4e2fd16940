"""Vector and score functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for null or zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def minmax(df: DataFrame, columns: dict[str, str], eps: float = 1e-8) -> DataFrame:
    """Adds columns[c] = (c - min) / (max - min + eps) over all rows; zeros where the range is less than eps.

    One aggregate gives the one row of bounds that is joined back.
    """
    one = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {}
    for c, name in columns.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        scaled[name] = F.when(hi - lo < eps, 0.0).otherwise((F.col(c) - lo) / (hi - lo + eps))
    return df.crossJoin(F.broadcast(one)).withColumns(scaled).drop(*one.columns)


def centroid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): element-wise means of a key's vectors. Sums combine before the shuffle, one row per key and position."""
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(key, F.transform("v", lambda s: s["x"]).alias("centroid"))


def with_title(title: Column, mean: Column) -> Column:
    """The mean of a title's vector and the mean vector of the sentences below it, which is zero where there are none."""
    return F.transform(title.cast("array<double>"), lambda x, i: (x + F.coalesce(F.get(mean, i).cast("double"), F.lit(0.0))) / 2)
