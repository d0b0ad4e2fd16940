"""Boilerplate lines: those on too many pages of one host go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted, written

SALTS = 64


def _key(line: Column) -> Column:
    """64 bits of hash of the trimmed line; null for a blank one. An innocent line shares a flagged line's key once in 10^19."""
    line = F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.when(line != "", F.xxhash64(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, least: int = 3) -> DataFrame:
    """(host, lines: keys of the lines that are on at least `least` pages and over `ratio` of the pages of the host).

    A host's pages are its distinct texts, so a page with many copies is no evidence of boilerplate; each
    counts a line once, and itself as one null line. Only hashes are shuffled, and copies and counts are
    combined before they are, so a hot page, host or line is one row per task. A host's list is bounded
    by its mean number of lines a page over `ratio`.
    """
    text = F.col(quoted(text_col)).cast("string")
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _key), lambda k: k.isNotNull()))
    pages = docs.where(text.isNotNull()).select(F.col(quoted(host_col)).cast("string").alias("host"), F.xxhash64(text).alias("page"), keys.alias("lines")).dropDuplicates(["host", "page"])
    counts = pages.select("host", F.explode(F.array_append("lines", F.lit(None).cast("long"))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = counts.where("line is null").select(F.col("host").alias("h"), F.col("n").alias("pages"))
    common = counts.where(F.col("line").isNotNull() & (F.col("n") >= least)).join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, least: int = 3, stats: bool = False, broadcast_bytes: int = 4 << 20
) -> DataFrame:
    """`docs` with boilerplate lines taken out of `text_col`; all other lines, their order and line ends stay.

    A line is compared without the spaces, tabs and returns around it; blank lines are never boilerplate.
    With `stats` the columns n_lines and n_dropped follow, in place of any of those names. A null text stays null (0 lines); a null host is
    a host of its own; a text of nothing but boilerplate becomes empty; repeated rows count as one page and
    all lose the same lines; an empty table gives an empty one; extra columns of any name pass through.

    The hosts' lists are written and measured: up to `broadcast_bytes` they go to the texts, which then
    never move; beyond it they meet in a join on host and salt, so that a hot host is many keys.
    """
    flagged = written(boilerplate(docs, host_col, text_col, ratio, least).select(F.col("host").alias("of_host"), F.col("lines").alias("common")), "boilerplate")
    size = flagged.agg(F.sum(F.size("common") * 8 + F.coalesce(F.octet_length("of_host"), F.lit(0)) + 64)).first()[0] or 0
    # Columns go by number until the end, so that no name of theirs can clash.
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, host = (F.col(f"c{docs.columns.index(c)}").cast("string") for c in (text_col, host_col))
    split = F.split(text, "\n")
    marked = F.transform(split, lambda x: F.struct(x.alias("x"), F.coalesce(F.array_contains("common", _key(x)), F.lit(False)).alias("out")))
    same_host = host.eqNullSafe(F.col("of_host"))
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(flagged), same_host, "left")
    else:
        salted = flagged.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(salted, same_host & (F.col("salt") == F.col("of_salt")), "left")
    joined = joined.withColumn("kept", F.when(F.col("common").isNull(), split).otherwise(F.transform(F.filter(marked, lambda m: ~m["out"]), lambda m: m["x"])))
    counted = {"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_dropped": (F.coalesce(F.size(split), F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).cast("long")} if stats else {}
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in counted]
    return joined.select(*columns, *[x.alias(c) for c, x in counted.items()])


SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, i, line, regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS k
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) x
), t AS (SELECT source, COUNT(DISTINCT text) AS pages FROM documents GROUP BY source),
f AS (
  SELECT l.source, l.k FROM l JOIN t ON t.source IS NOT DISTINCT FROM l.source WHERE l.k <> ''
  GROUP BY l.source, l.k, t.pages HAVING COUNT(DISTINCT l.text) >= 3 AND COUNT(DISTINCT l.text) > 0.05 * t.pages
)
SELECT l.doc_id, COALESCE(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.k IS NULL), '') AS text,
       CAST(COUNT(*) AS BIGINT) AS n_lines, CAST(COUNT(f.k) AS BIGINT) AS n_dropped
FROM l LEFT JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.k = l.k
GROUP BY l.doc_id
"""
