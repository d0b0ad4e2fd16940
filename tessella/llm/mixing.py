"""Mixing sources to target weights by Efraimidis-Spirakis sampling with complete epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import partitions, quoted, written

#: Bits told apart in one pass: of the key, and then of the id, for rows of one key.
DIGITS = (17, 15, 15, 15)
KEY_BITS = sum(DIGITS)
ID_DIGITS = (16, 16, 16, 16)
FEW = 1000  # rows of a source that are put in order as a list


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column, size: Column) -> Column:
    """A weight in (0, 1] that falls as the mean length of a word leaves the usual 6 characters."""
    return 1 / (1 + F.abs(F.log((F.length(text.cast("string")) + 1) / (size + 1) / F.lit(6.0))))


def _running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of `sums`, its sum over all rows before in `order`: as `<name>_before`, and over all as `<name>_all`.

    Rows are dealt to ranges of the order, and only one row of sums for each range meets in one task.
    """
    rows = rows.withColumns(sums)
    dealt = written(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(*[F.sum(c).alias(c) for c in sums])
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_at") for c in sums], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.join(F.broadcast(totals), "part")
    return held.withColumns({f"{c}_before": F.col(f"{c}_at") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).drop("part", *[f"{c}_at" for c in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes(source, source_size) -> with target: shares of the sum of all sizes by repeating weights in code-point order.

    No target passes `cap` times its source's size; the excess is shared anew by weight until none does.
    That fixed point is found at once: with sources in ascending order of cap over weight, the capped ones
    come first, and the level is what is left for the others over their weights. Sources may be as many as
    hosts are: no task sees all of them.
    """
    ranked = _running(sizes, [F.col("source").isNull(), F.col("source")], {"one": F.lit(1).cast("long")})
    rows = ranked.select("source", "source_size", F.col("one_before").alias("rank"))
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("w"))
    rows = _running(rows, [F.col("ratio"), F.col("rank")], {"capped": F.col("top"), "weight": F.col("w"), "size": F.col("source_size")})
    rows = written(rows.withColumn("level", (F.col("size_all") - F.col("capped_before")) / (F.col("weight_all") - F.col("weight_before"))), "levels")
    # The first source that its cap doesn't hold gives the level of all after it.
    first = rows.where(F.col("ratio") >= F.col("level")).agg(F.min(F.struct("ratio", "rank", "level"))["level"].alias("found"))
    return rows.crossJoin(F.broadcast(first)).select("source", "source_size", F.coalesce(F.least("top", F.col("w") * F.col("found")), F.col("top"), F.lit(0.0)).alias("target"))


def _same(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Joins on source, null with null."""
    b = b.withColumnRenamed("source", "__source")
    return a.join(b, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def _plan(slim: DataFrame, weights: tuple[int, ...], cap: float, few: int = FEW) -> DataFrame:
    """slim(id, source, size, key) -> one row per source: its size, target, complete epochs and the cut of its last, partial epoch.

    The partial epoch takes documents in ascending order of key, then of id, while their sizes add up to the
    budget. Its cut is found without sorting a source: sizes are summed by the key's next digit (one row per
    source and digit, combined before the shuffle), the digit in which the running sum passes the budget
    is chosen, and only its documents go on, until no source has more than `few`; after the key's digits
    come the id's, so a list is never longer. `cut` is the document at which the budget ends and what is left
    for it, null where all fit.
    """
    sizes = written(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    state = (
        targets(sizes, weights, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumns({"digit": F.lit(0).cast("long"), "held": F.lit(few + 1).cast("long")})
    )
    state = written(state, "state")
    inside = slim.withColumn("place", F.col("id").bitwiseXOR(F.lit(-(1 << 63))))  # ids in the order of unsigned numbers
    order = [("key", KEY_BITS - sum(DIGITS[: i + 1]), d) for i, d in enumerate(DIGITS)] + [("place", 64 - sum(ID_DIGITS[: i + 1]), d) for i, d in enumerate(ID_DIGITS)]
    for column, shift, bits in order:
        if state.where(F.col("held") > few).isEmpty():
            break
        digit = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << bits) - 1))
        digits = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        lists = digits.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("digit", "size", "rows"))).alias("digits"))
        walk = "struct<left:double,digit:bigint,held:bigint>"
        walked = F.aggregate(
            "digits", F.struct(F.col("left"), F.lit(None).cast("long"), F.lit(0).cast("long")).cast(walk),
            lambda acc, d: F.when(acc["digit"].isNotNull(), acc).when(d["size"] <= acc["left"], F.struct(acc["left"] - d["size"], acc["digit"], acc["held"]).cast(walk)).otherwise(F.struct(acc["left"], d["digit"], d["rows"]).cast(walk)),
        )
        # A source whose every digit fits has no digit to go into, and none of its rows go on.
        state = written(
            _same(state.drop("digit", "held"), lists).withColumn("walked", walked).select("source", "source_size", "target", "epochs", F.coalesce("walked.left", "left").alias("left"), "walked.digit", F.coalesce("walked.held", F.lit(0)).alias("held")),
            "state",
        )
        inside = written(_same(inside, state.where("digit is not null").select("source", F.col("digit").alias("at")), "inner").where(digit == F.col("at")).drop("at"), "inside")
    last = inside.groupBy("source", "key", "id").agg(F.sum("size").alias("size"))
    lists = last.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("key", "id", "size"))).alias("docs"))
    walk = "struct<left:double,cut:struct<key:bigint,id:bigint,size:bigint>>"
    start = F.struct(F.col("left"), F.lit(None).cast("struct<key:bigint,id:bigint,size:bigint>")).cast(walk)
    walked = F.aggregate(
        "docs", start, lambda acc, d: F.when(acc["cut"].isNotNull(), acc).when(d["size"] <= acc["left"], F.struct(acc["left"] - d["size"], acc["cut"]).cast(walk)).otherwise(F.struct(acc["left"], d).cast(walk))
    )
    state = _same(state, lists).withColumn("walked", F.coalesce(walked, start))
    cut = F.struct("walked.left", "walked.cut.key", "walked.cut.id", "walked.cut.size")
    return written(state.select("source", "source_size", "target", "epochs", cut.alias("cut")), "plan")


def _place() -> Column:
    """-1 for a document that comes before the cut of its source's partial epoch, 0 for the one at the cut, else 1."""
    before = (F.col("key") < F.col("cut.key")) | ((F.col("key") == F.col("cut.key")) & (F.col("id") < F.col("cut.id")))
    at = (F.col("key") == F.col("cut.key")) & (F.col("id") == F.col("cut.id"))
    return F.when(F.col("cut.key").isNull() | before, -1).when(at, 0).otherwise(1)


def exponential(identity: Column, weight: Column, seed: int) -> Column:
    """The sampling key -ln(u) / weight, u uniform by the hash of the id: the least keys are sampled."""
    v = (F.shiftrightunsigned(F.xxhash64(identity, F.lit(seed)), 1) + 0.5) / F.lit(float(1 << 63))  # u is 1 - v, so small keys are exact
    return -F.log1p(-F.least(v, F.lit(1 - 2.0**-53))) / weight


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> tuple[DataFrame, list[str]]:
    """(id, source, size, key and the columns of docs by number; their names so). Equal ids and seeds give equal keys in any run.

    The key is the logarithm of the exponential one in steps of 2^-52: the same order, for any weight.
    """
    text = F.col(quoted(text_col)).cast("string")
    own = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    identity = F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(*own, identity.alias("id"), F.col(quoted(source_col)).cast("string").alias("source"), words(text).alias("size"), (F.lit(None) if weight is None else weight).cast("double").alias("weight"))
    if weight is None:
        rows = rows.withColumn("weight", quality_weight(F.col(f"c{docs.columns.index(text_col)}"), F.col("size")))
    usable = F.when(F.isnan("weight") | F.col("weight").isNull(), 1.0).otherwise(F.greatest(F.lit(1e-150), F.least(F.lit(1e150), "weight")))
    key = F.floor((F.ln(exponential(F.col("id"), usable, seed)) + 512) * F.lit(float(1 << (KEY_BITS - 10)))).cast("long")
    return rows.withColumn("key", key).drop("weight"), [f"c{i}" for i in range(len(docs.columns))]


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, weight: Column | None = None, seed: int = 1
) -> DataFrame:
    """One row per document: (`id_col`, size, source_size, target, taken).

    Each source's target is met by complete epochs of all its documents and then by a weighted sample
    without replacement; of the one document at which the budget ends, what is left of it is taken, so
    sources meet their targets to the word and no size is taken over `cap` times. `weight` is a document's
    quality weight: more is likelier; null and NaN count as 1, what lies outside 1e-150 to 1e150, zero and
    negative weights included, as the nearer bound, so a document of weight zero comes after all others.
    Null text has size 0; a null source is one of its own, last in order; rows that repeat an id share its
    fate, and so do all rows with a null id; an empty table gives an empty result; extra columns are not read.
    """
    keyed, names = _keyed(docs, id_col, text_col, source_col, weight, seed)
    slim = written(keyed.select(F.col(names[docs.columns.index(id_col)]).alias("raw_id"), "id", "source", "size", "key"), "slim")
    part = F.when(_place() < 0, F.col("size")).when(_place() == 0, F.floor(F.col("cut.left") * F.col("size") / F.greatest("cut.size", F.lit(1)))).otherwise(0)
    return _same(slim, _plan(slim.drop("raw_id"), weights, cap)).select(
        F.col("raw_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("epochs") + part).cast("long").alias("taken")
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, weight: Column | None = None, seed: int = 1
) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes each: none, once or repeated.

    Documents stay whole: the one at which a source's budget ends is taken if at least half of it fits.
    Texts never move: the plan has one row per source and meets the documents where they are. Documents
    without words have nothing to take and go. Columns of any name pass through.
    """
    keyed, names = _keyed(docs, id_col, text_col, source_col, weight, seed)
    plan = _plan(written(keyed.select("id", "source", "size", "key"), "slim"), weights, cap)
    last = (_place() < 0) | ((_place() == 0) & (2 * F.col("cut.left") >= F.col("cut.size")))
    copies = F.col("epochs") + last.cast("int")
    taken = _same(keyed, plan, "inner").withColumn("n", F.when(F.col("size") > 0, copies).otherwise(0)).where("n > 0")
    return taken.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
