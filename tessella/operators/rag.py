"""Context texts for authors, assembled from the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import kg
from tessella.sources.store import written

CAP = 10
#: Authors asked for that a join may broadcast at most.
FEW = 10_000


#: Fixed value: the lines on a role in a context text.
ROLE_LINES = "Expert Role: %s (confidence=%.3f)\nRole Scores: Emerging=%.3f | Collaborating=%.3f | Supervising=%.3f"


def role_lines(prefix: str = "") -> Column:
    """Two lines on the role of columns prob_*, dominant_role; null without a role. Probabilities have 3 decimals."""
    role = F.col(f"{prefix}dominant_role")
    label, own = F.initcap(role), F.lit(0.0)
    for r, name in kg.ROLE_LABELS.items():
        label = F.when(role == r, name).otherwise(label)
        own = F.when(role == r, F.col(f"{prefix}prob_{r}")).otherwise(own)
    probs = [F.col(f"{prefix}prob_{r}") for r in kg.ROLE_LABELS]
    return F.format_string(ROLE_LINES, label, own, *probs)


def enrich(texts: DataFrame, roled: DataFrame, key: str = "author", text: str = "text") -> DataFrame:
    """Appends the role lines to each text; a text without a role stays as it is."""
    joined = texts.join(roled.select(F.col("s").alias(key), *[f"prob_{r}" for r in kg.ROLE_LABELS], "dominant_role"), key, "left")
    with_role = F.concat_ws("\n", F.col(text), role_lines())
    return joined.select(*[F.when(F.col("dominant_role").isNotNull(), with_role).otherwise(F.col(text)).alias(c) if c == text else c for c in texts.columns])


def _asked(authors: DataFrame, few: int = FEW) -> DataFrame:
    """authors(author), each once, written and counted: more than `few` meet the graph by sort and merge, whatever their file weighs."""
    wanted = written(authors.select("author").distinct(), "wanted")
    return wanted.hint("merge") if wanted.count() > few else wanted


def _joined(rows: DataFrame, label: Column, order: list[Column], separator: str, name: str, cap: int | None = None) -> DataFrame:
    """(author, name): labels in order, joined; only the first `cap` are gathered."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(*order)))
    if cap is not None:
        ranked = ranked.where(F.col("r") <= cap)
    return ranked.groupBy("author").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", label.alias("x")))), lambda s: s["x"]), separator).alias(name))


def _shared(links: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """links(paper, author), wanted(author) -> (author, x, n): a wanted author's coauthors and how many papers they share.

    A pair of two wanted authors is counted once and mirrored.
    """
    flagged = links.withColumnRenamed("author", "x").join(wanted.select(F.col("author").alias("x"), F.lit(True).alias("both")), "x", "left")
    pairs = links.join(wanted, "author", "left_semi").join(flagged, "paper").where("x <> author and (both is null or author < x)")
    counts = pairs.groupBy("author", "x", "both").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    one, other = F.struct("author", "x", "n"), F.struct(F.col("x").alias("author"), F.col("author").alias("x"), "n")
    return counts.select(F.explode(F.when(F.col("both"), F.array(one, other)).otherwise(F.array(one))).alias("p")).select("p.*")


def texts(g: DataFrame, authors: DataFrame, least: int = 2, with_role: bool = True) -> DataFrame:
    """(author, text) for authors(author): name, up to 10 papers, subtopics, up to 10 coauthors, role.

    Papers come by URI, subtopics by URI, coauthors by shared papers and URI; whatever has no title shows
    its URI. Every facet starts from the wanted authors, so other authors' papers are never gathered.
    An author that the graph doesn't name has the text "".
    """
    wanted = _asked(authors)
    titles = kg.entity_names(g, "x")
    title = F.coalesce("x_title", "x")
    links = kg.objects(g, "ex:hasAuthor", "author").withColumnRenamed("s", "paper").distinct()  # so pairs need no distinct
    own = links.join(wanted, "author", "left_semi")
    papers = _joined(own.withColumnRenamed("paper", "x").join(titles, "x", "left"), title, [F.col("x")], "; ", "papers", CAP)
    subs = kg.subtopics(g).join(wanted, "author", "left_semi").withColumnRenamed("subtopic", "x").join(titles, "x", "left")
    subs = _joined(subs, title, [F.col("x")], ", ", "subtopics")
    shared = _shared(links, wanted, least)
    co = _joined(shared.join(titles, "x", "left"), F.concat(title, F.lit(" ("), F.col("n").cast("string"), F.lit(")")), [F.desc("n"), F.col("x")], ", ", "coauthors", CAP)
    rows = wanted.join(titles.select(F.col("x").alias("author"), F.col("x_title").alias("name")), "author", "left").join(papers, "author", "left").join(subs, "author", "left").join(co, "author", "left")
    line = lambda head, c: F.concat(F.lit(head), F.when(F.col(c) != "", F.col(c)))
    parts = [line("Author: ", "name"), line("Papers: ", "papers"), line("Subtopics: ", "subtopics"), line("Coauthors: ", "coauthors")]
    if with_role:
        roled = kg.roles(g).join(wanted.withColumnRenamed("author", "s"), "s", "left_semi").withColumnRenamed("s", "author")
        rows = rows.join(roled, "author", "left")
        parts.append(F.when(F.col("dominant_role").isNotNull(), role_lines()))
    return rows.select("author", F.concat_ws("\n", *parts).alias("text"))


def texts_in_order(g: DataFrame, ids: DataFrame, least: int = 2, base: str = kg.BASE) -> DataFrame:
    """ids(pos, id) -> (pos, id, text) for each, repeats included; numbers stand for author URIs."""
    named = ids.withColumn("author", F.when(F.col("id").cast("string").rlike("^[0-9]+$"), kg.uri("author", F.col("id"), base)).otherwise(F.col("id").cast("string")))
    return named.join(texts(g, named, least), "author", "left").select("pos", "id", F.coalesce("text", F.lit("")).alias("text"))


def summaries(g: DataFrame, authors: DataFrame, least: int = 1) -> DataFrame:
    """(author, name, orgs, papers, subtopics, main_topics, coauthors, role): one record per author, lists sorted by URI, coauthors by count.

    A hub's lists are as long as its papers and coauthors are many; they are gathered only for the authors asked for.
    """
    wanted = _asked(authors)
    titles = kg.entity_names(g, "uri").withColumnRenamed("uri_title", "title")
    links = kg.objects(g, "ex:hasAuthor", "author").withColumnRenamed("s", "paper").distinct()  # so pairs need no distinct
    own = links.join(wanted, "author", "left_semi")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        named = rows.join(wanted, "author", "left_semi").distinct().join(titles, "uri", "left")
        return named.groupBy("author").agg(F.sort_array(F.collect_list(F.struct("uri", "title"))).alias(name))

    shared = _shared(links, wanted, least).withColumnsRenamed({"x": "uri", "n": "count"})
    co = shared.join(titles, "uri", "left").groupBy("author").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "uri", "title", "count"))).alias("c"))
    co = co.select("author", F.transform("c", lambda x: F.struct(x["uri"].alias("uri"), x["title"].alias("name"), x["count"].alias("count"))).alias("coauthors"))
    probs = [f"prob_{r}" for r in kg.ROLE_LABELS]
    label = F.initcap("dominant_role")
    for r, text in kg.ROLE_LABELS.items():
        label = F.when(F.col("dominant_role") == r, text).otherwise(label)
    role = kg.roles(g).select(F.col("s").alias("author"), F.struct("dominant_role", label.alias("label"), *probs).alias("role"))
    out = wanted.join(titles.select(F.col("uri").alias("author"), F.col("title").alias("name")), "author", "left")
    parts = {
        "orgs": kg.objects(g, "ex:affiliatedWith", "uri").withColumnRenamed("s", "author"), "papers": own.withColumnRenamed("paper", "uri"),
        "subtopics": kg.subtopics(g).withColumnRenamed("subtopic", "uri"), "main_topics": kg.main_topics(g).withColumnRenamed("main_topic", "uri"),
    }
    for name, rows in parts.items():
        out = out.join(listed(rows, name), "author", "left")
    return out.join(co, "author", "left").join(role.join(wanted, "author", "left_semi"), "author", "left")
