"""Triples as a table: patterns, star joins, upserts, summaries.

triples(s, p, o, kind, dtype): subject and predicate are names, the object a name (kind uri) or a literal.
The table is a set; writers keep it so, and `sources.rdf` stores it partitioned by p, so that every
pattern with a bound predicate reads that partition alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import slug
from tessella.operators import spread

BASE = "http://example.org/"
COLUMNS = ("s", "p", "o", "kind", "dtype")
#: The predicates of role scores, and the names of roles in texts.
ROLE_PREDICATES = ("ex:probEmerging", "ex:probCollaborating", "ex:probSupervising", "ex:dominantRole")
ROLE_LABELS = {"emerging": "Emerging Expert", "collaborating": "Collaborating Expert", "supervising": "Supervising Expert"}


def uri(kind: str, ident: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}{kind}/"), ident.cast("string"))


def links(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    return df.where(s.isNotNull() & o.isNotNull()).select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("kind"), F.lit(None).cast("string").alias("dtype"))


def literals(df: DataFrame, s: Column, p: str, o: Column, dtype: str = "xsd:string") -> DataFrame:
    return df.where(s.isNotNull() & o.isNotNull()).select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("kind"), F.lit(dtype).alias("dtype"))


def typed(df: DataFrame, s: Column, cls: str) -> DataFrame:
    return links(df, s, "rdf:type", F.lit(cls))


def together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pattern(g: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples that have the given parts."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            g = g.where(F.col(name) == value)
    return g


def subjects(g: DataFrame, p: str, o: str) -> DataFrame:
    return pattern(g, p=p, o=o).select("s").distinct()


def objects(g: DataFrame, p: str, name: str = "o") -> DataFrame:
    """(s, name) for a predicate."""
    return pattern(g, p=p).select("s", F.col("o").alias(name))


def predicate_objects(g: DataFrame, s: str) -> DataFrame:
    return pattern(g, s=s).select("p", "o")


def predicate_counts(g: DataFrame) -> DataFrame:
    """(p, n, n_subjects) of each predicate. g is read twice, first to count it."""
    each = spread.dealt(g.select("p", "s"), g.count(), "p", "s").groupBy("p", "s").agg(F.count("*").alias("n"))
    return each.groupBy("p").agg(F.sum("n").alias("n"), F.count("s").alias("n_subjects"))


def values(g: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """(s, one column per predicate): its least object, null without one. Subjects with none of them are absent."""
    picked = g.where(F.col("p").isin(*predicates))
    return picked.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in predicates.items()])


def star(g: DataFrame, predicates: dict[str, str], among: DataFrame | None = None) -> DataFrame:
    """`values` of subjects that have every predicate; with `among`(s) only of those subjects."""
    if among is not None:
        g = g.join(among.select("s").distinct(), "s", "left_semi")
    return values(g, predicates).dropna()


def exists(df: DataFrame, s: str, g: DataFrame, p: str, o: str) -> DataFrame:
    """The rows of df whose column s is the subject of (p, o)."""
    return df.join(subjects(g, p, o).withColumnRenamed("s", s), s, "left_semi")


def add(g: DataFrame, *more: DataFrame) -> DataFrame:
    return together(g, *more).dropDuplicates([*COLUMNS])


def upsert(g: DataFrame, predicates: tuple[str, ...], *more: DataFrame) -> DataFrame:
    """Deletes all triples of the predicates, then inserts: running it twice is running it once."""
    return g.where(~F.col("p").isin(*predicates)).unionByName(together(*more).dropDuplicates([*COLUMNS]))


def career_triples(profiles: DataFrame, base: str = BASE) -> DataFrame:
    """profiles(author_id, total_pubs, total_cit, first_year, last_year, active_years) as triples."""
    s = uri("author", F.col("author_id"), base)
    names = {"total_pubs": "ex:totalPubs", "total_cit": "ex:totalCitations", "first_year": "ex:firstPublicationYear", "last_year": "ex:lastPublicationYear", "active_years": "ex:activeYears"}
    return together(*[literals(profiles, s, p, F.col(c), "xsd:integer") for c, p in names.items()])


def authorship_triples(authorship: DataFrame, base: str = BASE) -> DataFrame:
    """authorship(paper_id, author_id, pos, n_authors) as authorship nodes, counts, and first and last authors.

    Where author_id is null a slug of the column `name`, if there is one, takes its place.
    """
    ident = F.col("author_id").cast("string")
    if "name" in authorship.columns:
        ident = F.coalesce(ident, slug(F.col("name")))
    a = authorship.withColumn("__a", ident).where("__a is not null")
    paper, author = uri("paper", F.col("paper_id"), base), uri("author", F.col("__a"), base)
    node = F.concat(F.lit(f"{base}authorship/"), F.col("paper_id").cast("string"), F.lit("_"), F.col("__a"))
    pos, n = F.col("pos"), F.col("n_authors")
    return together(
        typed(a, node, "ex:Authorship"), links(a, node, "ex:paper", paper), links(a, node, "ex:author", author),
        literals(a, node, "ex:authorPosition", pos, "xsd:integer"), literals(a, node, "ex:authorCount", n, "xsd:integer"),
        literals(a.select("paper_id", "n_authors").distinct(), paper, "ex:authorCount", n, "xsd:integer"),
        links(a.where("pos = 1"), paper, "ex:hasFirstAuthor", author), links(a.where("pos = n_authors"), paper, "ex:hasLastAuthor", author),
    )


AUTHORSHIP_PREDICATES = ("ex:paper", "ex:author", "ex:authorPosition", "ex:authorCount", "ex:hasFirstAuthor", "ex:hasLastAuthor")


def role_triples(roled: DataFrame, base: str = BASE) -> DataFrame:
    """roled(author_id, prob_emerging, prob_collaborating, prob_supervising, dominant_role) as triples."""
    s = uri("author", F.col("author_id"), base)
    probs = [literals(roled, s, p, F.format_string("%.4f", F.col(c)), "xsd:decimal") for c, p in zip(("prob_emerging", "prob_collaborating", "prob_supervising"), ROLE_PREDICATES, strict=False)]
    return together(*probs, literals(roled, s, "ex:dominantRole", F.col("dominant_role")))


def roles(g: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(s, prob_emerging, prob_collaborating, prob_supervising, dominant_role) of subjects that have all four."""
    names = ("prob_emerging", "prob_collaborating", "prob_supervising", "dominant_role")
    found = star(g, dict(zip(ROLE_PREDICATES, names, strict=True)), among)
    return found.withColumns({n: F.col(n).cast("double") for n in names[:3]})


def authorship_rows(g: DataFrame) -> DataFrame:
    """(node, paper, author, pos, n_authors) of complete authorship nodes; position and count must be whole numbers."""
    nodes = star(g.join(subjects(g, "rdf:type", "ex:Authorship"), "s", "left_semi"), {"ex:paper": "paper", "ex:author": "author", "ex:authorPosition": "pos", "ex:authorCount": "n_authors"})
    return nodes.select(F.col("s").alias("node"), "paper", "author", F.col("pos").try_cast("int").alias("pos"), F.col("n_authors").try_cast("int").alias("n_authors")).dropna()


def authorship_listing(g: DataFrame, k: int = 15) -> DataFrame:
    """(paper_title, author_name, pos, n_authors) of the first k authorships by title and position."""
    titles = objects(g, "dcterms:title", "title")
    rows = authorship_rows(g).join(titles.select(F.col("s").alias("paper"), F.col("title").alias("paper_title")), "paper").join(titles.select(F.col("s").alias("author"), F.col("title").alias("author_name")), "author")
    return rows.select("paper_title", "author_name", "pos", "n_authors").orderBy("paper_title", "pos", "author_name").limit(k)


def role_top(g: DataFrame, role: str, k: int = 5) -> DataFrame:
    """The k authors of a dominant role with the highest probability of it; ties by name of the subject."""
    prob = f"prob_{role}"
    named = roles(g).where(F.col("dominant_role") == role).join(objects(g, "dcterms:title", "name"), "s")
    return named.select("s", "name", prob).orderBy(F.desc(prob), "s").limit(k)


def role_counts(g: DataFrame) -> DataFrame:
    return objects(g, "ex:dominantRole", "dominant_role").groupBy("dominant_role").agg(F.count("*").alias("n_authors"))


def career_window(g: DataFrame) -> DataFrame:
    """(author, first_year, last_year) over the years of the papers that name the author."""
    years = objects(g, "ex:publicationYear", "year").withColumn("year", F.col("year").try_cast("int"))
    return objects(g, "ex:hasAuthor", "author").join(years, "s").groupBy("author").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def lookup(g: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(input) -> (input, s): a URI stands for itself, else all subjects with that title, whatever its case and outer spaces."""
    is_uri = F.col("input").rlike("^https?://") | F.lower("input").contains("/author/")
    titles = objects(g, "dcterms:title", "title").select("s", F.lower(F.trim("title")).alias("t")).where("t <> ''").distinct()
    named = wanted.where(~is_uri).withColumn("t", F.lower(F.trim("input"))).join(titles, "t").select("input", "s")
    return wanted.where(is_uri).select("input", F.col("input").alias("s")).unionByName(named)


def entity_names(g: DataFrame, kind: str) -> DataFrame:
    """(s, title) with the least title of each subject; named `<kind>` and `<kind>_title`."""
    return objects(g, "dcterms:title", "t").groupBy("s").agg(F.min("t").alias(f"{kind}_title")).withColumnRenamed("s", kind)


def organizations(g: DataFrame) -> DataFrame:
    """(author, org, org_title)"""
    return objects(g, "ex:affiliatedWith", "org").withColumnRenamed("s", "author").join(entity_names(g, "org"), "org", "left")


def _with_own(g: DataFrame, sub: DataFrame) -> DataFrame:
    """(s, author): papers and their authors, and authors that have topics of their own, each as its own paper."""
    own = sub.select("s").distinct().join(subjects(g, "rdf:type", "ex:Author"), "s", "left_semi")
    return objects(g, "ex:hasAuthor", "author").select("s", "author").unionByName(own.select("s", F.col("s").alias("author")))


def subtopics(g: DataFrame) -> DataFrame:
    """(author, subtopic): of the author's papers, or linked to the author itself."""
    sub = objects(g, "ex:hasSubTopic", "subtopic")
    return spread.gathered(_with_own(g, sub), sub, "s", "author", "subtopic").select("author", "subtopic").distinct()


def main_topics(g: DataFrame) -> DataFrame:
    """(author, main_topic): those of type ex:Topic above the subtopics of the author or of its papers.

    Subtopics are rolled up before authors are joined, so a paper brings its few main topics to each author.
    """
    sub = objects(g, "ex:hasSubTopic", "subtopic")
    above = sub.join(subjects(g, "rdf:type", "ex:Topic"), "s", "left_semi").withColumnRenamed("s", "main_topic")
    rolled = sub.join(above, "subtopic").select("s", "main_topic").distinct()
    return spread.gathered(_with_own(g, sub), rolled, "s", "author", "main_topic").select("author", "main_topic").distinct()


def coauthors(papers: DataFrame, least: int = 2) -> DataFrame:
    """papers(paper, author) -> (author, coauthor, n_shared) for pairs that share at least `least` papers.

    Each unordered pair is counted once and mirrored at the end, which halves what is shuffled.
    """
    a = papers.select("paper", "author").distinct()
    b = a.withColumnRenamed("author", "coauthor")
    counts = a.join(b, "paper").where("author < coauthor").groupBy("author", "coauthor").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)
    return counts.select(F.explode(F.array(F.struct("author", "coauthor", "n_shared"), F.struct(F.col("coauthor").alias("author"), F.col("author").alias("coauthor"), "n_shared"))).alias("x")).select("x.*")
