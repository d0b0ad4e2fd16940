"""The offline feature pipeline and the online expert query, put together from operators over the bundled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import scorers
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import career, diversity, kg, rag, recency, retrieval, roles, tensor, trajectory
from tessella.sources import fixtures as fx
from tessella.sources.store import kept, stamp, written


class Expert(fx.Fixtures):
    """The steps hand each other written tables, so plans stay small.

    Those of the offline pipeline are made once for a session and a state of the input; those of a query
    once for each instance.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, query: str = fx.QUERY_TEXT):
        super().__init__(spark, sf_dir)
        self.query = query
        self._state: tuple | None = None
        self._made: dict[str, DataFrame] = {}

    def offline(self, name: str, df: Callable[[], DataFrame], partition_by: str | None = None) -> DataFrame:
        self._state = self._state or (self.dir, stamp(self.spark, self.dir))
        return kept(self.spark, self._state, name, df, partition_by)

    def once(self, name: str, df: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = written(df(), name)
        return self._made[name]

    def tensor(self, level: int = 2) -> DataFrame:
        return tensor.tensor(self.papers(), self.links(), self.topics(level))

    def years(self) -> DataFrame:
        return career.author_years(self.papers(), self.links())

    def profiles(self) -> DataFrame:
        return career.profile(self.years())

    def ratios(self) -> DataFrame:
        return career.recency_of_papers(self.years(), fx.END_YEAR, fx.WINDOW)

    def second_order(self) -> DataFrame:
        """The second-order tensor, written: several steps read it."""
        return self.offline("tensor", self.tensor)

    def regime_map(self) -> DataFrame:
        return self.offline("regimes", lambda: career.regimes(self.authors(), self.profiles(), self.second_order(), fx.END_YEAR, fx.WINDOW))

    def of_regime(self, regime: str) -> tuple[DataFrame, DataFrame]:
        """(tensor rows of the regime's authors, their rows of the map)"""
        members = self.regime_map().where(F.col("regime") == regime)
        return self.second_order().join(members.select("author_id"), "author_id", "left_semi").hint("merge"), members

    def cells(self) -> DataFrame:
        t, members = self.of_regime("B")
        return self.offline("cells", lambda: trajectory.sliced(t, members, fx.SLICE))

    def features_b(self) -> DataFrame:
        return trajectory.features(self.cells(), self.of_regime("B")[1])

    def features_a(self) -> DataFrame:
        t, members = self.of_regime("A")
        return recency.features(t, members, fx.END_YEAR, fx.WINDOW)

    def vectors_a(self) -> DataFrame:
        return recency.vectors(self.of_regime("A")[0], fx.END_YEAR)

    def role_inputs(self) -> DataFrame:
        return roles.logs(roles.inputs(self.regime_map(), roles.positions(self.authorship()), self.features_b(), self.features_a()))

    def scored(self) -> DataFrame:
        return roles.scores(roles.zscores(self.offline("inputs", self.role_inputs)))

    def roled(self) -> DataFrame:
        return self.offline("roled", lambda: roles.probabilities(self.scored()))

    def graph(self, with_roles: bool = False, share: tuple[str, ...] = ()) -> DataFrame:
        """The whole bibliography as triples. Branches whose predicate a query excludes are pruned from its plan.

        What `share` names is read by several branches or several times, so it is written first.
        """
        shared = lambda name, df: self.offline(name, df) if name in share else df()
        uri = kg.uri
        author, paper = uri("author", F.col("author_id")), uri("paper", F.col("paper_id"))
        a, p, h, links = self.authors(), self.papers(), self.hierarchy(), shared("links", self.links)
        t2, t3 = self.topics(2), shared("topics", lambda: self.topics(3))
        topic, sub, main = uri("topic", F.col("topic")), uri("topic", F.col("subtopic")), uri("topic", F.col("main_topic"))
        profiles = shared("profiles", lambda: self.profiles().join(a.select("author_id", F.floor("n_citation").alias("total_cit")), "author_id"))
        orgs, subs, mains = a.select("org").distinct(), h.select("subtopic").distinct(), h.select("main_topic").distinct()
        g = kg.together(
            kg.typed(a, author, "ex:Author"), kg.literals(a, author, "dcterms:title", F.col("name")), kg.links(a, author, "ex:affiliatedWith", uri("org", F.col("org"))),
            kg.literals(orgs, uri("org", F.col("org")), "dcterms:title", F.col("org")),
            kg.typed(p, paper, "ex:Paper"), kg.literals(p, paper, "dcterms:title", F.concat(F.lit("Day "), F.col("paper_id").cast("string"))), kg.literals(p, paper, "ex:publicationYear", F.col("year"), "xsd:gYear"),
            kg.links(links, paper, "ex:hasAuthor", author), kg.links(t2, paper, "ex:hasSecondOrderTopic", topic), kg.links(t3, paper, "ex:hasThirdOrderTopic", topic), kg.links(t3, paper, "ex:hasSubTopic", topic),
            kg.links(h, main, "ex:hasSubTopic", sub), kg.typed(mains, main, "ex:Topic"), kg.literals(mains, main, "dcterms:title", F.col("main_topic")), kg.literals(subs, sub, "dcterms:title", F.col("subtopic")),
            kg.career_triples(profiles), kg.authorship_triples(shared("authorship", self.authorship)),
        )
        return kg.together(g, kg.role_triples(self.roled())) if with_roles else g

    def store(self) -> DataFrame:
        """The graph with roles as a table partitioned by predicate, for queries of many patterns."""
        return self.offline("graph", lambda: self.graph(True, ("links", "topics", "profiles", "authorship")), "p")

    def retrieved(self) -> DataFrame:
        """(doc_id, score) of the hybrid retrieval for the fixed query."""
        return self.once("retrieved", lambda: retrieval.hybrid(self.docs().select("doc_id", "text", "embedding"), self.query_vector(), self.query))

    def ranked_papers(self) -> DataFrame:
        """(paper_id, rank): the retrieved documents' papers, best first."""
        from pyspark.sql import Window

        found = self.retrieved().join(self.docs().select("doc_id", "paper_id"), "doc_id")
        best = found.groupBy("paper_id").agg(F.max(F.struct(F.col("score"), -F.col("doc_id"))).alias("b"))
        return best.select("paper_id", F.row_number().over(Window.orderBy(F.desc("b"))).alias("rank"))

    def candidates(self) -> DataFrame:
        """(author_id, pos): the authors of a few dozen papers. A paper's authors grow with the tables, so the next join isn't a broadcast."""
        return self.once("candidates", lambda: retrieval.candidates(self.ranked_papers(), self.authorship())).hint("merge")

    def pool(self, missing_role: str = "collaborating", missing_prob: float = 0.333, any_author: bool = False) -> DataFrame:
        """The candidates by role: those with a tag, or with `any_author` all of them."""
        candidates = self.candidates() if any_author else diversity.tagged(self.candidates(), self.authors())
        return diversity.role_pool(candidates, self.roled(), missing_role, missing_prob)

    def explained_pool(self) -> DataFrame:
        """The pool as the explanation takes it."""
        return self.pool("supervising", 0.0, any_author=True)

    def ranking(self) -> DataFrame:
        return self.once("ranking", lambda: diversity.role_diverse(self.pool()))

    def predicted(self) -> DataFrame:
        """(query, id, rank): the whole ranking, judged against each author tag as a query of its own. The tags are few; the ranking may be long."""
        tags = self.authors().where("tag is not null").select(F.col("tag").alias("query")).distinct()
        return self.ranking().select(F.col("author_id").alias("id"), "rank").crossJoin(F.broadcast(tags)).select("query", "id", "rank")

    def truth(self) -> DataFrame:
        return self.authors().where("tag is not null").select(F.col("tag").alias("query"), F.col("author_id").alias("id"))

    def contexts(self, wanted: DataFrame | None = None) -> DataFrame:
        """(author, text) for wanted(author), or for every author."""
        g = self.store()
        return rag.texts(g, kg.subjects(g, "rdf:type", "ex:Author").withColumnRenamed("s", "author") if wanted is None else wanted)

    def first_contexts(self, k: int = 25) -> DataFrame:
        """(author, rank, text) of the first k of the ranking."""
        top = self.ranking().where(F.col("rank") <= k).select(kg.uri("author", F.col("author_id")).alias("author"), "rank")
        return top.join(self.contexts(top), "author")

    def centroids(self) -> DataFrame:
        joined = self.table("documents").select("doc_id", "source").join(self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
        return V.centroid(joined, "source", "embedding")


RELEVANCE_PROMPT = "Say in one JSON object with the fields relevance and evidence why this author is an expert on the topic.\nTopic: %s\nMatched papers: %s\n%s"
ROLE_PROMPT = "Say in one JSON object with the fields role and reason what stage this author's career is at.\nCareer span: %s years, role: %s, recency: %.3f\n%s"


def explained_authors(e: Expert, model: Callable[[], scorers.Answerer] = scorers.Lexical, k: int = 3) -> DataFrame:
    """(author_id, rank, n_matched, relevance, relevance_raw, career, career_raw) for the first k of the ranking.

    Two prompts per author go to the model; an answer that is a JSON object is parsed, any other kept raw.
    """
    top = e.ranking().where(F.col("rank") <= k)
    facts = e.roled().select("author_id", "career_span", "dominant_role", "recency_ratio")
    wanted = top.join(facts, "author_id", "left").join(retrieval.matched_papers(e.ranked_papers(), e.authorship()), "author_id", "left").withColumn("author", kg.uri("author", F.col("author_id")))
    rows = wanted.join(rag.texts(e.store(), wanted.select("author")), "author", "left")
    asked = rows.select(
        "author_id", F.format_string(RELEVANCE_PROMPT, F.lit(e.query), F.col("n_matched").cast("string"), F.col("text")).alias("p1"),
        F.format_string(ROLE_PROMPT, F.col("career_span").cast("string"), F.col("dominant_role"), F.col("recency_ratio"), F.col("text")).alias("p2"),
    )
    out = rows.select("author_id", "rank", "n_matched")
    for prompt, name in (("p1", "relevance"), ("p2", "career")):
        parsed, raw = T.json_or_raw(F.col("answer"), "map<string,string>")
        answers = scorers.generated(asked, model, prompt, "author_id").select("author_id", parsed.alias(name), raw.alias(f"{name}_raw"))
        out = out.join(answers, "author_id")
    return out


METHODS = {
    "baseline": ("citation_count", "Candidates that have a tag, most cited first."),
    "proposed": (
        "equal_quota_role_diverse",
        "Candidates fall into three pools by their dominant role, each in order of that role's probability. A pool gives a third of the number of candidates, "
        "rounded down; what small pools lack is given by the others. Emerging authors come first, then collaborating, then supervising ones.",
    ),
}
TRACE = "rank int, author_id long, name string, career_span int, total_citations double, dominant_role string, prob_emerging double, prob_collaborating double, prob_supervising double"
EXPLANATION = (
    "query string, expanded_query string, pipeline string, ranking_method string, explanation string, n_candidates long, n_ranked long, quota_per_role long, "
    "pool_role_distribution map<string,long>, role_groups_detail map<string,array<struct<author_id:long,role_prob:double>>>, "
    f"retrieved_papers array<struct<rank:int,paper_id:date>>, top_candidates array<struct<{TRACE.replace(' ', ':').replace(',:', ',')}>>"
)


def explanation(e: Expert, pipeline: str = "proposed", k: int = 10, expand: Callable[[str], str] | None = None) -> DataFrame:
    """One row, one JSON object (of the fields EXPLANATION): the query, its papers, and the trace of how the first candidates were ranked.

    pipeline "baseline" ranks by citations, "proposed" by equal quotas of roles; only the latter has a pool
    to show. All of it is one query's candidates, the authors of a few dozen papers.
    """
    one = e.candidates().agg(F.count("*").alias("n_candidates"))
    if pipeline == "baseline":
        ranked = retrieval.rank_by_citations(e.candidates(), e.authors()).select("author_id", "rank")
        pool = one.select(F.lit(None).cast("map<string,long>").alias("pool_role_distribution"), F.lit(None).cast("map<string,array<struct<author_id:long,role_prob:double>>>").alias("role_groups_detail"))
    else:
        ranked = diversity.equal_quota(e.explained_pool()).select("author_id", "rank")
        members = F.sort_array(F.collect_list(F.struct("rn", F.col("author_id").cast("long").alias("author_id"), F.round("prob", 4).alias("role_prob"))))
        groups = e.explained_pool().groupBy("role").agg(F.count("*").alias("n"), F.transform(members, lambda m: m.dropFields("rn")).alias("members"))
        entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", c))))
        pool = groups.agg(entries("n").alias("pool_role_distribution"), entries("members").alias("role_groups_detail"))
    facts = e.roled().select("author_id", "name", "career_span", F.col("total_cit").alias("total_citations"), "dominant_role", *[f"prob_{r}" for r in roles.ROLES])
    top = ranked.where(F.col("rank") <= k).join(facts, "author_id", "left").select("rank", *[c for c in ("author_id", *facts.columns[1:])])
    trace = top.agg(F.sort_array(F.collect_list(F.struct(*top.columns))).alias("top_candidates"))
    n = ranked.agg(F.count("*").alias("n_ranked"))
    papers = e.ranked_papers().agg(F.sort_array(F.collect_list(F.struct("rank", "paper_id"))).alias("retrieved_papers"))
    method, why = METHODS[pipeline]
    whole = one.crossJoin(n).crossJoin(pool).crossJoin(papers).crossJoin(trace)
    quota = F.floor(F.col("n_candidates") / len(roles.ROLES)) if pipeline == "proposed" else F.lit(None).cast("long")
    said = {"query": F.lit(e.query), "expanded_query": F.lit(expand(e.query) if expand else e.query), "pipeline": F.lit(pipeline), "ranking_method": F.lit(method), "explanation": F.lit(why), "quota_per_role": quota}
    fields = [f.split()[0] for f in EXPLANATION.split("array<struct<rank")[0].split(", ")[:8]]
    named = [*(said[f].alias(f) if f in said else F.col(f) for f in fields), "pool_role_distribution", "role_groups_detail", "retrieved_papers", "top_candidates"]
    return whole.select(F.to_json(F.struct(*named)).alias("explanation"))
