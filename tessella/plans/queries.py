"""Every registered query beside its SQL. Doubles have 6 digits on both sides, as engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import literals, scorers
from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.operators import career, diversity, evaluate, kg, rag, recency, retrieval, roles, tensor, trajectory
from tessella.plans import oracle as o
from tessella.plans.expert import EXPLANATION, METHODS, Expert, explained_authors, explanation
from tessella.sources import fixtures as fx
from tessella.sources import rdf

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MISSING = {"role": "collaborating", "prob": "0.333", "who": "tcands"}
ANYONE = {"role": "supervising", "prob": "0.0", "who": "cands"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(sql: str | None = None, **fills: str):
    def register(f: Callable[[Expert], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(Expert(spark, sf_dir)))
        if sql is not None:
            _SQL[f.__name__] = o.compose(sql, **(MISSING | fills))
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# Tensor

_TENSOR = "SELECT author_id, year, topic_id, topic_name, frequency, 1 AS \"binary\" FROM {}"


@query(_TENSOR.format("t2"))
def tensor_second_order(e):
    return e.tensor(2)


@query(_TENSOR.format("t3"))
def tensor_third_order(e):
    return e.tensor(3)


@query(
    """SELECT author_id, year, topic_id, topic_name, frequency, 1 AS \"binary\",
    round(CAST(frequency AS DOUBLE) / SUM(frequency) OVER (PARTITION BY author_id, year), 6) AS normalized FROM t2"""
)
def tensor_normalized(e):
    return tensor.normalized(e.tensor(2))


@query(
    """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT author_id) AS n_authors, COUNT(DISTINCT topic_id) AS n_topics, MIN(year) AS min_year, MAX(year) AS max_year,
    MAX(frequency) AS max_frequency FROM t2"""
)
def tensor_stats(e):
    return tensor.stats(e.tensor(2))


@query(
    """SELECT author_id, COUNT(*) AS n_rows, COUNT(DISTINCT topic_id) AS n_topics, CAST(SUM(frequency) AS BIGINT) AS total FROM t2 GROUP BY 1
    ORDER BY n_rows DESC, author_id LIMIT 3"""
)
def tensor_top_authors(e):
    return tensor.top_authors(e.tensor(2))


@query(
    """SELECT t.topic_id, COALESCE(m.topic_name, t.topic_id) AS topic_name, COUNT(*) AS n FROM t3 t LEFT JOIN (SELECT p_brand AS topic_id,
    MIN(p_type) AS topic_name FROM part WHERE p_brand < 'Brand#30' GROUP BY 1) m USING (topic_id) GROUP BY 1, 2"""
)
def topic_name_fallback(e):
    names = e.hierarchy().where("subtopic < 'Brand#30'").groupBy(F.col("subtopic").alias("topic")).agg(F.min("main_topic").alias("topic_name"))
    return tensor.tensor(e.papers(), e.links(), e.topics(3), names).groupBy("topic_id", "topic_name").agg(F.count("*").alias("n"))


# Careers

@query("SELECT author_id, total_pubs, first_year, last_year, active_years, career_span FROM prof")
def career_profile(e):
    return e.profiles()


@query(
    """SELECT author_id, COUNT(*) AS total_pubs, MIN(year) AS first_year, MAX(year) AS last_year, COUNT(DISTINCT year) AS active_years,
    MAX(year) - MIN(year) AS career_span FROM ay JOIN (SELECT author_id, MIN(year) AS f FROM ay GROUP BY 1) m USING (author_id) WHERE year <= f + 3
    GROUP BY author_id"""
)
def career_realism(e):
    return career.realistic(e.years(), max_span=3)


@query(f"SELECT author_id, n_papers, n_recent, {r6('recency_ratio')} FROM ratio")
def recency_ratio_papers(e):
    return e.ratios()


@query(f"SELECT author_id, tensor_total, recent_pubs, {r6('recency_ratio')} FROM rec_t")
def recency_ratio_tensor(e):
    return career.recency_of_tensor(e.tensor(), fx.END_YEAR, fx.WINDOW)


@query(f"SELECT author_id, n_slices, {r6('avg_pubs_per_slice')} FROM cal")
def slices_calendar(e):
    return career.calendar_slices(e.years())


@query("SELECT author_id, slice_id, year_start, year_end, CAST(SUM(frequency) AS BIGINT) AS pub_count FROM cells GROUP BY ALL")
def slices_career(e):
    return e.cells().groupBy("author_id", "slice_id", "year_start", "year_end").agg(F.sum("frequency").alias("pub_count"))


@query(
    f"""SELECT author_id, name, total_pubs, total_cit, first_year, last_year, career_span, active_years, {r6('recency_ratio')}, tensor_total, year_coverage,
    regime FROM rmap"""
)
def regime_partition(e):
    return e.regime_map()


@query(f"SELECT author_id, {r6('recency_ratio')}, tensor_total, total_pubs FROM rmap")
def left_join_features(e):
    return e.regime_map().select("author_id", "recency_ratio", "tensor_total", "total_pubs")


@query("SELECT author_id, CASE WHEN career_span >= 6 AND total_pubs >= 8 THEN 'B' ELSE 'A' END AS regime FROM prof")
def regime_two_condition(e):
    return e.profiles().select("author_id", F.when(career.is_b(min_active=None), "B").otherwise("A").alias("regime"))


@query("""SELECT step, n_authors, round(100.0 * n_authors / (SELECT COUNT(*) FROM prof), 6) AS pct FROM (
    SELECT 'all' AS step, COUNT(*) AS n_authors FROM prof UNION ALL SELECT 'span', COUNT(*) FROM prof WHERE career_span >= 6
    UNION ALL SELECT 'span_pubs', COUNT(*) FROM prof WHERE career_span >= 6 AND total_pubs >= 8
    UNION ALL SELECT 'span_pubs_active', COUNT(*) FROM prof WHERE career_span >= 6 AND total_pubs >= 8 AND active_years >= 3) x""")
def filter_cascade(e):
    return career.cascade(e.profiles())


@query(
    """SELECT regime, year_coverage, COUNT(*) AS n_authors, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY regime), 6) AS pct FROM rmap
    GROUP BY 1, 2"""
)
def year_coverage(e):
    return career.coverage_by_regime(e.regime_map())


_HALF = "CASE WHEN tensor_total = 0 THEN 'none' WHEN CAST(tensor_total AS DOUBLE) / total_pubs < 3 THEN 'partial' ELSE 'full' END"


@query(
    f"""SELECT author_id, name, total_pubs, tensor_total FROM (SELECT *, {_HALF} AS cov FROM rmap) x WHERE cov = 'partial' ORDER BY total_pubs DESC,
    author_id LIMIT 10"""
)
def partial_coverage_topn(e):
    return career.partial_top(career.regimes(e.authors(), e.profiles(), e.tensor(), fx.END_YEAR, fx.WINDOW, partial_below=3))


_S, _R, _A = "career_span", "recency_ratio", "avg_pubs_per_slice"


@query(f"""SELECT median({_S}) AS median_span, round(avg({_S}), 6) AS mean_span, {o.pct(f'{_S} < 5')} AS pct_span_lt5,
    {o.pct(f'{_S} BETWEEN 5 AND 10')} AS pct_span_5_10, {o.pct(f'{_S} > 10 AND {_S} <= 20')} AS pct_span_11_20,
    {o.pct(f'{_S} > 20')} AS pct_span_gt20, MIN(first_year) AS min_first, MAX(first_year) AS max_first, median(first_year) AS median_first,
    {o.pct('first_year >= 2000')} AS pct_first_2000, {o.pct('first_year >= 2010')} AS pct_first_2010,
    MIN(last_year) AS min_last, MAX(last_year) AS max_last, median(last_year) AS median_last, {o.pct('last_year < 1991')} AS pct_inactive,
    {o.pct('last_year >= 1998')} AS pct_active,
    round(median({_R}), 6) AS median_recency, round(avg({_R}), 6) AS mean_recency, {o.pct(f'{_R} < 0.1')} AS pct_recency_low,
    {o.pct(f'{_R} BETWEEN 0.1 AND 0.5')} AS pct_recency_mid, {o.pct(f'{_R} > 0.5')} AS pct_recency_high,
    round(median({_A}), 6) AS median_per_slice, round(avg({_A}), 6) AS mean_per_slice, {o.pct(f'{_A} < 2')} AS pct_slice_lt2,
    {o.pct(f'{_A} BETWEEN 2 AND 5')} AS pct_slice_2_5, {o.pct(f'{_A} > 5')} AS pct_slice_gt5
    FROM prof JOIN ratio USING (author_id) JOIN cal USING (author_id)""")
def career_distribution(e):
    return career.distribution(e.profiles(), e.ratios(), career.calendar_slices(e.years()), fx.END_YEAR)


@query(f"""SELECT *, cond_a >= 50 AND cond_b >= 50 AS stable FROM (SELECT {o.pct('n_slices >= 2')} AS cond_a, {o.pct(f'{_A} >= 2')} AS cond_b,
    round(avg(CASE WHEN career_span <= 3 THEN CASE WHEN n_slices = 1 THEN 100.0 ELSE 0.0 END END), 6) AS cond_c FROM prof JOIN cal USING (author_id)) x""")
def slice_stability(e):
    return career.slice_stability(e.profiles(), career.calendar_slices(e.years()))


_EM = "(first_year >= 1999 OR recency_ratio > 0.7)"


@query(f"""SELECT COUNT(*) AS n_authors, {o.n(_EM)} AS n_emerging, {o.pct(_EM)} AS pct_emerging,
    median(CASE WHEN {_EM} THEN career_span END) AS median_span, round(median(CASE WHEN {_EM} THEN recency_ratio END), 6) AS median_recency
    FROM prof JOIN ratio USING (author_id)""")
def emerging_candidates(e):
    return career.emerging(e.profiles(), e.ratios(), fx.END_YEAR, fx.WINDOW)


@query("SELECT regime, COUNT(*) AS n_authors, " + ", ".join(f"round(median({c}), 6) AS median_{c}" for c in ("total_pubs", "total_cit", "career_span", "active_years", "recency_ratio")) + " FROM rmap GROUP BY 1")
def regime_profile(e):
    return career.regime_profile(e.regime_map())


@query("SELECT CAST(floor(least(career_span, 5) / 2.0) * 2 AS BIGINT) AS bin, COUNT(*) AS n FROM prof GROUP BY 1")
def histogram_span(e):
    return career.histogram(e.profiles(), "career_span", 2, 5)


@query("SELECT CAST(year AS BIGINT) AS bin, COUNT(*) AS n FROM fx_paper GROUP BY 1")
def papers_per_year(e):
    return career.histogram(e.papers(), "year")


@query(f"SELECT {o.n('total_pubs < 5')} AS n_low, {o.n('total_pubs BETWEEN 5 AND 20')} AS n_mid, {o.n('total_pubs >= 50')} AS n_high, COUNT(*) AS n_authors FROM prof")
def pub_bands(e):
    return career.publication_bands(e.profiles())


@query("SELECT author_id, COUNT(*) AS n_rows FROM ta GROUP BY 1")
def semi_join_regime(e):
    return e.of_regime("A")[0].groupBy("author_id").agg(F.count("*").alias("n_rows"))


@query("SELECT a.author_id, a.name FROM fx_author a WHERE a.author_id NOT IN (SELECT author_id FROM rmap WHERE regime = 'B')")
def anti_join_regime(e):
    return e.authors().join(e.regime_map().where("regime = 'B'").select("author_id"), "author_id", "left_anti").select("author_id", "name")


@query(
    """SELECT author_id, a, b FROM (SELECT author_id, 1 AS a FROM rmap WHERE regime = 'B') x FULL JOIN (SELECT DISTINCT author_id, 1 AS b FROM fx_authorship
    WHERE n_authors >= 8) y USING (author_id)"""
)
def id_overlap(e):
    """Ids of two sources: which are in both, which in one."""
    a = e.regime_map().where("regime = 'B'").select("author_id", F.lit(1).alias("a"))
    b = e.authorship().where("n_authors >= 8").select("author_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "author_id", "full")


# Trajectories

@query(
    """SELECT author_id, slice_id, year_start, year_end, topic_name, round(CAST(frequency AS DOUBLE) / SUM(frequency) OVER (PARTITION BY author_id,
    slice_id), 6) AS weight FROM cells"""
)
def slice_vectors(e):
    return trajectory.weights(e.cells()).drop("frequency")


@query("SELECT author_id, slice_id, year_start, year_end, pub_count, dominant_topic, n_topics_active FROM meta")
def slice_metadata(e):
    return trajectory.metadata(e.cells())


@query(f"SELECT author_id, {r6('avg_continuity', 'avg_drift', 'max_drift')} FROM cont")
def slice_continuity(e):
    return trajectory.continuity(e.cells())


@query(f"SELECT author_id, {r6('productivity_slope', 'productivity_r2')} FROM prod")
def productivity_slope(e):
    return trajectory.productivity(trajectory.metadata(e.cells()))


@query(f"SELECT author_id, n_slices, first_slice_year, last_slice_year, {r6('topic_breadth')} FROM breadth")
def topic_breadth(e):
    return trajectory.breadth(trajectory.metadata(e.cells()))


@query(f"SELECT * EXCLUDE (recency_ratio), {r6('recency_ratio')} FROM feat_b")
def regime_b_features(e):
    return e.features_b()


@query(f"""SELECT COUNT(*) AS n_authors, round(avg(avg_continuity), 6) AS mean_continuity, round(avg(avg_drift), 6) AS mean_drift,
    round(avg(productivity_slope), 6) AS mean_slope, round(avg(topic_breadth), 6) AS mean_breadth,
    {o.pct('avg_continuity >= 0.8')} AS pct_stable, {o.pct('avg_continuity >= 0.5 AND avg_continuity < 0.8')} AS pct_moderate,
    {o.pct('avg_continuity < 0.5')} AS pct_shifting, {o.pct('productivity_slope > 0')} AS pct_growing FROM feat_b""")
def continuity_bands(e):
    return trajectory.continuity_bands(e.features_b())


# Recency

@query(f"SELECT author_id, topic_name, {r6('weight_slow', 'weight_fast', 'weight_raw')} FROM vec_a")
def recency_vectors(e):
    return e.vectors_a()


@query(f"SELECT author_id, {r6('expertise_entropy')} FROM ent")
def expertise_entropy(e):
    t, _ = e.of_regime("A")
    return recency.entropy(recency.vectors(t, fx.END_YEAR), recency.vocabulary(t))


@query(f"SELECT author_id, {r6('weighted_year')}, recent_pubs, tensor_total, n_active_topics FROM act")
def weighted_year(e):
    return recency.activity(e.of_regime("A")[0], fx.END_YEAR, fx.WINDOW)


@query("SELECT author_id, dominant_topic, raw_topic, topic_shift FROM shift")
def topic_shift(e):
    return recency.topic_shift(e.vectors_a())


@query("SELECT author_id, dominant_topic AS topic_name FROM shift")
def dominant_topic(e):
    return recency.dominant(e.vectors_a())


@query(f"SELECT * EXCLUDE (recency_ratio), {r6('recency_ratio')} FROM feat_a")
def regime_a_features(e):
    return e.features_a()


_E = "expertise_entropy"


@query(f"SELECT COUNT(*) AS n_authors, round(avg({_E}), 6) AS mean_entropy, {o.pct(f'{_E} < 0.3')} AS pct_specialist, {o.pct(f'{_E} >= 0.3 AND {_E} < 0.6')} AS pct_focused, {o.pct(f'{_E} >= 0.6')} AS pct_generalist, {o.pct('topic_shift = 1')} AS pct_shift FROM feat_a")
def entropy_bands(e):
    return recency.entropy_bands(e.features_a())


@query("SELECT dominant_topic, COUNT(*) AS n_authors FROM feat_a GROUP BY 1 ORDER BY n_authors DESC, dominant_topic LIMIT 5")
def top_dominant_topics(e):
    return recency.top_topics(e.features_a())


# Roles

@query("SELECT paper_id, author_id, pos, n_authors FROM fx_authorship")
def author_positions(e):
    return e.authorship()


@query("SELECT * FROM posn")
def position_stats(e):
    return roles.positions(e.authorship())


@query(f"SELECT {o.n('n_authors = 1')} AS n_sole, {o.n('pos = 1 AND n_authors > 1')} AS n_first, {o.n('pos = n_authors AND n_authors > 1')} AS n_last, {o.n('pos > 1 AND pos < n_authors')} AS n_middle FROM fx_authorship")
def position_role_counts(e):
    return roles.position_roles(e.authorship())


@query("SELECT author_id, " + r6(*[f"z_{c}" for c in roles.FEATURES]) + " FROM z")
def zscore_features(e):
    return roles.zscores(e.role_inputs()).select("author_id", *[f"z_{c}" for c in roles.FEATURES])


@query(f"SELECT author_id, {r6('score_emerging', 'score_collaborating', 'score_supervising')} FROM sc")
def role_scores(e):
    return e.scored().select("author_id", *[f"score_{r}" for r in roles.ROLES])


@query("SELECT author_id, regime, prob_emerging, prob_collaborating, prob_supervising, dominant_role, role_confidence FROM roled")
def role_probabilities(e):
    return e.roled().select("author_id", "regime", *[f"prob_{r}" for r in roles.ROLES], "dominant_role", "role_confidence")


@query(
    """SELECT dominant_role, COUNT(*) AS n_authors, round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM roled), 6) AS pct, round(avg(role_confidence),
    6) AS avg_confidence FROM roled GROUP BY 1"""
)
def role_summary(e):
    return roles.summary(e.roled())


@query("SELECT regime, dominant_role, COUNT(*) AS n_authors FROM roled GROUP BY 1, 2")
def role_by_regime(e):
    return roles.by_regime(e.roled())


@query("SELECT role, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, MIN(p) AS min, MAX(p) AS max FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS role, prob_{r} AS p FROM roled" for r in roles.ROLES) + ") x GROUP BY 1")
def role_spread(e):
    return roles.spread(e.roled())


# Graph

@query("SELECT p, COUNT(*) AS n, COUNT(DISTINCT s) AS n_subjects FROM g GROUP BY 1")
def kg_predicates(e):
    return kg.predicate_counts(e.graph(share=("links", "topics", "profiles", "authorship")))


@query("SELECT s, p, o FROM g WHERE p = 'ex:publicationYear' AND o = '1997'")
def kg_pattern_scan(e):
    return kg.pattern(e.graph(), p="ex:publicationYear", o="1997").select("s", "p", "o")


@query("SELECT p, o FROM g WHERE s = 'http://example.org/author/1'")
def kg_predicate_objects(e):
    return kg.predicate_objects(e.graph(), "http://example.org/author/1")


_PIVOT = {"ex:totalPubs": "total_pubs", "ex:totalCitations": "total_cit", "ex:firstPublicationYear": "first_year", "ex:lastPublicationYear": "last_year", "ex:activeYears": "active_years"}


@query("SELECT s, " + ", ".join(f"MIN(CASE WHEN p = '{p}' THEN o END) AS {c}" for p, c in _PIVOT.items()) + " FROM g WHERE p IN (" + ", ".join(f"'{p}'" for p in _PIVOT) + ") GROUP BY s")
def kg_pivot_author_metrics(e):
    return kg.values(e.graph(), _PIVOT)


@query(
    """SELECT c_custkey, s FROM (SELECT c_custkey, 'http://example.org/author/' || CAST(c_custkey * 2 AS VARCHAR) AS s FROM customer) c WHERE s IN (SELECT s
    FROM g WHERE p = 'rdf:type' AND o = 'ex:Author')"""
)
def kg_exists_semi(e):
    asked = e.table("customer").select("c_custkey", kg.uri("author", F.col("c_custkey") * 2).alias("s"))
    return kg.exists(asked, "s", e.graph(), "rdf:type", "ex:Author").select("c_custkey", "s")


@query("SELECT s, p, o FROM gr WHERE p LIKE 'ex:prob%' OR p = 'ex:dominantRole'")
def kg_upsert_roles(e):
    new = kg.role_triples(e.roled())
    g = kg.upsert(e.graph(), kg.ROLE_PREDICATES, new)
    twice = kg.upsert(g, kg.ROLE_PREDICATES, new)
    return twice.where(F.col("p").isin(*kg.ROLE_PREDICATES)).select("s", "p", "o")


@query(
    """SELECT 'http://example.org/author/' || author_id AS s, prob_emerging, prob_collaborating, prob_supervising, dominant_role FROM roled
    WHERE author_id IN (SELECT author_id FROM cands)"""
)
def kg_star_roles(e):
    return kg.roles(e.graph(True), e.candidates().select(kg.uri("author", F.col("author_id")).alias("s")))


@query(
    """SELECT tp.title AS paper_title, ta_.title AS author_name, a.pos, CAST(a.n_authors AS INTEGER) AS n_authors FROM fx_authorship a
    JOIN titles tp ON tp.s = 'http://example.org/paper/' || a.paper_id JOIN titles ta_ ON ta_.s = 'http://example.org/author/' || a.author_id ORDER BY 1,
    3, 2 LIMIT 15"""
)
def kg_authorship_topn(e):
    return kg.authorship_listing(e.graph())


def _top(role: str) -> str:
    return f"SELECT 'http://example.org/author/' || author_id AS s, name, prob_{role} FROM roled WHERE dominant_role = '{role}' ORDER BY prob_{role} DESC, s LIMIT 5"


@query(_top("emerging"))
def role_topn_emerging(e):
    return kg.role_top(e.graph(True), "emerging")


@query(_top("supervising"))
def role_topn_supervising(e):
    return kg.role_top(e.graph(True), "supervising")


@query("SELECT dominant_role, COUNT(*) AS n_authors FROM roled GROUP BY 1")
def role_distribution(e):
    return kg.role_counts(e.graph(True))


@query("SELECT 'http://example.org/author/' || author_id AS author, MIN(year) AS first_year, MAX(year) AS last_year FROM ay GROUP BY author_id")
def career_first_last(e):
    return kg.career_window(e.graph())


@query(
    """SELECT input, s FROM (SELECT upper(repeat(' ', 2) || c_name || ' ') AS input FROM customer UNION ALL SELECT n_name FROM nation) w
    JOIN (SELECT DISTINCT s, lower(trim(o)) AS t FROM g WHERE p = 'dcterms:title') t ON t.t = lower(trim(w.input)) UNION ALL
    SELECT 'http://example.org/author/x', 'http://example.org/author/x'"""
)
def entity_lookup(e):
    asked = e.table("customer").select(F.upper(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("input")).unionByName(e.table("nation").select(F.col("n_name").alias("input")))
    return kg.lookup(e.graph(), asked.unionByName(e.spark.createDataFrame([("http://example.org/author/x",)], "input string")))


@query(
    """SELECT c_custkey, substr(CASE WHEN x = '' THEN substr(sha1(c_name), 1, 8) ELSE x END, 1, 80) AS slug FROM (SELECT c_custkey, c_name,
    regexp_replace(regexp_replace(c_name, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS x FROM customer) y"""
)
def slugify_names(e):
    return e.table("customer").select("c_custkey", T.slug(F.col("c_name")).alias("slug"))


@query("SELECT 'http://example.org/author/' || author_id AS author, 'http://example.org/org/' || org AS org, org AS org_title FROM fx_author")
def author_orgs(e):
    return kg.organizations(e.graph())


@query(
    """SELECT DISTINCT 'http://example.org/author/' || a.author_id AS author, 'http://example.org/topic/' || t.topic AS subtopic FROM fx_authorship a
    JOIN fx_t3 t USING (paper_id)"""
)
def author_subtopics(e):
    return kg.subtopics(e.graph(share=("links", "topics")))


@query(
    """SELECT DISTINCT 'http://example.org/author/' || x.author_id AS author, 'http://example.org/topic/' || p.main_topic AS main_topic
    FROM (SELECT DISTINCT a.author_id, t.topic FROM fx_authorship a JOIN fx_t3 t USING (paper_id)) x JOIN fx_parent p ON p.subtopic = x.topic"""
)
def author_main_topics(e):
    return kg.main_topics(e.graph(share=("links", "topics")))


@query(
    """SELECT a.author_id AS author, b.author_id AS coauthor, COUNT(*) AS n_shared FROM fx_authorship a JOIN fx_authorship b ON b.paper_id = a.paper_id
    AND b.author_id <> a.author_id GROUP BY 1, 2 HAVING COUNT(*) >= 2"""
)
def coauthor_counts(e):
    return kg.coauthors(e.links().select(F.col("paper_id").alias("paper"), F.col("author_id").alias("author")))


@query("SELECT author, text FROM ragt")
def rag_text(e):
    return e.contexts()


@query(
    f"""SELECT 'http://example.org/author/' || a.author_id AS author, concat_ws(chr(10), 'Author: ' || a.name, r.v) AS text FROM fx_author a LEFT
    JOIN (SELECT author_id, {o.ROLE}{o.SCORES} AS v FROM roled) r USING (author_id)"""
)
def rag_enrich_role(e):
    plain = e.authors().select(kg.uri("author", F.col("author_id")).alias("author"), F.concat(F.lit("Author: "), "name").alias("text"))
    return rag.enrich(plain, e.roled().withColumn("s", kg.uri("author", F.col("author_id"))))


@query("SELECT s, p, o FROM g")
def kg_ntriples_roundtrip(e):
    """Triples written as N-Triples lines and read back."""
    return rdf.parse_ntriples(rdf.ntriples(e.graph(share=("links", "topics", "profiles", "authorship")))).select("s", "p", "o")


@query("""SELECT i.pos, i.id, COALESCE(t.text, '') AS text FROM (SELECT CAST(pos AS BIGINT) AS pos, CAST(author_id AS VARCHAR) AS id FROM cands
    UNION ALL SELECT 1000000 + pos, 'http://example.org/author/' || author_id FROM cands WHERE pos < 3
    UNION ALL SELECT -1, 'nobody') i LEFT JOIN ragt t ON t.author = CASE WHEN regexp_matches(i.id,
    '^[0-9]+$') THEN 'http://example.org/author/' || i.id ELSE i.id END""")
def rag_texts_in_order(e):
    """The context of each id asked for: numbers and URIs, some of them twice, and one that the graph doesn't have."""
    ids = e.candidates().select(F.col("pos").cast("long").alias("pos"), F.col("author_id").cast("string").alias("id"))
    again = e.candidates().where("pos < 3").select((F.col("pos") + 1000000).cast("long").alias("pos"), kg.uri("author", F.col("author_id")).alias("id"))
    return rag.texts_in_order(e.store(), ids.unionByName(again).unionByName(e.spark.createDataFrame([(-1, "nobody")], ids.schema)))


# Parsing and text

@query(
    """SELECT paper_id, pos, CAST(n_authors AS INTEGER) AS n_authors, CAST(author_id AS VARCHAR) AS author_id, CAST(NULL AS VARCHAR) AS name
    FROM fx_authorship"""
)
def parse_pyliteral(e):
    """Author lists as Python literals, one row per author: a list per paper, made from the authorship."""
    entry = F.concat(F.lit("{'id': '"), F.col("author_id").cast("string"), F.lit("', 'name': None}"))
    lists = e.authorship().groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("x")))).alias("l"))
    text = lists.select("paper_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda s: s["x"]), ", "), F.lit("]")).alias("authors"))
    return literals.authors_of(text)


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)

_YEAR = "CAST(NULLIF(regexp_extract(text, '\\d{4}'), '') AS INTEGER)"


@query(f"SELECT doc_id, CASE WHEN {_YEAR} BETWEEN 1950 AND 2019 THEN {_YEAR} END AS year FROM documents")
def parse_year(e):
    return e.table("documents").select("doc_id", T.year(F.col("text")).alias("year"))


@query("SELECT item_id, COALESCE(array_to_string(list_filter(string_split_regex(translate('[' || text || ']', '[]', ''), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN (" + _STOP + ")), ' '), '') AS keywords FROM benchmark")
def keyword_extraction(e):
    return e.table("benchmark").select("item_id", T.keywords(F.concat(F.lit("["), "text", F.lit("]"))).alias("keywords"))


@query("SELECT item_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: x), ' ') AS expanded FROM benchmark")
def query_expansion(e):
    """The stand-in says its input again, between a mark and a second paragraph that doesn't count."""
    return scorers.expanded(e.table("benchmark"), key="item_id", model=scorers.Lexical)


_NUM = "CASE WHEN p_partkey % 2 = 0 THEN substr(p_brand, 7) ELSE p_type END"


@query(f"SELECT p_partkey, COALESCE(TRY_CAST({_NUM} AS DOUBLE), 0.0) AS value FROM part")
def coerce_numeric(e):
    return e.table("part").select("p_partkey", T.number_or(F.when(F.col("p_partkey") % 2 == 0, F.substring("p_brand", 7, 100)).otherwise(F.col("p_type"))).alias("value"))


_KW = fx.QUERY_TEXT


@query(f"SELECT doc_id, round({o.jac(o.KW, 'text')}, 6) AS jaccard FROM documents")
def jaccard_similarity(e):
    return e.table("documents").select("doc_id", T.jaccard(F.lit(_KW), F.col("text")).alias("jaccard"))


@query(f"SELECT doc_id, round({o.lev(o.KW, 't')}, 6) AS levenshtein FROM (SELECT doc_id, {o.PLAIN.format(x='text')} AS t FROM documents) x")
def levenshtein_similarity(e):
    return e.table("documents").select("doc_id", T.levenshtein_similarity(F.lit(_KW), F.col("text")).alias("levenshtein"))


_QUOTES = T.QUOTES.replace("'", "''")


@query(f"SELECT doc_id, trim(regexp_replace(translate(lower(text), '{T.DASHES}{_QUOTES}', '--'), '{T.NO_TAG}', ' ', 'g')) AS text FROM documents")
def normalize_text(e):
    return e.table("documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, COALESCE(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({_STOP})), ' '),
    '') AS text FROM documents"""
)
def remove_stopwords(e):
    return e.table("documents").select("doc_id", T.without_stopwords(F.col("text")).alias("text"))


@query(
    """SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sentences, l[1] AS first, l[-1] AS last FROM (SELECT doc_id, string_split(regexp_replace(text,
    '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM documents) x"""
)
def sentence_split(e):
    s = T.sentences(F.col("text"))
    return e.table("documents").select("doc_id", F.size(s).alias("n_sentences"), F.element_at(s, 1).alias("first"), F.element_at(s, -1).alias("last"))


# Word borders know only ASCII in DuckDB, so other letters stand as x and other signs as spaces.
_BORDERS = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\pL\pN]', ' ', 'g'), '[^\x00-\x7F]', 'x', 'g')"


@query(f"SELECT doc_id, TRY_CAST(regexp_extract({_BORDERS}, '{T.SCORE}', 1) AS DOUBLE) AS score FROM documents")
def extract_score(e):
    return e.table("documents").select("doc_id", T.number_0_100(F.col("text")).alias("score"))


@query(
    """SELECT p_partkey, CASE WHEN hi - lo < 1e-8 THEN 0.0 ELSE round((p_retailprice - lo) / (hi - lo + 1e-8), 6) END AS scaled FROM part CROSS
    JOIN (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM part) x"""
)
def minmax_scale(e):
    return V.minmax(e.table("part").select("p_partkey", "p_retailprice"), {"p_retailprice": "scaled"}).drop("p_retailprice")


@query(
    """SELECT source, CAST(i - 1 AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT d.source, unnest(e.embedding) AS x,
    generate_subscripts(e.embedding, 1) AS i FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) y GROUP BY 1, 2"""
)
def embedding_centroid(e):
    return e.centroids().select("source", F.posexplode("centroid").alias("i", "x"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN regexp_replace(props, ': ([0-9]+)', ':"\\1"', 'g') END AS parsed,
    CASE WHEN event_id % 3 = 2 THEN 'Sorry: ' || props END AS raw FROM events"""
)
def json_fallback(e):
    """Answers as a model may give them: bare JSON, fenced JSON, and text that is none."""
    props = F.col("props")
    answer = F.when(F.col("event_id") % 3 == 0, props).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(F.concat(F.lit("Sorry: "), props))
    parsed, raw = T.json_or_raw(answer, "map<string,string>")
    return e.table("events").select("event_id", F.to_json(parsed).alias("parsed"), raw.alias("raw"))


@query("""SELECT source, CAST(i - 1 AS INTEGER) AS i,
    round((MAX(CASE WHEN k = 1 THEN CAST(x AS DOUBLE) END) + COALESCE(AVG(CASE WHEN k > 1 THEN CAST(x AS DOUBLE) END), 0.0)) / 2, 6) AS x FROM (
    SELECT source, k, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM (SELECT d.source, e.embedding,
    ROW_NUMBER() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS k FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id) y) z GROUP BY 1, 2""")
def embedding_with_title(e):
    """A source's first document stands for a title, its others for the sentences of an abstract."""
    rows = e.table("documents").select("doc_id", "source").join(e.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    title = rows.groupBy("source").agg(F.min_by("embedding", "doc_id").alias("title"), F.min("doc_id").alias("first"))
    rest = rows.join(title.select("source", "first"), "source").where("doc_id <> first")
    means = title.join(V.centroid(rest, "source", "embedding"), "source", "left")
    return means.select("source", F.posexplode(V.with_title(F.col("title"), F.col("centroid"))).alias("i", "x"))


# Retrieval

@query("SELECT doc_id, round(c, 6) AS score FROM cos WHERE c >= 0.3")
def cosine_threshold(e):
    return retrieval.cosine_threshold(e.docs(), e.query_vector()).select("doc_id", "score")


@query("SELECT doc_id, round(c, 6) AS score FROM cos WHERE c >= 0.3 ORDER BY c DESC, doc_id LIMIT 25")
def cosine_topk(e):
    return retrieval.cosine_topk(e.docs(), e.query_vector())


@query("SELECT doc_id, round(c, 6) AS cosine FROM cand")
def hybrid_candidates(e):
    return retrieval.hybrid_candidates(e.docs(), e.query_vector())


@query("SELECT doc_id, round(score, 6) AS score FROM hyb")
def hybrid_retrieval(e):
    return e.retrieved()


@query(f"""SELECT doc_id, round(SUM(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM (
    SELECT t.doc_id, t.term, t.tf, t.dl, q.w, COUNT(*) OVER (PARTITION BY t.term) AS df FROM (SELECT doc_id, term, len(l) AS dl, COUNT(*) AS tf
    FROM (SELECT doc_id, l, unnest(l) AS term FROM (SELECT doc_id, {o.toks('text')} AS l FROM documents) a) b GROUP BY ALL) t
    JOIN (SELECT term, COUNT(*) AS w FROM (SELECT unnest({o.toks(o.KW)}) AS term) c GROUP BY 1) q USING (term)) x
    CROSS JOIN (SELECT COUNT(*) AS n, avg(len({o.toks('text')})) AS avgdl FROM documents) s GROUP BY doc_id
    ORDER BY round(SUM(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) DESC, doc_id LIMIT 25""")
def bm25_topk(e):
    return retrieval.bm25(e.table("documents"), _KW)


@query("SELECT doc_id, n_chars AS n_citation FROM documents")
def rank_documents(e):
    return retrieval.rank_documents(e.table("documents").select("doc_id", F.col("n_chars").alias("n_citation")))


@query(f"""SELECT title, MIN(doc_id) AS doc_id, concat_ws(',', CASE WHEN MAX(CASE WHEN b = 0 THEN 1 END) = 1 THEN 'cosine' END,
    CASE WHEN MAX(CASE WHEN b = 1 THEN 1 END) = 1 THEN 'llm' END) AS selected_by FROM (
    SELECT md5(text) AS title, doc_id, 0 AS b FROM cand UNION ALL SELECT md5(text), doc_id, 1 FROM documents WHERE {o.jac(o.KW, 'text')} > 0.1) x
    GROUP BY title""")
def union_provenance(e):
    """The fixture's title is a digest of the whole text, so only equal texts are one document."""
    titled = lambda docs: docs.select("doc_id", F.md5("text").alias("title"))
    first = titled(e.texts().join(F.broadcast(retrieval.hybrid_candidates(e.docs(), e.query_vector()).select("doc_id")), "doc_id"))
    return retrieval.union_by_title(first, titled(e.texts().where(T.jaccard(F.lit(_KW), F.col("text")) > 0.1)))


@query(
    """SELECT author_id, CAST(ROW_NUMBER() OVER (ORDER BY f, author_id) - 1 AS INTEGER) AS pos FROM (SELECT a.author_id, MIN(r.rank * 1000 + a.pos) AS f
    FROM rpapers r JOIN fx_authorship a USING (paper_id) GROUP BY 1) x"""
)
def dedupe_keep_first(e):
    listed = e.authorship().join(F.broadcast(e.ranked_papers()), "paper_id").select("author_id", (F.col("rank") * 1000 + F.col("pos")).alias("at"))
    return retrieval.keep_first(listed, "author_id", "at")


@query("SELECT author_id, pos FROM cands")
def candidate_authors(e):
    return e.candidates()


@query("SELECT a.author_id, COUNT(*) AS n_matched, MIN(r.rank) AS best_rank FROM rpapers r JOIN fx_authorship a USING (paper_id) GROUP BY 1")
def matched_papers(e):
    return retrieval.matched_papers(e.ranked_papers(), e.authorship())


@query(
    """SELECT author_id, round(n_citation, 6) AS n_citation, CAST(ROW_NUMBER() OVER (ORDER BY n_citation DESC, author_id) AS INTEGER) AS rank FROM fx_author
    WHERE tag IS NOT NULL AND author_id IN (SELECT author_id FROM cands)"""
)
def rank_citations(e):
    return retrieval.rank_by_citations(e.candidates(), e.authors())


# Diversity

@query("SELECT author_id, pos, role, round(prob, 6) AS prob, rn FROM pool")
def role_group_rank(e):
    return e.pool()


@query("SELECT author_id, pos, role, round(prob, 6) AS prob, rn FROM pool", **ANYONE)
def role_pool(e):
    return e.explained_pool()


@query("SELECT author_id, role, round(prob, 6) AS prob, rank FROM ranking")
def role_diverse_ranking(e):
    return e.ranking()


@query("SELECT author_id, role, round(prob, 6) AS prob, rank FROM quotaed", **ANYONE)
def equal_quota(e):
    return diversity.equal_quota(e.explained_pool())


@query(
    """SELECT round(COALESCE(SUM(-p * ln(p)) / ln(3), 0.0), 4) AS role_diversity FROM (SELECT CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS p
    FROM ranking JOIN roled USING (author_id) WHERE rank <= 10 GROUP BY dominant_role) x"""
)
def role_diversity(e):
    return diversity.role_diversity(e.ranking(), e.roled())


# Metrics

@query(f"SELECT author_id, round(n_citation, 6) AS n_citation FROM fx_author WHERE lower(tag) = lower('{fx.QUERY_TAG}')")
def ground_truth_by_tag(e):
    return evaluate.ground_truth(e.authors(), fx.QUERY_TAG)


def _rel(e):
    return evaluate.judged(e.predicted(), e.truth())


@query("SELECT query, round(value, 6) AS value FROM p10")
def eval_precision_at_k(e):
    return evaluate.precision(_rel(e), 10)


@query("SELECT query, round(value, 6) AS value FROM ap")
def eval_average_precision(e):
    return evaluate.average_precision(_rel(e), 10)


@query("SELECT query, round(value, 6) AS value FROM rr")
def eval_reciprocal_rank(e):
    return evaluate.reciprocal_rank(_rel(e), 10)


@query("SELECT query, round(value, 6) AS value FROM nd10")
def eval_ndcg_at_k(e):
    return evaluate.ndcg(_rel(e), e.truth(), 10)


@query("SELECT query, round(CAST(SUM(rel) AS DOUBLE) / any_value(n), 6) AS value FROM rel_all JOIN ngt USING (query) GROUP BY 1")
def eval_recall(e):
    return evaluate.recall(_rel(e), e.truth())


@query(
    """SELECT (SELECT round(avg(value), 6) FROM ap) AS map_10, (SELECT round(avg(value), 6) FROM rr) AS mrr_10, (SELECT round(avg(value), 6)
    FROM p5) AS mp_5, (SELECT round(avg(value), 6) FROM p10) AS mp_10, (SELECT round(avg(value), 6) FROM nd5) AS ndcg_5, (SELECT round(avg(value), 6)
    FROM nd10) AS ndcg_10"""
)
def eval_summary(e):
    return evaluate.summary(e.predicted(), e.truth())


# Models, by their lexical stand-ins

@query(
    f"""SELECT doc_id, round({o.jac(o.KW, 'text')}, 6) AS score FROM (SELECT h.doc_id, d.text FROM hyb h JOIN fx_doc d USING (doc_id)) x
    ORDER BY round({o.jac(o.KW, 'text')}, 9) DESC, doc_id LIMIT 15"""
)
def rerank_documents(e):
    return scorers.rerank(e.docs().join(F.broadcast(e.retrieved().select("doc_id")), "doc_id", "left_semi"), _KW, 15)


@query(f"SELECT doc_id, round({o.jac(o.KW, 'text')}, 6) AS score FROM documents WHERE {o.jac(o.KW, 'text')} > 0.05")
def binary_relevance(e):
    """The lexical stand-in scores lower than a model would, so the threshold is lower than its default."""
    return scorers.relevant(e.table("documents"), _KW, 0.05)


@query(f"SELECT doc_id, CAST(floor(100 * {o.jac(o.KW, 'text')}) AS BIGINT) AS score FROM documents WHERE floor(100 * {o.jac(o.KW, 'text')}) >= 5")
def score_threshold(e):
    said = F.concat(F.lit("Score: "), F.floor(100 * T.jaccard(F.lit(_KW), F.col("text"))).cast("string"), F.lit("."))
    return scorers.scored_by_answer(e.table("documents").select("doc_id", said.alias("answer")), threshold=5).select("doc_id", "score")


_SHORT = "(SELECT h.*, d.text, ROW_NUMBER() OVER (ORDER BY h.score DESC, h.doc_id) AS pos FROM hyb h JOIN fx_doc d USING (doc_id)) x"


def _short(e):
    return e.docs().select("doc_id", "text").join(F.broadcast(e.retrieved()), "doc_id")


@query(f"SELECT doc_id, CAST(ROW_NUMBER() OVER (ORDER BY {o.jac(o.KW, 'text')} DESC, pos) AS INTEGER) AS rank FROM {_SHORT} WHERE pos <= 15")
def pairwise_rerank(e):
    """The first 15 retrieved, inserted one by one. With a judge as consistent as the stand-in that is a stable sort."""
    return scorers.ordered(_short(e), _KW, [F.desc("score"), "doc_id"], 15)


@query(f"SELECT doc_id, CAST(ROW_NUMBER() OVER (ORDER BY {o.jac(o.KW, 'text')} DESC, pos) AS INTEGER) AS rank FROM {_SHORT}")
def merge_rerank(e):
    """All retrieved, by merging twice: of equals the right one goes first each time, so twice is as before."""
    return scorers.ordered(_short(e), _KW, [F.desc("score"), "doc_id"], method="merge")


@query()
def pairwise_wins(e):
    """The same list by the number of others that each beats, all pairs judged in parallel."""
    return scorers.pairwise(_short(e), _KW, 15)


_EXPERTISE = "Brand#13 Brand#45 emerging collaborating expert"
_FIRST = "(SELECT t.author, t.text, r.rank FROM ranking r JOIN ragt t ON t.author = 'http://example.org/author/' || r.author_id WHERE r.rank <= 25) x"


@query(f"SELECT author, round({o.jac(f"'{_EXPERTISE}'", 'text')}, 6) AS score FROM {_FIRST} ORDER BY {o.jac(f"'{_EXPERTISE}'", 'text')} DESC, author LIMIT 10")
def author_rerank(e):
    return scorers.rerank(e.first_contexts(), _EXPERTISE, 10, key="author")


@query(f"SELECT author, CAST(ROW_NUMBER() OVER (ORDER BY {o.jac(f"'{_EXPERTISE}'", 'text')} DESC, rank) AS INTEGER) AS rank FROM {_FIRST}")
def author_pairwise(e):
    return scorers.ordered(e.first_contexts(), _EXPERTISE, ["rank"], key="author")


@query(
    """SELECT 'http://example.org/author/' || r.author_id AS author, r.rank FROM ranking r WHERE r.rank <= 25 AND r.author_id IN (SELECT author_id
    FROM fx_authorship JOIN fx_t3 USING (paper_id) WHERE topic = 'Brand#13')"""
)
def author_validation(e):
    """Authors whom the stand-in, which looks for the query's words among papers and topics, takes for experts."""
    first = e.first_contexts().select("author", "rank")
    facets = rag.summaries(e.store(), first).select("author", F.col("papers.title").alias("papers"), F.col("subtopics.title").alias("topics"))
    return scorers.validated(first.join(facets, "author"), "Brand#13").select("author", "rank")


_CAREER = "'Career span: ' || f.career_span || ' years, role: ' || f.dominant_role || ', recency: ' || printf('%.3f', m2.recency_ratio + 1e-9)"


@query(f"""SELECT r.author_id, r.rank, m.n_matched, '{{"relevance":"Topic: {_KW}","evidence":"' || {o.SCORES} || '"}}' AS relevance,
    CAST(NULL AS VARCHAR) AS relevance_raw,
    '{{"role":"' || {_CAREER} || '","reason":"' || {o.SCORES} || '"}}' AS career, CAST(NULL AS VARCHAR) AS career_raw
    FROM ranking r JOIN roled f USING (author_id) JOIN rmap m2 USING (author_id) JOIN (SELECT a.author_id, COUNT(*) AS n_matched FROM rpapers p
    JOIN fx_authorship a USING (paper_id) GROUP BY 1) m USING (author_id) WHERE r.rank <= 3""")
def explain_authors(e):
    found = explained_authors(e)
    return found.withColumns({c: F.to_json(c) for c in ("relevance", "career")})


_URI = "'http://example.org/{}/' || "


@query(f"""SELECT {_URI.format('author')} a.author_id AS author, a.name, CAST(1 AS INTEGER) AS n_orgs, {_URI.format('org')} a.org AS org, p.n_papers,
    p.first_paper, t.n_subtopics, t.n_main_topics, c.n_coauthors, c.coauthor, c.shared, r.dominant_role AS role FROM fx_author a
    LEFT JOIN (SELECT author_id, CAST(COUNT(*) AS INTEGER) AS n_papers, MIN({_URI.format('paper')} paper_id) AS first_paper FROM fx_authorship
    GROUP BY 1) p USING (author_id)
    LEFT JOIN (SELECT author_id, CAST(COUNT(DISTINCT topic) AS INTEGER) AS n_subtopics, CAST(COUNT(DISTINCT main_topic) AS INTEGER) AS n_main_topics
    FROM (SELECT DISTINCT author_id, topic FROM fx_authorship JOIN fx_t3 USING (paper_id)) x JOIN fx_parent ON subtopic = topic
    GROUP BY 1) t USING (author_id)
    LEFT JOIN (SELECT author_id, CAST(COUNT(*) AS INTEGER) AS n_coauthors, MIN(CASE WHEN k = 1 THEN co END) AS coauthor,
    MIN(CASE WHEN k = 1 THEN n END) AS shared FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY n DESC, co) AS k FROM (
      SELECT a.author_id, {_URI.format('author')} b.author_id AS co, COUNT(*) AS n FROM fx_authorship a
      JOIN fx_authorship b ON b.paper_id = a.paper_id AND b.author_id <> a.author_id GROUP BY 1, 2 HAVING COUNT(*) >= 2) x) y
      GROUP BY 1) c USING (author_id)
    LEFT JOIN roled r USING (author_id)""")
def author_summaries(e):
    """A JSON record for each author of the graph, and what stands in it."""
    g = e.store()
    found = rag.summaries(g, kg.subjects(g, "rdf:type", "ex:Author").withColumnRenamed("s", "author"), 2)
    x = F.from_json(F.to_json(F.struct("*")), found.schema)
    size = lambda c: F.nullif(F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return found.select(x.alias("x")).select(
        "x.author", "x.name", size("x.orgs").alias("n_orgs"), F.get("x.orgs", 0)["uri"].alias("org"), size("x.papers").alias("n_papers"), F.get("x.papers", 0)["uri"].alias("first_paper"),
        size("x.subtopics").alias("n_subtopics"), size("x.main_topics").alias("n_main_topics"), size("x.coauthors").alias("n_coauthors"),
        F.get("x.coauthors", 0)["uri"].alias("coauthor"), F.get("x.coauthors", 0)["count"].alias("shared"), F.col("x.role.dominant_role").alias("role"),
    )


_TRACE = """SELECT '{pipeline}' AS pipeline, '{method}' AS ranking_method, {n} AS n_candidates, {quota} AS quota_per_role, x.rank, x.author_id, f.name, CAST(f.career_span AS INTEGER) AS career_span, round(f.total_cit, 6) AS total_citations, f.dominant_role FROM ({ranked}) x LEFT JOIN roled f USING (author_id) WHERE x.rank <= 10"""
_BY_CITATIONS = "SELECT author_id, CAST(ROW_NUMBER() OVER (ORDER BY n_citation DESC, author_id) AS INTEGER) AS rank FROM fx_author WHERE tag IS NOT NULL AND author_id IN (SELECT author_id FROM cands)"
_NC = "(SELECT COUNT(*) FROM cands)"


def _told(e, pipeline):
    return explanation(e, pipeline).select(F.from_json("explanation", EXPLANATION).alias("x")).select("x.*")


@query(" UNION ALL ".join([
    _TRACE.format(pipeline="proposed", method=METHODS["proposed"][0], n=_NC, quota=f"{_NC} // 3", ranked="SELECT author_id, rank FROM quotaed"),
    _TRACE.format(pipeline="baseline", method=METHODS["baseline"][0], n=_NC, quota="CAST(NULL AS BIGINT)", ranked=_BY_CITATIONS),
]), **ANYONE)
def explain_json(e):
    """Both explanations' traces, read back from their JSON."""
    both = _told(e, "proposed").unionByName(_told(e, "baseline"))
    rows = both.select("pipeline", "ranking_method", "n_candidates", "quota_per_role", F.explode("top_candidates").alias("c"))
    return rows.select("pipeline", "ranking_method", "n_candidates", "quota_per_role", "c.rank", "c.author_id", "c.name", "c.career_span", "c.total_citations", "c.dominant_role")


@query(
    """SELECT role, COUNT(*) OVER (PARTITION BY role) AS n_members, author_id, round(prob, 4) AS role_prob, CAST(rn - 1 AS INTEGER) AS place FROM pool""", **ANYONE
)
def explain_pool(e):
    """The pools of the explanation, read back from its JSON."""
    x = _told(e, "proposed").select("pool_role_distribution", F.explode("role_groups_detail").alias("role", "members"))
    rows = x.select("role", F.element_at("pool_role_distribution", F.col("role")).alias("n_members"), F.posexplode("members").alias("place", "m"))
    return rows.select("role", "n_members", "m.author_id", "m.role_prob", "place")


@query("SELECT c.author_id, c.pos, 'http://example.org/author/' || c.author_id AS id FROM cands c")
def candidate_uris(e):
    return e.candidates().select("author_id", "pos", kg.uri("author", F.col("author_id")).alias("id"))


@query("SELECT r.author_id, r.rank, r.role, a.name FROM ranking r JOIN fx_author a USING (author_id)")
def expert_query(e):
    """The online query from text and vector to named, role-diverse experts."""
    return e.ranking().join(e.authors().select("author_id", "name"), "author_id").select("author_id", "rank", "role", "name")


