"""The same queries in SQL, from common table expressions that a query takes as it names them."""

from __future__ import annotations

import re

V = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
KW = "'and the on it is he for tion'"
Q = "(CASE WHEN {n} = 0 THEN 0.0 ELSE 100.0 * {c} / {n} END)"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda z: z <> '')"


def jac(a: str, b: str) -> str:
    a, b = f"list_distinct({toks(a)})", f"list_distinct({toks(b)})"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


def lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - CAST(levenshtein({a}, {b}) AS DOUBLE) / greatest(length({a}), length({b})) END"


def pct(cond: str) -> str:
    return f"round(avg(CASE WHEN {cond} THEN 100.0 ELSE 0.0 END), 6)"


def n(cond: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {cond}) AS BIGINT)"


B = "'http://example.org/"
#: Edit distances count bytes in DuckDB, so each other code point stands as one sign that the query's words don't have.
PLAIN = r"regexp_replace({x}, '[^\x00-\x7F]', '#', 'g')"

CTES = {
    "fx_authorship": """SELECT paper_id, author_id, CAST(ROW_NUMBER() OVER (PARTITION BY paper_id ORDER BY k) AS INTEGER) AS pos, COUNT(*) OVER (PARTITION BY paper_id) AS n_authors
        FROM (SELECT CAST(o_orderdate AS DATE) AS paper_id, o_custkey AS author_id, MIN(o_orderkey) AS k FROM orders GROUP BY CAST(o_orderdate AS DATE), o_custkey) x""",
    "fx_paper": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS paper_id, CAST(YEAR(o_orderdate) AS INTEGER) AS year FROM orders",
    "fx_t2": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS paper_id, o_orderpriority AS topic FROM orders",
    "fx_t3": "SELECT DISTINCT CAST(o.o_orderdate AS DATE) AS paper_id, p.p_brand AS topic FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey",
    "fx_parent": "SELECT DISTINCT p_brand AS subtopic, p_type AS main_topic FROM part",
    "fx_author": "SELECT c_custkey AS author_id, c_name AS name, n_name AS org, NULLIF(c_mktsegment, 'MACHINERY') AS tag, c_acctbal AS n_citation FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "fx_doc": """SELECT d.doc_id, d.text, d.lang, e.embedding, p.paper_id
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
        JOIN (SELECT paper_id, ROW_NUMBER() OVER (ORDER BY paper_id) - 1 AS day_no, COUNT(*) OVER () AS n_days FROM fx_paper) p ON p.day_no = d.doc_id % p.n_days""",
    "t2": "SELECT a.author_id, p.year, t.topic AS topic_id, t.topic AS topic_name, COUNT(*) AS frequency FROM fx_paper p JOIN fx_t2 t USING (paper_id) JOIN fx_authorship a USING (paper_id) WHERE p.year BETWEEN 1950 AND 2019 GROUP BY ALL",
    "t3": "SELECT a.author_id, p.year, t.topic AS topic_id, t.topic AS topic_name, COUNT(*) AS frequency FROM fx_paper p JOIN fx_t3 t USING (paper_id) JOIN fx_authorship a USING (paper_id) WHERE p.year BETWEEN 1950 AND 2019 GROUP BY ALL",
    "ay": "SELECT a.author_id, p.year FROM fx_authorship a JOIN fx_paper p USING (paper_id)",
    "prof": "SELECT author_id, COUNT(*) AS total_pubs, MIN(year) AS first_year, MAX(year) AS last_year, COUNT(DISTINCT year) AS active_years, MAX(year) - MIN(year) AS career_span FROM ay GROUP BY author_id",
    "ratio": "SELECT author_id, COUNT(*) AS n_papers, COUNT(*) FILTER (WHERE year >= 1999) AS n_recent, CAST(COUNT(*) FILTER (WHERE year >= 1999) AS DOUBLE) / COUNT(*) AS recency_ratio FROM ay GROUP BY author_id",
    "rec_t": """SELECT author_id, CAST(SUM(frequency) AS BIGINT) AS tensor_total, CAST(SUM(CASE WHEN year >= 1999 THEN frequency ELSE 0 END) AS BIGINT) AS recent_pubs,
        CAST(SUM(CASE WHEN year >= 1999 THEN frequency ELSE 0 END) AS DOUBLE) / SUM(frequency) AS recency_ratio FROM t2 GROUP BY author_id""",
    "cal": """SELECT author_id, COUNT(DISTINCT s) AS n_slices, CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT s) AS avg_pubs_per_slice
        FROM (SELECT ay.author_id, CAST(floor((year - CAST(floor(f / 3.0) * 3 AS INTEGER)) / 3.0) AS BIGINT) AS s FROM ay JOIN (SELECT author_id, MIN(year) AS f FROM ay GROUP BY 1) m USING (author_id)) x GROUP BY author_id""",
    "rmap": """SELECT p.author_id, a.name, p.total_pubs, a.n_citation AS total_cit, p.first_year, p.last_year, p.career_span, p.active_years,
        COALESCE(r.recency_ratio, 0.0) AS recency_ratio, COALESCE(r.tensor_total, 0) AS tensor_total,
        CASE WHEN COALESCE(r.tensor_total, 0) = 0 THEN 'none' WHEN CAST(r.tensor_total AS DOUBLE) / CASE WHEN p.total_pubs = 0 THEN 1 ELSE p.total_pubs END < 0.2 THEN 'partial' ELSE 'full' END AS year_coverage,
        CASE WHEN p.career_span >= 6 AND p.total_pubs >= 8 AND p.active_years >= 3 THEN 'B' ELSE 'A' END AS regime
        FROM prof p JOIN fx_author a USING (author_id) LEFT JOIN rec_t r USING (author_id)""",
    "cells0": """SELECT t.author_id, CAST(floor((t.year - m.first_year) / 2.0) AS BIGINT) AS slice_id, m.first_year, t.topic_name, CAST(SUM(t.frequency) AS BIGINT) AS frequency
        FROM t2 t JOIN rmap m ON m.author_id = t.author_id AND m.regime = 'B' WHERE t.year >= m.first_year GROUP BY ALL""",
    "cells": """SELECT c.author_id, c.slice_id, c.first_year + c.slice_id * 2 AS year_start, c.first_year + c.slice_id * 2 + 1 AS year_end, c.topic_name, c.frequency
        FROM cells0 c JOIN (SELECT author_id FROM cells0 GROUP BY 1 HAVING MAX(slice_id) > MIN(slice_id)) k USING (author_id)""",
    "meta": """SELECT author_id, slice_id, year_start, year_end, CAST(SUM(frequency) AS BIGINT) AS pub_count, MAX(CASE WHEN r = 1 THEN topic_name END) AS dominant_topic, COUNT(*) AS n_topics_active
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id, slice_id ORDER BY frequency DESC, topic_name) AS r FROM cells) x GROUP BY author_id, slice_id, year_start, year_end""",
    "ordered": "SELECT author_id, topic_name, frequency, DENSE_RANK() OVER (PARTITION BY author_id ORDER BY slice_id) AS i FROM cells",
    "norms": "SELECT author_id, i, sqrt(SUM(CAST(frequency AS DOUBLE) * frequency)) AS norm FROM ordered GROUP BY 1, 2",
    "cont": """SELECT k.author_id, COALESCE(avg(c), 0.0) AS avg_continuity, COALESCE(avg(1 - c), 0.0) AS avg_drift, COALESCE(max(1 - c), 0.0) AS max_drift
        FROM (SELECT DISTINCT author_id FROM cells) k LEFT JOIN (
          SELECT a.author_id, COALESCE(d.dot, 0) / (a.norm * b.norm) AS c FROM norms a JOIN norms b ON b.author_id = a.author_id AND b.i = a.i + 1
          LEFT JOIN (SELECT x.author_id, x.i, SUM(CAST(x.frequency AS DOUBLE) * y.frequency) AS dot FROM ordered x JOIN ordered y ON y.author_id = x.author_id AND y.topic_name = x.topic_name AND y.i = x.i + 1 GROUP BY 1, 2) d
            ON d.author_id = a.author_id AND d.i = a.i) z USING (author_id) GROUP BY 1""",
    "prod": """SELECT author_id, COALESCE(regr_slope(y, x), 0.0) AS productivity_slope, CASE WHEN MIN(y) = MAX(y) THEN 0.0 ELSE COALESCE(regr_r2(y, x), 0.0) END AS productivity_r2
        FROM (SELECT author_id, CAST(pub_count AS DOUBLE) AS y, CAST(ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY slice_id) - 1 AS DOUBLE) AS x FROM meta) q GROUP BY 1""",
    "breadth": "SELECT author_id, COUNT(*) AS n_slices, MIN(year_start) AS first_slice_year, MAX(year_start) AS last_slice_year, avg(n_topics_active) AS topic_breadth FROM meta GROUP BY 1",
    "feat_b": """SELECT b.author_id, b.n_slices, b.first_slice_year, b.last_slice_year, round(c.avg_continuity, 4) AS avg_continuity, round(c.avg_drift, 4) AS avg_drift, round(c.max_drift, 4) AS max_drift,
        round(p.productivity_slope, 4) AS productivity_slope, round(p.productivity_r2, 4) AS productivity_r2, round(b.topic_breadth, 4) AS topic_breadth,
        m.name, m.total_pubs, m.career_span, m.active_years, m.recency_ratio, m.first_year, m.last_year
        FROM breadth b JOIN cont c USING (author_id) JOIN prod p USING (author_id) LEFT JOIN rmap m USING (author_id)""",
    "ta": "SELECT t.* FROM t2 t JOIN rmap m ON m.author_id = t.author_id AND m.regime = 'A'",
    "vec_a": """SELECT author_id, topic_name, s / SUM(s) OVER w AS weight_slow, f / SUM(f) OVER w AS weight_fast, r / SUM(r) OVER w AS weight_raw
        FROM (SELECT author_id, topic_name, SUM(frequency * exp(-0.1 * (2001 - year))) AS s, SUM(frequency * exp(-0.3 * (2001 - year))) AS f, SUM(CAST(frequency AS DOUBLE)) AS r FROM ta GROUP BY 1, 2) x
        WINDOW w AS (PARTITION BY author_id)""",
    "ent": """SELECT author_id, CASE WHEN COUNT(*) > 1 THEN SUM(-weight_slow * ln(weight_slow)) / (SELECT ln(COUNT(DISTINCT topic_name)) FROM ta) ELSE 0.0 END AS expertise_entropy FROM vec_a GROUP BY 1""",
    "act": """SELECT author_id, CAST(SUM(year * frequency) AS DOUBLE) / SUM(frequency) AS weighted_year, CAST(SUM(CASE WHEN 2001 - year <= 2 THEN frequency ELSE 0 END) AS BIGINT) AS recent_pubs,
        CAST(SUM(frequency) AS BIGINT) AS tensor_total, COUNT(DISTINCT topic_name) AS n_active_topics FROM ta GROUP BY 1""",
    "shift": """SELECT s.author_id, s.topic_name AS dominant_topic, r.topic_name AS raw_topic, CAST(s.topic_name <> r.topic_name AS INTEGER) AS topic_shift
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY round(weight_slow, 9) DESC, topic_name) AS k FROM vec_a) s
        JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY round(weight_raw, 9) DESC, topic_name) AS k FROM vec_a) r ON r.author_id = s.author_id AND r.k = 1 AND s.k = 1""",
    "feat_a": """SELECT s.author_id, s.dominant_topic, s.topic_shift, round(e.expertise_entropy, 4) AS expertise_entropy, round(a.weighted_year, 2) AS weighted_year, a.recent_pubs, a.tensor_total, a.n_active_topics,
        m.name, m.total_pubs, m.career_span, m.active_years, m.recency_ratio, m.first_year, m.last_year, m.year_coverage
        FROM shift s JOIN ent e USING (author_id) JOIN act a USING (author_id) LEFT JOIN rmap m USING (author_id)""",
    "posn": """SELECT author_id, kg_papers, n_first, n_middle, n_last, n_sole, round(CAST(n_first AS DOUBLE) / kg_papers, 4) AS pct_first, round(CAST(n_middle AS DOUBLE) / kg_papers, 4) AS pct_middle,
        round(CAST(n_last AS DOUBLE) / kg_papers, 4) AS pct_last, round(CAST(n_sole AS DOUBLE) / kg_papers, 4) AS pct_sole, least(1.0, kg_papers / 5.0::DOUBLE) AS pos_reliable
        FROM (SELECT author_id, COUNT(*) AS kg_papers, COUNT(*) FILTER (WHERE pos = 1) AS n_first, COUNT(*) FILTER (WHERE pos <> 1 AND pos <> n_authors) AS n_middle,
          COUNT(*) FILTER (WHERE pos = n_authors) AS n_last, COUNT(*) FILTER (WHERE n_authors = 1) AS n_sole FROM fx_authorship GROUP BY 1) x""",
    "rin": """SELECT m.author_id, m.name, m.regime, m.career_span, m.total_pubs, m.total_cit, COALESCE(p.pct_first, 0.0) AS pct_first, COALESCE(p.pct_middle, 0.0) AS pct_middle, COALESCE(p.pct_last, 0.0) AS pct_last,
        COALESCE(p.pos_reliable, 0.0) AS pos_reliable, m.recency_ratio, ln(1 + m.career_span) AS log_span, ln(1 + m.total_pubs) AS log_pubs, ln(1 + m.active_years) AS log_active, COALESCE(b.productivity_slope, 0.0) AS productivity_slope
        FROM rmap m LEFT JOIN posn p USING (author_id) LEFT JOIN feat_b b USING (author_id)""",
    "stat": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in ("pct_first", "pct_middle", "pct_last", "recency_ratio", "log_span", "log_pubs", "log_active", "productivity_slope")) + " FROM rin",
    "z": "SELECT rin.*, " + ", ".join(f"CASE WHEN COALESCE(round(s_{c}, 12), 0) = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END AS z_{c}" for c in ("pct_first", "pct_middle", "pct_last", "recency_ratio", "log_span", "log_pubs", "log_active", "productivity_slope")) + " FROM rin CROSS JOIN stat",
    "sc": """SELECT *, pos_reliable * (z_pct_first + z_recency_ratio + 0.5 * z_productivity_slope - 0.5 * z_log_span - 0.5 * z_log_pubs - 0.5 * z_pct_last) + (1 - pos_reliable) * (z_recency_ratio - 0.5 * z_log_span - 0.5 * z_log_pubs) AS score_emerging,
        pos_reliable * (z_pct_middle + 0.5 * z_log_active) + (1 - pos_reliable) * (0.5 * z_log_active) AS score_collaborating,
        pos_reliable * (z_pct_last + z_log_span + 0.5 * z_log_pubs + 0.5 * z_log_active - 0.5 * z_recency_ratio - 0.5 * z_productivity_slope) + (1 - pos_reliable) * (z_log_span + 0.5 * z_log_pubs + 0.5 * z_log_active - 0.5 * z_recency_ratio) AS score_supervising FROM z""",
    "pr": """SELECT *, ee / (ee + ec + es) AS pe, ec / (ee + ec + es) AS pc, es / (ee + ec + es) AS ps FROM (
        SELECT *, exp(score_emerging - greatest(score_emerging, score_collaborating, score_supervising)) AS ee, exp(score_collaborating - greatest(score_emerging, score_collaborating, score_supervising)) AS ec,
          exp(score_supervising - greatest(score_emerging, score_collaborating, score_supervising)) AS es FROM sc) q""",
    "roled": """SELECT author_id, name, regime, career_span, total_cit, round_even(pe, 4) AS prob_emerging, round_even(pc, 4) AS prob_collaborating, round_even(ps, 4) AS prob_supervising, round_even(greatest(pe, pc, ps), 4) AS role_confidence,
        CASE WHEN round(pe, 9) >= round(pc, 9) AND round(pe, 9) >= round(ps, 9) THEN 'emerging' WHEN round(pc, 9) >= round(ps, 9) THEN 'collaborating' ELSE 'supervising' END AS dominant_role FROM pr""",
    "g": f"""SELECT {B}author/' || author_id AS s, 'rdf:type' AS p, 'ex:Author' AS o FROM fx_author
        UNION ALL SELECT {B}author/' || author_id, 'dcterms:title', name FROM fx_author
        UNION ALL SELECT {B}author/' || author_id, 'ex:affiliatedWith', {B}org/' || org FROM fx_author
        UNION ALL SELECT DISTINCT {B}org/' || org, 'dcterms:title', org FROM fx_author
        UNION ALL SELECT {B}paper/' || paper_id, 'rdf:type', 'ex:Paper' FROM fx_paper
        UNION ALL SELECT {B}paper/' || paper_id, 'dcterms:title', 'Day ' || paper_id FROM fx_paper
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:publicationYear', CAST(year AS VARCHAR) FROM fx_paper
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasAuthor', {B}author/' || author_id FROM fx_authorship
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasSecondOrderTopic', {B}topic/' || topic FROM fx_t2
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasThirdOrderTopic', {B}topic/' || topic FROM fx_t3
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasSubTopic', {B}topic/' || topic FROM fx_t3
        UNION ALL SELECT {B}topic/' || main_topic, 'ex:hasSubTopic', {B}topic/' || subtopic FROM fx_parent
        UNION ALL SELECT DISTINCT {B}topic/' || main_topic, 'rdf:type', 'ex:Topic' FROM fx_parent
        UNION ALL SELECT DISTINCT {B}topic/' || main_topic, 'dcterms:title', main_topic FROM fx_parent
        UNION ALL SELECT DISTINCT {B}topic/' || subtopic, 'dcterms:title', subtopic FROM fx_parent
        UNION ALL SELECT {B}author/' || author_id, 'ex:totalPubs', CAST(total_pubs AS VARCHAR) FROM prof
        UNION ALL SELECT {B}author/' || author_id, 'ex:totalCitations', CAST(CAST(floor(n_citation) AS BIGINT) AS VARCHAR) FROM prof JOIN fx_author USING (author_id)
        UNION ALL SELECT {B}author/' || author_id, 'ex:firstPublicationYear', CAST(first_year AS VARCHAR) FROM prof
        UNION ALL SELECT {B}author/' || author_id, 'ex:lastPublicationYear', CAST(last_year AS VARCHAR) FROM prof
        UNION ALL SELECT {B}author/' || author_id, 'ex:activeYears', CAST(active_years AS VARCHAR) FROM prof
        UNION ALL SELECT {B}authorship/' || paper_id || '_' || author_id, 'rdf:type', 'ex:Authorship' FROM fx_authorship
        UNION ALL SELECT {B}authorship/' || paper_id || '_' || author_id, 'ex:paper', {B}paper/' || paper_id FROM fx_authorship
        UNION ALL SELECT {B}authorship/' || paper_id || '_' || author_id, 'ex:author', {B}author/' || author_id FROM fx_authorship
        UNION ALL SELECT {B}authorship/' || paper_id || '_' || author_id, 'ex:authorPosition', CAST(pos AS VARCHAR) FROM fx_authorship
        UNION ALL SELECT {B}authorship/' || paper_id || '_' || author_id, 'ex:authorCount', CAST(n_authors AS VARCHAR) FROM fx_authorship
        UNION ALL SELECT DISTINCT {B}paper/' || paper_id, 'ex:authorCount', CAST(n_authors AS VARCHAR) FROM fx_authorship
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasFirstAuthor', {B}author/' || author_id FROM fx_authorship WHERE pos = 1
        UNION ALL SELECT {B}paper/' || paper_id, 'ex:hasLastAuthor', {B}author/' || author_id FROM fx_authorship WHERE pos = n_authors""",
    "gr": f"""SELECT * FROM g UNION ALL SELECT {B}author/' || author_id, 'ex:probEmerging', printf('%.4f', prob_emerging) FROM roled
        UNION ALL SELECT {B}author/' || author_id, 'ex:probCollaborating', printf('%.4f', prob_collaborating) FROM roled
        UNION ALL SELECT {B}author/' || author_id, 'ex:probSupervising', printf('%.4f', prob_supervising) FROM roled
        UNION ALL SELECT {B}author/' || author_id, 'ex:dominantRole', dominant_role FROM roled""",
    "titles": "SELECT s, MIN(o) AS title FROM g WHERE p = 'dcterms:title' GROUP BY s",
    "cos": f"SELECT doc_id, text, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {V}) AS c FROM fx_doc",
    "cand": "SELECT * FROM cos ORDER BY round(c, 12) DESC, doc_id LIMIT 75",
    "lexi": f"SELECT doc_id, {jac(KW, 'text')} AS j, {lev(KW, 't')} AS l FROM (SELECT *, {PLAIN.format(x='text')} AS t FROM cand) x",
    "fusein": "SELECT c.doc_id, c.c, COALESCE(x.j, 0.0) AS j, COALESCE(x.l, 0.0) AS l FROM cos c LEFT JOIN lexi x USING (doc_id)",
    "bounds": "SELECT MIN(c) AS c0, MAX(c) AS c1, MIN(j) AS j0, MAX(j) AS j1, MIN(l) AS l0, MAX(l) AS l1 FROM fusein",
    "scaled": "SELECT doc_id, "
    + ", ".join(f"CASE WHEN {x}1 - {x}0 < 1e-8 THEN 0.0 ELSE ({x} - {x}0) / ({x}1 - {x}0 + 1e-8) END AS {x}s" for x in "cjl")
    + " FROM fusein CROSS JOIN bounds",
    "fused": "SELECT doc_id, round(0.5 * cs + 0.35 * js + 0.15 * ls, 9) AS score FROM scaled",
    "hyb": "SELECT doc_id, score FROM fused WHERE score >= 0.3 OR (SELECT MAX(score) FROM fused) < 0.3 ORDER BY score DESC, doc_id LIMIT 25",
    "rpapers": "SELECT paper_id, CAST(ROW_NUMBER() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT d.paper_id, h.score, h.doc_id, ROW_NUMBER() OVER (PARTITION BY d.paper_id ORDER BY h.score DESC, h.doc_id) AS k FROM hyb h JOIN fx_doc d USING (doc_id)) x WHERE k = 1",
    "cands": "SELECT author_id, CAST(ROW_NUMBER() OVER (ORDER BY rank, pos, author_id) - 1 AS INTEGER) AS pos FROM (SELECT a.author_id, r.rank, a.pos, ROW_NUMBER() OVER (PARTITION BY a.author_id ORDER BY r.rank, a.pos) AS k FROM rpapers r JOIN fx_authorship a USING (paper_id)) x WHERE k = 1",
    "tcands": "SELECT * FROM cands WHERE author_id IN (SELECT author_id FROM fx_author WHERE tag IS NOT NULL)",
    "pool": """SELECT author_id, pos, role, prob, CAST(ROW_NUMBER() OVER (PARTITION BY role ORDER BY prob DESC, pos) AS INTEGER) AS rn FROM (
        SELECT c.author_id, c.pos, COALESCE(r.dominant_role, '{role}') AS role, CASE r.dominant_role WHEN 'emerging' THEN prob_emerging WHEN 'collaborating' THEN prob_collaborating WHEN 'supervising' THEN prob_supervising ELSE {prob} END AS prob
        FROM {who} c LEFT JOIN roled r USING (author_id)) x""",
    "sizes": "SELECT v.role, v.ord, COUNT(p.author_id) AS size FROM (VALUES ('emerging', 0), ('collaborating', 1), ('supervising', 2)) v(role, ord) LEFT JOIN pool p ON p.role = v.role GROUP BY 1, 2",
    "quotas": """SELECT *, SUM(need) OVER (ORDER BY ord) AS hi, SUM(need) OVER (ORDER BY ord) - need AS lo FROM (SELECT *, greatest(quota - size, 0) AS need FROM (
        SELECT *, (SELECT SUM(size) FROM sizes) // 3 + CASE WHEN ROW_NUMBER() OVER (ORDER BY size DESC, ord) <= (SELECT SUM(size) FROM sizes) % 3 THEN 1 ELSE 0 END AS quota FROM sizes) a) b""",
    "ranking": """SELECT author_id, role, prob, CAST(ROW_NUMBER() OVER (ORDER BY seg, extra, place) AS INTEGER) AS rank FROM (
        SELECT p.author_id, p.role, p.prob, q.ord AS seg, 0 AS extra, p.rn AS place FROM pool p JOIN quotas q USING (role) WHERE p.rn <= q.quota
        UNION ALL SELECT s.author_id, s.role, s.prob, q.ord, 1, s.e FROM (SELECT p.*, ROW_NUMBER() OVER (ORDER BY q.ord, p.rn) - 1 AS e FROM pool p JOIN quotas q USING (role) WHERE p.rn > q.quota) s
        JOIN quotas q ON q.need > 0 AND s.e >= q.lo AND s.e < q.hi) x""",
    "quotaed": """SELECT author_id, role, prob, CAST(ROW_NUMBER() OVER (ORDER BY ord, rn) AS INTEGER) AS rank FROM pool JOIN (
    SELECT *, take + greatest(0, least(size - take, shortfall - before)) AS lim FROM (SELECT *, SUM(quota - take) OVER () AS shortfall, SUM(size - take) OVER (ORDER BY ord) - (size - take) AS before FROM (
    SELECT *, least(size, quota) AS take FROM (SELECT *, (SELECT SUM(size) FROM sizes) // 3 AS quota FROM sizes) a) b) c) q USING (role) WHERE rn <= lim""",
    "pred": "SELECT t.tag AS query, r.author_id AS id, r.rank FROM ranking r CROSS JOIN (SELECT DISTINCT tag FROM fx_author WHERE tag IS NOT NULL) t WHERE r.rank <= 100",
    "rel": "SELECT p.query, p.rank, CASE WHEN a.author_id IS NULL THEN 0 ELSE 1 END AS rel FROM pred p LEFT JOIN fx_author a ON a.author_id = p.id AND a.tag = p.query",
    "rel_all": "SELECT t.tag AS query, r.rank, CASE WHEN a.author_id IS NULL THEN 0 ELSE 1 END AS rel FROM ranking r CROSS JOIN (SELECT DISTINCT tag FROM fx_author WHERE tag IS NOT NULL) t LEFT JOIN fx_author a ON a.author_id = r.author_id AND a.tag = t.tag",
    "ngt": "SELECT tag AS query, COUNT(*) AS n FROM fx_author WHERE tag IS NOT NULL GROUP BY 1",
    "ap": "SELECT query, CASE WHEN SUM(rel) > 0 THEN SUM(CASE WHEN rel = 1 THEN CAST(h AS DOUBLE) / rank ELSE 0.0 END) / SUM(rel) ELSE 0.0 END AS value FROM (SELECT *, SUM(rel) OVER (PARTITION BY query ORDER BY rank) AS h FROM rel WHERE rank <= 10) x GROUP BY 1",
    "rr": "SELECT query, COALESCE(CAST(1 AS DOUBLE) / MIN(CASE WHEN rel = 1 THEN rank END), 0.0) AS value FROM rel WHERE rank <= 10 GROUP BY 1",
    "p5": "SELECT query, avg(rel) AS value FROM rel WHERE rank <= 5 GROUP BY 1",
    "p10": "SELECT query, avg(rel) AS value FROM rel WHERE rank <= 10 GROUP BY 1",
    "nd5": "SELECT r.query, SUM(rel / log2(rank + 1)) / (SELECT SUM(1 / log2(i + 1)) FROM range(1, 1 + least(5, any_value(g.n))) t(i)) AS value FROM rel r JOIN ngt g USING (query) WHERE rank <= 5 GROUP BY 1",
    "nd10": "SELECT r.query, SUM(rel / log2(rank + 1)) / (SELECT SUM(1 / log2(i + 1)) FROM range(1, 1 + least(10, any_value(g.n))) t(i)) AS value FROM rel r JOIN ngt g USING (query) WHERE rank <= 10 GROUP BY 1",
}


P3 = "printf('%.3f', round({}, 4) + 1e-9)"
ROLE = (
    "'Expert Role: ' || CASE dominant_role WHEN 'emerging' THEN 'Emerging Expert' WHEN 'collaborating' THEN 'Collaborating Expert' ELSE 'Supervising Expert' END || ' (confidence=' || "
    + P3.format("CASE dominant_role WHEN 'emerging' THEN prob_emerging WHEN 'collaborating' THEN prob_collaborating ELSE prob_supervising END")
    + " || ')' || chr(10) || "
)
SCORES = "'Role Scores: Emerging=' || " + P3.format("prob_emerging") + " || ' | Collaborating=' || " + P3.format("prob_collaborating") + " || ' | Supervising=' || " + P3.format("prob_supervising")

CTES["ragt"] = f"""SELECT 'http://example.org/author/' || a.author_id AS author, concat_ws(chr(10), 'Author: ' || a.name, 'Papers: ' || p.v, 'Subtopics: ' || t.v, 'Coauthors: ' || c.v, r.v) AS text FROM fx_author a
    LEFT JOIN (SELECT author_id, string_agg('Day ' || paper_id, '; ' ORDER BY k) AS v FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY paper_id) AS k FROM fx_authorship) x WHERE k <= 10 GROUP BY 1) p ON p.author_id = a.author_id
    LEFT JOIN (SELECT author_id, string_agg(topic, ', ' ORDER BY topic) AS v FROM (SELECT DISTINCT author_id, topic FROM fx_authorship JOIN fx_t3 USING (paper_id)) x GROUP BY 1) t ON t.author_id = a.author_id
    LEFT JOIN (SELECT author_id, string_agg(name || ' (' || n || ')', ', ' ORDER BY k) AS v FROM (
      SELECT x.author_id, f.name, n, ROW_NUMBER() OVER (PARTITION BY x.author_id ORDER BY n DESC, CAST(co AS VARCHAR)) AS k FROM (SELECT a.author_id, b.author_id AS co, COUNT(*) AS n FROM fx_authorship a JOIN fx_authorship b ON b.paper_id = a.paper_id AND b.author_id <> a.author_id GROUP BY 1, 2 HAVING COUNT(*) >= 2) x
      JOIN fx_author f ON f.author_id = x.co) y WHERE k <= 10 GROUP BY 1) c ON c.author_id = a.author_id
    LEFT JOIN (SELECT author_id, {ROLE}{SCORES} AS v FROM roled) r ON r.author_id = a.author_id"""


def compose(select: str, **fills: str) -> str:
    """`select` with the expressions that it names, directly or through others, in order of definition."""
    needed: set[str] = set()
    bodies = {k: v.format(**fills) if k == "pool" else v for k, v in CTES.items()}

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                visit(bodies[name])

    visit(select)
    parts = [f"{k} AS ({' '.join(bodies[k].split())})" for k in CTES if k in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + " ".join(select.split())
