"""Document retrieval: cosine, BM25, and the hybrid of cosine, Jaccard and Levenshtein; expert candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V
from tessella.sources.store import written


def cosine_scores(docs: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return docs.withColumn("score", V.cosine(F.col(vector), V.literal(query)))


def cosine_threshold(docs: DataFrame, query: list[float], threshold: float = 0.3) -> DataFrame:
    return cosine_scores(docs, query).where(F.col("score") >= threshold)


def cosine_topk(docs: DataFrame, query: list[float], k: int = 25, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score) of the k most similar at or over the threshold; ties by id."""
    return cosine_threshold(docs, query, threshold).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(k)


def hybrid_candidates(docs: DataFrame, query: list[float], k: int = 25, multiple: int = 3) -> DataFrame:
    """(doc_id, cosine) of the multiple * k most similar, whatever their score."""
    scored = docs.select("doc_id", V.cosine(F.col("embedding"), V.literal(query)).alias("cosine"))
    return scored.orderBy(F.desc(F.round("cosine", 12)), "doc_id").limit(multiple * k)


def hybrid(
    docs: DataFrame, query: list[float], keyword: str, k: int = 25, threshold: float = 0.3, multiple: int = 3, weights: tuple[float, float, float] = (0.5, 0.35, 0.15)
) -> DataFrame:
    """(doc_id, score): cosine for all documents, Jaccard and Levenshtein for the best multiple * k of them.

    All three are min-max scaled over all documents, the lexical ones being 0 outside the candidates, and
    added by weight. What reaches the threshold is kept, or everything if nothing does; then the top k.
    The lexical measures see only the candidates, and only ids, one score and the bounds are shuffled.
    """
    kw = F.lit(keyword)
    scored = docs.select("doc_id", V.cosine(F.col("embedding"), V.literal(query)).alias("cosine"))
    best = scored.orderBy(F.desc(F.round("cosine", 12)), "doc_id").limit(multiple * k).select("doc_id")
    lexical = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id").select("doc_id", T.jaccard(kw, F.col("text")).alias("jaccard"), T.levenshtein_similarity(kw, F.col("text")).alias("levenshtein"))
    # At most multiple * k rows, so safe to broadcast.
    all_docs = scored.join(F.broadcast(lexical), "doc_id", "left").na.fill(0.0, ["jaccard", "levenshtein"])
    scaled = V.minmax(all_docs, {"cosine": "c", "jaccard": "j", "levenshtein": "l"})
    fused = scaled.select("doc_id", F.round(weights[0] * F.col("c") + weights[1] * F.col("j") + weights[2] * F.col("l"), 9).alias("score"))
    any_over = fused.agg(F.max("score").alias("__max"))
    kept = fused.crossJoin(F.broadcast(any_over)).where((F.col("score") >= threshold) | (F.col("__max") < threshold)).drop("__max")
    return kept.orderBy(F.desc("score"), "doc_id").limit(k)


def bm25(docs: DataFrame, query: str, k: int | None = 25, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """(doc_id, score) of documents that share a term with the query; a term counts as often as the query has it.

    One scan of the texts explodes all words inside generated code and keeps the query's, so other words
    are never shuffled; lengths come from a second, without an explosion.
    """
    asked = [t for t in query.lower().split() if t]
    if not asked:
        return docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    one = docs.select(F.size(T.tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    split = docs.select("doc_id", T.tokens(F.col(text)).alias("words"))
    hits = split.select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term")).where(F.col("term").isin(*asked))
    tf = written(hits.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "term_counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(asked) for x in (t, float(asked.count(t)))])[F.col("term")]
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(one))  # df: at most the query's terms
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = rows.groupBy("doc_id").agg(F.sum(times * part).alias("score"))
    return scored if k is None else scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)


def rank_documents(docs: DataFrame, citations: str = "n_citation") -> DataFrame:
    """The documents, most cited first; ties by id. A missing column is an error. A distributed sort, no numbering."""
    if citations not in docs.columns:
        raise ValueError(f"no column {citations}")
    return docs.orderBy(F.desc(citations), "doc_id")


def union_by_title(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("cosine", "llm")) -> DataFrame:
    """(title, doc_id, selected_by): documents of either list by trimmed title, with the least id and who chose them."""
    both = first.select(F.trim("title").alias("title"), "doc_id", F.lit(0).alias("by")).unionByName(second.select(F.trim("title").alias("title"), "doc_id", F.lit(1).alias("by")))
    grouped = both.groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.max((F.col("by") == 0).cast("int")).alias("a"), F.max((F.col("by") == 1).cast("int")).alias("b"))
    chosen = F.concat_ws(",", F.when(F.col("a") == 1, names[0]), F.when(F.col("b") == 1, names[1]))
    return grouped.select("title", "doc_id", chosen.alias("selected_by"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, pos): each key once, in order of its first place, numbered from 0. For one query's list: one task numbers it."""

    first = df.groupBy(key).agg(F.min(order).alias("first"))
    return first.select(key, (F.row_number().over(Window.orderBy("first", key)) - 1).alias("pos"))


def candidates(ranked: DataFrame, authorship: DataFrame) -> DataFrame:
    """(author_id, pos): the authors of ranked(paper_id, rank) papers in order of first appearance.

    Follows the few papers retrieved, never the whole authorship.
    """
    rows = authorship.join(F.broadcast(ranked.select("paper_id", "rank")), "paper_id")
    first = rows.groupBy("author_id").agg(F.min(F.struct("rank", "pos")).alias("first"))

    return first.select("author_id", (F.row_number().over(Window.orderBy("first.rank", "first.pos", "author_id")) - 1).alias("pos"))


def matched_papers(ranked: DataFrame, authorship: DataFrame) -> DataFrame:
    """(author_id, n_matched, best_rank) over retrieved papers."""
    return authorship.join(F.broadcast(ranked.select("paper_id", "rank")), "paper_id").groupBy("author_id").agg(F.count("*").alias("n_matched"), F.min("rank").alias("best_rank"))


def rank_by_citations(wanted: DataFrame, authors: DataFrame) -> DataFrame:
    """(author_id, n_citation, rank) of wanted(author_id), one query's candidates, that have a tag, most cited first; ties by id."""

    kept = authors.where("tag is not null").join(wanted.select("author_id").distinct(), "author_id", "left_semi")
    return kept.select("author_id", "n_citation", F.row_number().over(Window.orderBy(F.desc("n_citation"), "author_id")).alias("rank"))


