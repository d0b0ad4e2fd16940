"""Models behind one interface, with a deterministic lexical stand-in for each.

A real model is any object with the method's signature; the operators call it batch by batch inside
`mapInPandas`, where it is built once per worker by the given factory. No weights ship with this library:
figures got with the stand-ins say nothing of a model's quality.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T


class PointScorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]:
        """Relevance of each text, 0 to 1."""


class Answerer(Protocol):
    def answer(self, prompts: list[str]) -> list[str]:
        """A generated text for each prompt."""


class PairJudge(Protocol):
    def prefers(self, query: str, pairs: list[tuple[str, str]]) -> list[bool]:
        """Whether the first text of each pair is the better one; unclear answers are False."""


class Lexical:
    """All surfaces by Jaccard similarity of lower-cased words."""

    def _one(self, query: str, text: str) -> float:
        a, b = set(query.lower().split()), set((text or "").lower().split())
        return len(a & b) / len(a | b) if a | b else 0.0

    def score(self, query: str, texts: list[str]) -> list[float]:
        return [self._one(query, t) for t in texts]

    def prefers(self, query: str, pairs: list[tuple[str, str]]) -> list[bool]:
        return [self._one(query, a) > self._one(query, b) for a, b in pairs]

    def answer(self, prompts: list[str]) -> list[str]:
        """What each prompt asks for, made of its own lines: an object of two fields, yes or no, or its last line."""
        return [self._said(p.splitlines() or [""]) for p in prompts]

    def _said(self, lines: list[str]) -> str:
        asked = lines[0]
        if fields := re.search(r"fields (\w+) and (\w+)", asked):
            return json.dumps(dict(zip(fields.groups(), (lines[1], lines[-1]), strict=True)), ensure_ascii=False)
        if "yes or no" in asked:
            query, rest = (set(re.findall(r"[^\s,;]+", x.lower())) for x in (lines[1].removeprefix("Query:"), " ".join(lines[2:])))
            return "Answer: yes" if query & rest else "Answer: no"
        if lines[-1] == "OUTPUT:":
            return "\n".join([*lines, " ".join(lines[1:-1]), "", "And that is all."])
        return lines[-1]


def prompt(query: str, text: str) -> str:
    """What a yes-or-no model is asked about one text."""
    return f"Does the document answer the query? Reply yes or no.\nQuery: {query}\nDocument: {text}"


VALIDATION = "Is this author an expert on the query? Reply yes or no, after the word Answer and a colon.\nQuery: %s\nPapers: %s\nTopics: %s"
EXPANSION = "Put the search query between the lines in other words, in one paragraph.\n%s\nOUTPUT:"


def validated(authors: DataFrame, query: str, model: Callable[[], Answerer] | None = None, key: str = "author") -> DataFrame:
    """The rows of authors(key, papers and topics: arrays of titles) that a model takes for experts on the query."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None"))
    asked = authors.select(key, F.format_string(VALIDATION, F.lit(query), listed("papers"), listed("topics")).alias("prompt"))
    said = generated(asked, model or Lexical, key=key)
    return authors.join(said.where(T.says_yes(F.col("answer"))).select(key), key, "left_semi")


def expanded(queries: DataFrame, text: str = "text", key: str = "key", model: Callable[[], Answerer] | None = None) -> DataFrame:
    """(key, expanded): each query in a model's words; the query itself without a model or where it says nothing."""
    if model is None:
        return queries.select(key, F.col(text).alias("expanded"))
    said = generated(queries.select(key, F.format_string(EXPANSION, text).alias("prompt")), model, key=key)
    return queries.join(said, key, "left").select(key, F.coalesce(F.nullif(T.expansion(F.col("answer")), F.lit("")), text).alias("expanded"))


def rerank(docs: DataFrame, query: str, k: int | None = None, text: str = "text", key: str = "doc_id", scorer: Callable[[], PointScorer] | None = None) -> DataFrame:
    """(key, score), best first. Without a scorer the lexical stand-in runs in the JVM."""
    if scorer is None:
        scored = docs.select(key, T.jaccard(F.lit(query), F.col(text)).alias("score"))
    else:
        kind = docs.schema[key].dataType.simpleString()

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = scorer()
            for p in parts:
                yield pd.DataFrame({key: p[key], "score": pd.Series(model.score(query, p[text].fillna("").tolist()), dtype="float64", index=p.index)})

        scored = docs.select(key, text).mapInPandas(run, f"{key} {kind}, score double")
    ranked = scored.orderBy(F.desc(F.round("score", 9)), key)
    return ranked if k is None else ranked.limit(k)


def relevant(docs: DataFrame, query: str, threshold: float = 0.3, **how) -> DataFrame:
    """(key, score) of the texts that score over the threshold."""
    return rerank(docs, query, **how).where(F.col("score") > threshold)


def scored_by_answer(answers: DataFrame, column: str = "answer", threshold: float = 70) -> DataFrame:
    """Adds `score`, the whole part of the first number from 0 to 100 in an answer, and keeps rows at or over the threshold."""
    return answers.withColumn("score", F.floor(T.number_0_100(F.col(column)))).where(F.col("score") >= threshold)


def _inserted(items: list, better: Callable) -> list:
    """Each item goes before the first of those in place that it beats, else to the end."""
    out: list = []
    for x in items:
        out.insert(next((i for i, y in enumerate(out) if better(x, y)), len(out)), x)
    return out


def _merged(items: list, better: Callable) -> list:
    """Merge sort by halves; of two heads the left one goes first only if it is the better."""
    if len(items) < 2:
        return items
    half = len(items) // 2
    left, right, out = _merged(items[:half], better)[::-1], _merged(items[half:], better)[::-1], []
    while left and right:
        out.append((left if better(left[-1], right[-1]) else right).pop())
    return out + left[::-1] + right[::-1]


def ordered(
    docs: DataFrame, query: str, by: list, k: int | None = None, method: str = "insertion", batch: int = 50, most: int = 75, text: str = "text", key: str = "doc_id", judge: Callable[[], PairJudge] = Lexical
) -> DataFrame:
    """(key, rank): the first k rows by the columns `by`, put in order by a judge of two.

    method "insertion" puts each row before the first that it beats; "merge" sorts batches of `batch` by
    merging and then, by merging again, all of them. A judge need not be consistent, so the result is that of
    this very sequence of comparisons. It runs in one task, on a list of at most `most`; a longer one is an error.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("at")
        if len(rows) > most:
            raise ValueError(f"more than {most} texts to put in order")
        model, items = judge(), list(zip(rows[key], rows["t"], strict=True))
        better = lambda a, b: model.prefers(query, [(a[1], b[1])])[0]
        if method == "insertion":
            items = _inserted(items, better)
        else:
            items = _merged([x for a in range(0, len(items), batch) for x in _merged(items[a : a + batch], better)], better)
        yield pd.DataFrame({key: [i for i, _ in items], "rank": range(1, len(items) + 1)})

    short = docs.orderBy(*by).limit(most + 1 if k is None else k)  # a short list: one task numbers and compares it
    numbered = short.select(key, F.coalesce(text, F.lit("")).alias("t"), F.row_number().over(Window.orderBy(*by)).alias("at"))
    return numbered.coalesce(1).mapInPandas(run, f"{key} {kind}, rank int")


def pairwise(docs: DataFrame, query: str, k: int | None = None, most: int = 75, text: str = "text", key: str = "doc_id", judge: Callable[[], PairJudge] = Lexical) -> DataFrame:
    """(key, wins, rank): each of a short list against each other, ranked by wins, then by key.

    The list is a retrieval result of at most `most` rows; a longer one is an error, as its pairs grow
    with the square. Pairs are judged in parallel, not one by one inside a sort.
    """
    short = docs.select(key, F.coalesce(text, F.lit("")).alias("t")).limit(most + 1)
    checked = short.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("t", F.when(F.col("n") <= most, F.col("t")).otherwise(F.raise_error(F.lit(f"more than {most} texts to compare in pairs"))))
    a = checked.select(F.col(key).alias("a"), F.col("t").alias("ta"))
    b = checked.select(F.col(key).alias("b"), F.col("t").alias("tb"))
    kind = docs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = judge()
        for p in parts:
            first = model.prefers(query, list(zip(p["ta"], p["tb"], strict=True)))
            yield pd.DataFrame({key: [x if w else y for x, y, w in zip(p["a"], p["b"], first, strict=True)], "wins": 1})

    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    wins = pairs.mapInPandas(run, f"{key} {kind}, wins int").groupBy(key).agg(F.sum("wins").alias("wins"))
    ranked = checked.select(key).join(wins, key, "left").na.fill(0, ["wins"]).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("wins"), key)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def generated(prompts: DataFrame, model: Callable[[], Answerer] = Lexical, prompt: str = "prompt", key: str = "key") -> DataFrame:
    """(key, answer)"""
    kind = prompts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for p in parts:
            yield pd.DataFrame({key: p[key], "answer": m.answer(p[prompt].fillna("").tolist())})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string")


def embedded(texts: DataFrame, embed: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, embedding) by any function from texts to vectors, built once per worker."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = embed()
        for p in parts:
            yield pd.DataFrame({key: p[key], "embedding": [list(map(float, v)) for v in f(p[text].fillna("").tolist())]})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")
