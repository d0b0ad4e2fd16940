"""Scalar functions over text and identifiers, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Our own list of English function words: articles, pronouns, prepositions, conjunctions, auxiliaries and plain adverbs.
STOPWORDS = tuple(
    """
    a an the this that these those some any no none each every either neither both all few many much more most several such other another own same
    i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours ourselves
    they them their theirs themselves who whom whose which what whoever whatever whichever one ones
    of in on at by for from to into onto with without within about above across after against along among around as before behind below beneath
    beside besides between beyond but despite down during except inside like near off out outside over past per since than through throughout
    till toward towards under underneath until up upon via
    and or nor so yet if unless because although though while whereas whether when whenever where wherever why how
    am is are was were be been being have has had having do does did doing done will would shall should can could may might must ought
    not only also too very just even still again ever never always often then there here now once quite rather almost
    aren't can't couldn't didn't doesn't don't hadn't hasn't haven't isn't mustn't shan't shouldn't wasn't weren't won't wouldn't
    i'm i've i'll i'd you're you've you'll you'd he's he'll he'd she's she'll she'd it's it'll we're we've we'll we'd they're they've they'll they'd
    that's there's here's what's who's let's
    """.split()
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of non-space; none for null. Trimming first leaves split no empty token, so no lambda is needed."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct lower-cased tokens; 0 if both are empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(union, F.lit(1)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if either is empty or null. Case counts."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: What two tags are compared without. Quotes vanish, long dashes become plain ones, and any run of
#: characters outside the alphabet of tags is one space.
QUOTES, DASHES, NO_TAG = "‘’'", "–—", "[^0-9a-z-]+"


def normalize(text: Column) -> Column:
    """A tag for comparison: compatibility form, plain dashes, no quotes, lower case, only a-z, 0-9, dash and single spaces.

    Null becomes empty. Only non-ASCII text passes through Python.
    """
    s = F.coalesce(text, F.lit(""))
    s = F.lower(F.when(s.rlike(r"[^\x00-\x7F]"), _nfkc(s)).otherwise(s))
    return F.trim(F.regexp_replace(F.translate(s, DASHES + QUOTES, "-" * len(DASHES)), NO_TAG, " "))


def is_stopword(word: Column) -> Column:
    return F.lower(F.trim(word)).isin(*STOPWORDS)


def without_stopwords(text: Column) -> Column:
    """The words of a text that are no stop words, joined by single spaces, in their own case."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    return F.array_join(words, " ")


def keywords(query: Column) -> Column:
    """A query, or a model's keywords for it, without square brackets and stop words."""
    return without_stopwords(F.translate(query, "[]", ""))


def says_yes(answer: Column) -> Column:
    """Whether an answer says so; an unclear one doesn't, nor does none."""
    return F.coalesce(F.lower(answer).contains("answer: yes"), F.lit(False))


def expansion(generated: Column, instruction: str = "") -> Column:
    """The wording that a model gave: the first paragraph after its last mark of output, without the instruction."""
    said = F.element_at(F.split(generated, "OUTPUT:"), -1)
    said = F.replace(said, F.lit(instruction), F.lit("")) if instruction else said
    return F.trim(F.element_at(F.split(F.regexp_replace(said, r"^\s+", ""), r"\n\n"), 1))


def sentences(text: Column) -> Column:
    """Split after . ! or ? where white space and a capital A-Z follow."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])")


#: Fixed value: the form of a score in an answer, 0 to 100 with or without decimals.
SCORE = r"\b(100(?:\.0+)?|[1-9]?\d(?:\.\d+)?)\b"


def number_0_100(text: Column) -> Column:
    """The first stand-alone number from 0 to 100, else null."""
    found = F.regexp_extract(text, SCORE, 1)
    return F.when(found != "", found).try_cast("double")


def year(text: Column, first: int = 1950, last: int = 2019) -> Column:
    """The first four digits in a row as a year within bounds, else null."""
    y = F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"\d{4}", 0).try_cast("int")
    return F.when(y.between(first, last), y)


def number_or(text: Column, default: float = 0) -> Column:
    """The text as a number, or `default` where it is none."""
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def slug(text: Column, longest: int = 80) -> Column:
    """Runs of other than A-Z, a-z, 0-9 as one underscore, none at the ends; for nothing left, 8 hex digits of the SHA-1."""
    s = F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(s == "", F.substring(F.sha1(text), 1, 8)).otherwise(s), 1, longest)


def json_or_raw(text: Column, schema: str) -> tuple[Column, Column]:
    """(parsed, raw): a JSON object, also inside a code fence, as a struct; where it is none, null and the text itself."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    parsed = F.when(F.try_parse_json(body).isNotNull() & body.startswith("{"), F.from_json(body, schema, {"mode": "PERMISSIVE"}))
    return parsed, F.when(parsed.isNull(), text)
