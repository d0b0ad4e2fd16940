"""Triples in and out: N-Triples and a Turtle subset, and Parquet partitioned by predicate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefixes of names in triples.
PREFIXES = {
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "dcterms:": "http://purl.org/dc/terms/",
    "xsd:": "http://www.w3.org/2001/XMLSchema#",
    "ex:": "http://example.org/schema#",
}
SCHEMA = "s string, p string, o string, kind string, dtype string"


def _renamed(c: Column, heads: dict[str, str]) -> Column:
    """c with the first of `heads` that it starts with replaced: one test for each, so c should be a plain column."""
    out = c
    for head, full in reversed(heads.items()):
        out = F.when(c.startswith(head), F.concat(F.lit(full), F.substring(c, len(head) + 1, 1 << 30))).otherwise(out)
    return out


def _long(c: Column, prefixes: dict[str, str]) -> Column:
    return _renamed(c, prefixes)


def _short(c: Column, prefixes: dict[str, str]) -> Column:
    return _renamed(c, {full: short for short, full in prefixes.items()})


_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def ntriples(g: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(value): one N-Triples line per triple."""
    prefixes = prefixes or PREFIXES
    lit = F.col("o")
    for a, b in _ESCAPES:
        lit = F.replace(lit, F.lit(a), F.lit(b))
    name = lambda c: F.concat(F.lit("<"), _long(F.col(c), prefixes), F.lit(">"))
    typed = F.when(F.col("dtype").isNull() | (F.col("dtype") == "xsd:string"), F.lit("")).otherwise(F.concat(F.lit("^^"), name("dtype")))
    obj = F.when(F.col("kind") == "uri", name("o")).otherwise(F.concat(F.lit('"'), lit, F.lit('"'), typed))
    return g.select(F.concat_ws(" ", name("s"), name("p"), obj, F.lit(".")).alias("value"))


#: Subject, predicate, the sign of an IRI, the IRI, the literal, its type. The literal's loop is possessive: it neither backtracks nor recurses.
_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:(<)([^>]*)>|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^>]*)>|@[A-Za-z0-9-]+)?)\s*\.\s*$'
#: What a line becomes in one match. Only the last part may hold the separator. It is shorter than any line that fits, so one that stays as it was doesn't fit.
_PARTS, _SEPARATOR = "$1>$2>$3$4>$6>$5", ">"


def parse_ntriples(lines: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """N-Triples lines (value) to triples; comments and blank lines are skipped, any other line that is none raises an error.

    A line is matched once; its parts are columns before anything is asked of them.
    """
    prefixes = prefixes or PREFIXES
    value = F.col("value")
    wanted = lines.where(~value.rlike(r"^\s*(#.*)?$")).select("value", F.regexp_replace("value", _LINE, _PARTS).alias("parts"))
    fits = F.when(F.col("parts") == value, F.raise_error(F.concat(F.lit("not an N-Triples line: "), "value"))).otherwise(F.split("parts", _SEPARATOR, 5))
    part = wanted.select(fits.alias("x")).select(*[F.col("x")[i].alias(n) for i, n in enumerate(("s", "p", "iri", "dtype", "text"))])
    is_uri = F.col("iri").startswith("<")
    text = F.replace(F.col("text"), F.lit("\\\\"), F.lit("\x00"))
    for a, b in _ESCAPES[1:]:
        text = F.replace(text, F.lit(b), F.lit(a))
    text = F.when(F.col("text").contains("\\"), F.replace(text, F.lit("\x00"), F.lit("\\"))).otherwise(F.col("text"))
    part = part.withColumn("iri", F.when(is_uri, F.substring("iri", 2, 1 << 30)))
    return part.select(
        _short(F.col("s"), prefixes).alias("s"), _short(F.col("p"), prefixes).alias("p"), F.when(F.col("iri").isNotNull(), _short(F.col("iri"), prefixes)).otherwise(text).alias("o"),
        F.when(F.col("iri").isNotNull(), "uri").otherwise("literal").alias("kind"),
        F.when(F.col("iri").isNull(), F.when(F.col("dtype") != "", _short(F.col("dtype"), prefixes)).otherwise("xsd:string")).alias("dtype"),
    )


def read_ntriples(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return parse_ntriples(spark.read.text(path), prefixes)


def write_ntriples(g: DataFrame, path: str, prefixes: dict[str, str] | None = None) -> None:
    ntriples(g, prefixes).write.mode("overwrite").text(path)


def write(g: DataFrame, path: str) -> None:
    """The native store: Parquet, one folder per predicate, so a bound predicate reads only its own."""
    g.dropDuplicates().repartition("p").write.mode("overwrite").partitionBy("p").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select("s", "p", "o", "kind", "dtype")


def turtle_triples(text: str) -> Iterator[tuple[str, str, str, str, str | None]]:
    """A Turtle subset: prefixes, `a`, `;` and `,` lists, plain and typed literals, numbers and booleans. No blank nodes or collections."""
    import re

    token = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<punct>[;,.])|(?P<name>[A-Za-z_][\w.-]*?:(?:[\w%.-]*[\w%-])?|:[\w.-]*\w|[A-Za-z]\w*)')
    prefixes: dict[str, str] = {}
    known = {v: k for k, v in PREFIXES.items()}
    found, at = [], 0
    while at < len(text):
        m = token.match(text, at)
        if not m:
            raise ValueError(f"cannot read Turtle at character {at}: {text[at : at + 40]!r}")
        if m.lastgroup:
            found.append((m.lastgroup, m.group()))
        at = m.end()
    i = 0

    def short(full: str) -> str:
        return next((p + full[len(f) :] for f, p in known.items() if full.startswith(f)), full)

    def name(kind: str, value: str) -> str:
        if kind == "iri":
            return short(value[1:-1])
        if value == "a":
            return "rdf:type"
        head, _, tail = value.partition(":")
        return short(prefixes[head + ":"] + tail) if head + ":" in prefixes else value

    def unquote(s: str) -> str:
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s)

    while i < len(found):
        kind, value = found[i]
        if (kind == "lang" and value == "@prefix") or value in ("PREFIX", "prefix"):
            prefixes[found[i + 1][1]] = found[i + 2][1][1:-1]
            i += 4 if kind == "lang" else 3
            continue
        s, i = name(kind, value), i + 1
        while True:
            p, i = name(*found[i]), i + 1
            while True:
                kind, value = found[i]
                i += 1
                if kind in ("str", "long"):
                    body, dtype = unquote(value[3:-3] if kind == "long" else value[1:-1]), "xsd:string"
                    if i < len(found) and found[i][0] == "type":
                        dtype, i = name(*found[i + 1]), i + 2
                    elif i < len(found) and found[i][0] == "lang":
                        i += 1
                    yield s, p, body, "literal", dtype
                elif kind == "num":
                    yield s, p, value, "literal", "xsd:integer" if value.lstrip("+-").isdigit() else "xsd:decimal"
                elif value in ("true", "false"):
                    yield s, p, value, "literal", "xsd:boolean"
                else:
                    yield s, p, name(kind, value), "uri", None
                if found[i][1] != ",":
                    break
                i += 1
            end, i = found[i][1], i + 1
            while end == ";" and i < len(found) and found[i][1] in (";", "."):
                end, i = found[i][1], i + 1
            if end == ".":
                break


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle files, each parsed whole by one task; N-Triples or Parquet are the formats for what is large. A missing path is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for text in p["value"]:
                yield pd.DataFrame(list(turtle_triples(text)), columns=["s", "p", "o", "kind", "dtype"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, SCHEMA)
