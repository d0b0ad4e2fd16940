"""Command line: python -m tessella context | explain."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
import textwrap
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import kg, rag
from tessella.sources import fixtures, rdf, tables
from tessella.sources.store import written


def load(spark: SparkSession, path: str) -> DataFrame:
    """A graph by its kind: .ttl Turtle, .nt N-Triples, else the Parquet store."""
    return rdf.read_turtle(spark, path) if path.endswith(".ttl") else rdf.read_ntriples(spark, path) if path.endswith(".nt") else rdf.read(spark, path)


def context(spark: SparkSession, args: argparse.Namespace) -> None:
    """Summaries of authors with their texts as a JSON array, to --output or standard output, and their texts under --rag-dir.

    Authors come in the order asked for, as often as asked for; a name may stand for several. Those that are
    not found are named on standard error.
    """
    g = load(spark, args.graph)
    names = [x.strip() for x in (args.authors or "").split(",")]
    if args.authors_file:
        names += [x.strip() for x in Path(args.authors_file).read_text(encoding="utf-8").splitlines()]
    names = [x for x in names if x]
    if not names:
        print("no authors given: use --authors or --authors-file", file=sys.stderr)
        return
    asked = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    asked = asked.withColumn("input", F.when(F.col("name").rlike("^[0-9]+$"), kg.uri("author", F.col("name"), args.base)).otherwise(F.col("name")))
    found = asked.join(kg.lookup(g, asked.select("input").distinct()).withColumnRenamed("s", "author").distinct(), "input", "left")
    found = written(found, "found")
    for row in found.where("author is null").orderBy("pos").toLocalIterator():
        print(f"no author found for {row.name}", file=sys.stderr)
    authors = found.where("author is not null").select("author").distinct()
    records = rag.summaries(g, authors, args.min_coauthored).join(rag.texts(g, authors, args.min_coauthored).withColumnRenamed("text", "rag_text"), "author")
    records = written(records, "records")
    rows = found.select("pos", "author").join(records, "author").orderBy("pos", "author").select(F.to_json(F.struct(*records.columns)).alias("x")).toLocalIterator()
    with open(args.output, "w", encoding="utf-8") if args.output else contextlib.nullcontext(sys.stdout) as out:
        out.write("[")
        for i, row in enumerate(rows):
            out.write(("," if i else "") + "\n" + textwrap.indent(json.dumps(json.loads(row.x), indent=2, ensure_ascii=False), "  "))
        out.write("\n]\n")
    if args.rag_dir:
        named = records.select(F.coalesce("name", F.regexp_replace("author", "^.*/", "")).alias("name"), "rag_text")
        tables.write_texts(named, args.rag_dir, "name", "rag_text")


def explain(spark: SparkSession, args: argparse.Namespace) -> None:
    """The trace of one ranking over a folder of the bundled tables."""
    from tessella.plans.expert import Expert, explanation

    print(explanation(Expert(spark, args.tables, args.query), args.pipeline).first()["explanation"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("context", help="summaries and context texts of authors")
    c.add_argument("--graph", required=True)
    c.add_argument("--authors", help="names, URIs or numbers, between commas")
    c.add_argument("--authors-file", help="a file with one of them a line")
    c.add_argument("--output", help="a file for the records, which else are printed")
    c.add_argument("--rag-dir", help="a folder for one text file for each author")
    c.add_argument("--min-coauthored", type=int, default=2, help="papers that a coauthor must share")
    c.add_argument("--base", default=kg.BASE)
    c.set_defaults(run=context)
    e = sub.add_parser("explain", help="how the first candidates were ranked")
    e.add_argument("--tables", required=True)
    e.add_argument("--pipeline", choices=("baseline", "proposed"), default="proposed")
    e.add_argument("--query", default=fixtures.QUERY_TEXT)
    e.set_defaults(run=explain)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv if argv is not None else sys.argv[1:])
    args.run(SparkSession.builder.appName("tessella").getOrCreate(), args)
