"""Tables in and out, with explicit schemas."""

from __future__ import annotations

import json
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPERS = "id string, title string, abstract string, year string, authors string, n_citation long, embeddings string, topics string"
AUTHORS = "id string, name string, n_pubs long, n_citation long, tags string, pubs string"


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header and quoted fields that may hold line ends; values that don't fit their type become null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, enforceSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    out = df.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-document JSON; lines of JSON are `spark.read.json` as it is."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_settings(path: str):
    """A small JSON file of settings, on the driver."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; non-ASCII characters stay as they are."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines that aren't empty."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """A file `<key>.txt` for each key, spaces and slashes of which become underscores; its text and a line end. Of rows of one name one stays.

    The executors write one folder per key; the driver then renames each folder's file, so the keys are those
    that someone asked for, not a whole corpus.
    """
    spark = df.sparkSession
    named = df.select(F.regexp_replace(F.col(key), r"[ /\\]", "_").alias("name"), F.col(text).alias("value")).dropDuplicates(["name"])
    named.repartition("name").write.mode("overwrite").partitionBy("name").text(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(root):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().removeprefix("name="))
            for part in fs.listStatus(folder.getPath()):
                fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, f"{name}.txt"))
            fs.delete(folder.getPath(), True)


def vector(column):
    """A list literal of numbers, as stored in CSV, to an array; null where it is none."""
    return F.from_json(column, "array<double>")
