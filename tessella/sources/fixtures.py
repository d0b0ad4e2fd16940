"""The bundled tables seen as a bibliography: a paper is one order day, its authors the customers of that day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings that suit the span of the bundled orders; the operators' own defaults stay as they are.
END_YEAR, WINDOW, SLICE = 2001, 2, 2
QUERY_TEXT = "and the on it is he for tion"
QUERY_VECTOR = 0
QUERY_TAG = "BUILDING"
NO_TAG = "MACHINERY"


class Fixtures:
    """Each view is built anew from the tables, so a query reads only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _days(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("paper_id"))

    def authorship(self) -> DataFrame:
        """(paper_id, author_id, pos, n_authors)"""
        first = self._days().groupBy("paper_id", F.col("o_custkey").alias("author_id")).agg(F.min("o_orderkey").alias("k"))
        day = Window.partitionBy("paper_id")
        return first.select("paper_id", "author_id", F.row_number().over(day.orderBy("k")).alias("pos"), F.count("*").over(day).alias("n_authors"))

    def links(self) -> DataFrame:
        """(paper_id, author_id) without positions."""
        return self._days().select("paper_id", F.col("o_custkey").alias("author_id")).distinct()

    def papers(self) -> DataFrame:
        """(paper_id, year)"""
        return self._days().select("paper_id").distinct().withColumn("year", F.year("paper_id"))

    def topics(self, level: int) -> DataFrame:
        """(paper_id, topic) of the second or the third order. Parts are sorted and merged: their file is many times smaller than their rows."""
        if level == 2:
            return self._days().select("paper_id", F.col("o_orderpriority").alias("topic")).distinct()
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        parts = self.table("part").select("p_partkey", F.col("p_brand").alias("topic")).hint("merge")
        return self._days().select("o_orderkey", "paper_id").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey")).select("paper_id", "topic").distinct()

    def hierarchy(self) -> DataFrame:
        """(subtopic, main_topic)"""
        return self.table("part").select(F.col("p_brand").alias("subtopic"), F.col("p_type").alias("main_topic")).distinct()

    def authors(self) -> DataFrame:
        """(author_id, name, org, tag, n_citation); authors of one segment have no tag. The next join isn't a broadcast, whatever the file's size."""
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("org"))
        customer = self.table("customer").withColumnRenamed("c_nationkey", "n_nationkey")
        return customer.join(nation, "n_nationkey").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"), "org", F.nullif("c_mktsegment", F.lit(NO_TAG)).alias("tag"), F.col("c_acctbal").alias("n_citation")).hint("merge")

    def texts(self) -> DataFrame:
        """(doc_id, text, lang, paper_id): all documents, dealt to the days in order."""
        days = self.papers().select("paper_id")  # few: one row a day
        numbered = days.select("paper_id", (F.row_number().over(Window.orderBy("paper_id")) - 1).alias("day_no"))
        n = days.agg(F.count("*").alias("n"))  # one row
        docs = self.table("documents").crossJoin(F.broadcast(n)).withColumn("day_no", F.pmod(F.col("doc_id"), F.col("n")))
        return docs.join(numbered, "day_no").select("doc_id", "text", "lang", "paper_id")

    def docs(self) -> DataFrame:
        """(doc_id, text, lang, paper_id, embedding): the documents that have a vector, for what needs a cosine."""
        return self.texts().join(self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")

    def query_vector(self) -> list[float]:
        """One row of the vectors, as a literal for the plans."""
        row = self.table("embeddings").where(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
        return [float(x) for x in row["embedding"]]
