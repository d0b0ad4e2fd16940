"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records rebuilt by joins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import binary, join_hot, new_path, quoted, written
from tessella.sources.store import remove

SALTS = 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _uuid(*parts: Column) -> Column:
    """A UUID shaped from the MD5 of `parts`: the same in every run."""
    return F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Control characters of the value are percent-encoded so that a line stays one."""
    safe = F.replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\x00"), F.lit("%00"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _hashed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, sha256, sha1, size, zstd, row): each payload hashed and compressed once, each row numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                data = binary(part.column("payload"))
                columns = [[hashlib.sha256(d).hexdigest() for d in data], [hashlib.sha1(d).hexdigest() for d in data], [len(d) for d in data], [packer.compress(d) for d in data]]
                types = (pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["page_id", "url", "sha256", "sha1", "size", "zstd"])

    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), F.col(quoted(payload_col)).cast("string").alias("payload"))
    hashed = rows.mapInArrow(run, "page_id long, url string, sha256 string, sha1 string, size long, zstd binary")
    return hashed.withColumn("row", F.monotonically_increasing_id())


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes `path`/payloads (sha256, zstd: the payload compressed) and `path`/records (header, sha256).

    A header holds every byte of a record before its payload: the WARC fields, an empty line and, for a
    response, the HTTP head. Among records of equal payloads of at least `least` bytes that of the largest
    id is the response and the others revisit it; smaller ones are all responses. Rows that repeat the
    largest id are responses too; a row with a null id revisits, unless all ids of its payload are null.
    Every row is a record with an id of its own. A null payload is empty, a null URL has no target line.
    Each distinct payload is stored once: payloads are hashed and compressed in one pass, and of equal ones
    all rows but the first are left out by their number, so payloads stay where they are as long as the list
    of those rows is small.
    """
    staged = new_path(pages.sparkSession, "hashed")
    _hashed(pages, id_col, url_col, payload_col).write.option("compression", "none").parquet(staged)
    rows = pages.sparkSession.read.parquet(staged)
    slim = rows.drop("zstd")
    last = F.max(F.struct("page_id", (-F.col("row")).alias("back")))
    equal = written(slim.groupBy("sha256").agg(last.alias("last"), F.min("row").alias("first"), F.count("*").alias("copies")), "equal")
    slim = join_hot(slim, equal, "sha256", "copies")
    again = written(slim.where(F.col("row") != F.col("first")).select("row"), "again")
    rows.join(again, "row", "left_anti").select("sha256", "zstd").write.option("compression", "none").parquet(f"{path}/payloads")
    of = lambda c: F.when(F.col("size") >= least, c)
    slim = slim.withColumns({"of": of(F.col("last.page_id")), "of_row": of(-F.col("last.back"))})
    slim = slim.withColumn("revisit", F.coalesce(F.col("of") != F.col("page_id"), F.col("of").isNotNull()))
    record_id = lambda row: F.concat(F.lit("<urn:uuid:"), _uuid(F.col(row).cast("string"), F.col("sha256")), F.lit(">"))
    http = F.concat(F.lit(HTTP + "Content-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", record_id("row")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), record_id("of_row"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page", F.when(F.col("revisit"), F.col("of").cast("string"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(F.col("revisit"), F.length(http)).otherwise(F.length(http) + F.col("size")).cast("string")),
        F.lit("\r\n"),
        http,
    )
    slim.select(F.encode(header, "UTF-8").alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/records")
    remove(pages.sparkSession, staged)


def _fields(header: bytes) -> dict[str, str]:
    """The lines of the WARC header, which an empty line ends."""
    return dict(x.split(": ", 1) for x in header.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, record_type, refers_to, header, payload, record.

    `record` is the record's bytes as a WARC file holds them: header, the payload if it is a response, and
    the two closing line ends. `payload` is the full one, a revisit's too. A stored payload that does not
    have the digest it is filed under or that its header states, and a record of another length than its
    header states, raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header", pa.binary()), ("payload", pa.binary()), ("record", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for header, sha256, packed in zip(*(batch.column(c).to_pylist() for c in ("header", "sha256", "zstd")), strict=True):
                fields = _fields(header)
                payload = b"" if packed is None else unpacker.decompress(packed)
                if hashlib.sha256(payload).hexdigest() != sha256 or "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]:
                    raise ValueError(f"payload does not match its digest {sha256}")
                head = header.partition(b"\r\n\r\n")[2]
                body = b"" if fields["WARC-Type"] == "revisit" else payload
                if len(head) + len(body) != int(fields["Content-Length"]):
                    raise ValueError(f"record {fields['WARC-Record-ID']} is not as long as it says")
                page, of = (int(fields[n]) if n in fields else None for n in ("X-Page-ID", "X-Refers-To-Page"))
                out.append((page, fields["WARC-Type"], of, header, payload, header + body + b"\r\n\r\n"))
                size += len(payload)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    # Payloads of a thousandth of all records or more, of which there are no more than a thousand, go to SALTS tasks each.
    counts = written(records.groupBy("sha256").count(), "copies")
    most = F.broadcast(counts.where(F.col("count") >= max(SALTS, (counts.agg(F.sum("count")).first()[0] or 0) / 1000)).select("sha256", F.lit(True).alias("hot")))
    records = records.join(most, "sha256", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("header"), F.lit(SALTS))).otherwise(0))
    spread = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    payloads = payloads.join(most, "sha256", "left").select("sha256", "zstd", F.explode(spread).alias("salt"))
    records = records.drop("hot").join(payloads, ["sha256", "salt"], "left")
    return records.select("header", "sha256", "zstd").mapInArrow(run, "page_id long, record_type string, refers_to long, header binary, payload binary, record binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """Writes an archive of `pages` into the shared folder, rebuilds its records and returns one row for each:
    (`id_col`, payload_bytes, payload_digest, record_type, refers_to).

    Repeated rows are records of their own; an empty table gives an empty archive; extra columns are not read.
    """
    path = new_path(pages.sparkSession, "archive")
    write(pages, path, id_col, url_col, payload_col, least)
    rebuilt = read(pages.sparkSession, path)
    return rebuilt.select(F.col("page_id").alias(id_col), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS h, strlen(COALESCE(html, '')) AS n FROM pages
), m AS (SELECT h, MAX(page_id) AS of_id FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN m.of_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.of_id <> p.page_id THEN m.of_id END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h
"""
