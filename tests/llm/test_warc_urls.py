from __future__ import annotations

import hashlib

import duckdb
import pytest
import zstandard

from tessella.llm import urls, warc
from tessella.llm.common import new_path
from tessella.llm.queries import op9_warc, op10_urls, oracle_sql

SF = "/root/testdata/sf0.01"


def expected(rows):
    out = []
    largest = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    for i, _, h in rows:
        p = (h or "").encode()
        of = largest.get(h) if len(p) >= 1000 else None
        revisit = of is not None and of != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a.com/x\r\nEvil: 1", "é" * 600), (2, "http://b.com", "é" * 600), (3, None, "short"), (4, "u", "short"), (5, "", None), (6, "v", ""), (7, "w", "L" * 300_000), (7, "w", "L" * 300_000), (None, "n", "é" * 600), (None, "n", "N" * 2000)]


def test_archive_round_trip_of_edge_rows(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, payload int")
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = new_path(spark, "archive")
    warc.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    named, refers = [], set()
    for r in warc.read(spark, path).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and "Evil" not in fields
        block = rest[:-4]
        assert len(block) == int(fields["Content-Length"]) and fields["WARC-Type"] == r.record_type
        body = block.partition(b"\r\n\r\n")[2]
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload))
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest()
        named.append((fields["WARC-Record-ID"], r.page_id))
        refers |= {(fields["WARC-Refers-To"], r.refers_to)} if "WARC-Refers-To" in fields else set()
    assert len(dict(named)) == len(ROWS) and refers <= set(named)


def test_a_payload_of_very_many_pages(spark):
    rows = [(i, f"http://h/{i}", "same page " * 200) for i in range(300)] + [(1000 + i, "u", f"page {i}") for i in range(200)] + [(7, "http://again", "same page " * 200)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == expected(rows)


def test_a_wrong_payload_is_noticed(spark):
    path = new_path(spark, "archive")
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "b" * 2000)], "page_id long, url string, html string")
    warc.write(pages, path)
    broken = spark.createDataFrame([(r.sha256, bytearray(zstandard.compress(b"x"))) for r in spark.read.parquet(f"{path}/payloads").collect()], "sha256 string, zstd binary")
    broken.write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, path).collect()
    warc.write(pages, f"{path}/2")
    cut = [(bytearray(bytes(r.header).replace(b"Content-Length: 2", b"Content-Length: 1")), r.sha256) for r in spark.read.parquet(f"{path}/2/records").collect()]
    spark.createDataFrame(cut, "header binary, sha256 string").write.mode("overwrite").parquet(f"{path}/2/records")
    with pytest.raises(Exception, match="not as long as it says"):
        warc.read(spark, f"{path}/2").collect()


@pytest.mark.parametrize("query", [op9_warc, op10_urls])
def test_queries_against_sql(spark, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(oracle_sql()[query.__name__])
    got = query(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def slow_rule(host, path):
    best = None
    for r in urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return (best.text, best.verdict) if best else (None, "allow")


def test_urls_of_all_shapes(spark):
    cases = [
        ("http://Example.COM/en/x?q#f", "example.com", "/en/x"), ("https://www.example.com/en/", "www.example.com", "/en/"), ("https://a.www.example.com/en/1", "a.www.example.com", "/en/1"),
        ("http://badexample.com/en/", "badexample.com", "/en/"), ("http://com/", "com", "/"), ("http://com", "com", ""), ("x.net/es/", "", ""), (None, "", ""), ("", "", ""),
        ("ftp://a.net?b/es/", "a.net", ""), ("://b.net/fr/#x", "b.net", "/fr/"), ("http://h.org/a.example.com/en/", "h.org", "/a.example.com/en/"), ("http://É.net/es/é", "É.net", "/es/é"),
        ("http://a.net/es", "a.net", "/es"), ("http://x\n.net/fr/\ny", "x\n.net", "/fr/\ny"), ("http://a.com/" + "p" * 5000, "a.com", "/" + "p" * 5000), ("http://u://v.net/es/", "u:", "//v.net/es/"), ("http://a.com:80/", "a.com:80", "/"),
    ]
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: (h, p, *slow_rule(h, p)) for i, (_, h, p) in enumerate(cases)}
    assert urls.judge(df.limit(0)).count() == 0


def test_wildcards_and_many_words():
    import re

    texts = [b"ab", b"aXb", b"ab" * 40, b"", b"zzab", b"abzz", b"a" * 130]
    patterns = {"a*b": b"a.*b", "*ab": b".*ab", "a?b": b"a.b", "*": b".*", "a" * 130: b"a{130}", "ab*": b"ab.*"}
    token = {ord("*"): urls.MANY, ord("?"): urls.ANY}
    machine = urls.Automaton([[token.get(b, b) for b in p.encode()] for p in patterns])
    assert machine.words > 2
    got = machine.run(texts)
    for i, t in enumerate(texts):
        assert got[i].tolist() == [bool(re.fullmatch(p, t, re.S)) for p in patterns.values()]
