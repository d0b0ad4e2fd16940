from __future__ import annotations

from tessella.llm import linededup


def test_lines_over_the_ratio_go_and_all_else_stays(spark):
    rows = [(i, "h", f"Menu \nown line {i}\n\nfoot\r" if i < 6 else f"own line {i}\nMenu {i}") for i in range(10)]
    rows += [(20, None, "Menu\nown"), (21, None, None), (22, "solo", "Menu\nMenu\nfoot"), (23, "h", ""), (24, "h", "Menu\nfoot")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, n_lines string")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, ratio=0.3).collect()}
    assert got == {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, ratio=0.3, broadcast_bytes=0).collect()}
    assert got[0] == "own line 0\n" and got[7] == "own line 7\nMenu 7"
    assert got[20] == "Menu\nown" and got[21] is None and got[22] == "Menu\nMenu\nfoot" and got[23] == "" and got[24] == ""
    assert linededup.drop_boilerplate(docs).columns == docs.columns
    assert linededup.drop_boilerplate(docs.limit(0)).count() == 0
    stats = {r["doc_id"]: (r.n_lines, r.n_dropped) for r in linededup.drop_boilerplate(docs, ratio=0.3, stats=True).collect()}
    assert stats[0] == (4, 2) and stats[21] == (0, 0) and stats[24] == (2, 2)


def test_a_line_counts_once_a_page_and_copies_are_one_page(spark):
    rows = [(1, "h", "a\na\na\nb"), (2, "h", "c"), (3, "h", "d\n" * 50_000)] + [(9, "h", "z")] * 30 + [(10, "h", "t\n1"), (11, "h", "t\n2"), (12, "h", "t")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, line int")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, ratio=0.4, least=2).collect()}
    assert got[1] == "a\na\na\nb" and got[9] == "z" and got[3].startswith("d\nd")
    assert got[10] == "1" and got[11] == "2" and got[12] == ""


def test_columns_of_any_name_pass(spark):
    rows = [(i, "h", f"Menu\nown {i}", f"p{i}", f"q{i}", f"r{i}", i, f"s{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, __lines string, __host string, __kept string, c0 long, `a.b` string")
    for limit in (0, 1 << 20):
        got = linededup.drop_boilerplate(docs, broadcast_bytes=limit)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [(*r[:2], f"own {r[0]}", *r[3:]) for r in rows]
    named = docs.withColumnRenamed("text", "a text").withColumnRenamed("source", "common")
    assert {r[2] for r in linededup.drop_boilerplate(named, "common", "a text").collect()} == {f"own {i}" for i in range(5)}


def test_query_against_sql(spark):
    import duckdb

    from tessella.llm.queries import op7_lines

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(linededup.SQL)
    got = op7_lines(spark, "/root/testdata/sf0.01").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
    assert any(r.n_dropped for r in got)
