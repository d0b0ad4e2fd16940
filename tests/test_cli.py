from __future__ import annotations

import json

from test_operators import graph

from tessella import cli
from tessella.sources import rdf


def test_context(spark, tmp_path, capsys):
    rdf.write_ntriples(graph(spark), str(tmp_path / "g.nt"))
    (tmp_path / "ids.txt").write_text("ann\n\nnobody\n")
    common = ["context", "--graph", str(tmp_path / "g.nt")]
    cli.main([*common, "--authors", "http://x/author/none, ANN ,", "--authors-file", str(tmp_path / "ids.txt"), "--rag-dir", str(tmp_path / "rag"), "--output", str(tmp_path / "out.json")])
    got = json.loads((tmp_path / "out.json").read_text())
    assert [x["author"] for x in got] == ["http://x/author/none", got[1]["author"], got[1]["author"]]  # in order, repeats included
    ann = got[1]
    assert ann["name"] == "Ann" and [p["uri"] for p in ann["papers"]] == ["p1", "p2", "p3"] and ann["rag_text"].startswith("Author: Ann\n")
    assert ann["coauthors"] == [{"uri": "a2", "count": 2}] and ann["main_topics"] == [{"uri": "t1"}] and "role" not in ann  # those of one paper are left out
    assert (tmp_path / "rag" / "Ann.txt").read_text() == ann["rag_text"] + "\n" and (tmp_path / "rag" / "none.txt").exists()
    assert "nobody" in capsys.readouterr().err
    cli.main([*common, "--authors", "Ann", "--min-coauthored", "1"])
    assert len(json.loads(capsys.readouterr().out)[0]["coauthors"]) > 1
    cli.main(common)
    assert "no authors given" in capsys.readouterr().err


def test_explain(spark, capsys):
    for pipeline in ("baseline", "proposed"):
        cli.main(["explain", "--tables", "/root/testdata/sf0.001", "--pipeline", pipeline])
        got = json.loads(capsys.readouterr().out)
        assert got["pipeline"] == pipeline and got["top_candidates"][0]["rank"] == 1 and got["ranking_method"] and got["explanation"]
        assert got["n_candidates"] >= got["n_ranked"] >= len(got["top_candidates"])
        if pipeline == "proposed":
            assert got["quota_per_role"] == got["n_candidates"] // 3 and sum(got["pool_role_distribution"].values()) == got["n_candidates"]
            assert {r: len(m) for r, m in got["role_groups_detail"].items()} == got["pool_role_distribution"]
    cli.main(["explain", "--tables", "/root/testdata/sf0.001", "--query", "some other words"])
    assert json.loads(capsys.readouterr().out)["query"] == "some other words"
