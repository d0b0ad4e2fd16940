from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm.components import connected_components


def slow_fingerprint(text: str | None) -> int:
    words = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        least = min((ids[m] for m in members if ids[m] is not None), default=None)
        out.update({m: least for m in members})
    return [out[i] for i in range(len(ids))]


def test_fingerprint_matches_definition():
    texts = [None, "", "  \t\n", "One", "one two", "a b c", "A b\x0bC d e É " * 9, "x y z w " * 1000, "  a"]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == slow_fingerprint(t)


def test_edge_rows(spark):
    rows = [(4, "alpha beta gamma delta", 1), (2, "ALPHA beta gamma delta", 1), (2, "ALPHA beta gamma delta", 1), (9, None, 1), (7, "", 1), (None, "alpha beta gamma delta", 1), (None, "lonely words here", 1), (5, "word " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], slow_components([r[0] for r in rows], fps), strict=True), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 5, 7, None], key=str)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("block", [4, 512])
def test_all_links_within_the_radius_are_found(spark, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= np.uint64(1) << np.uint64(b)
            fps.add(int(x))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.close_fingerprints(df, 2, block)).collect()}
    want = dict(zip(signed, slow_components(signed, fps), strict=True))
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_a_path_a_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 7), (None, 3), (1, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(200, 260)]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_brute_force(spark):
    from tessella.llm.queries import op1_simhash

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    want = sorted(zip([r.doc_id for r in docs], [f"{f:016x}" for f in fps], slow_components([r.doc_id for r in docs], fps), strict=True))
    got = op1_simhash(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == want
    assert got.where(F.col("component_id") > F.col("doc_id")).count() == 0
