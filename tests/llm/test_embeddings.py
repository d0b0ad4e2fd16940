from __future__ import annotations

import math

import numpy as np
import pytest

from tessella.llm import embeddings
from tessella.llm.queries import op4_embeddings


def brute(ids, vectors, least=0.9):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in zip(ids, vectors, strict=True)]
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    by_len = {}
    for i in range(n):
        if ok[i]:
            by_len.setdefault(len(vectors[i]), []).append(i)
    for members in by_len.values():
        x = np.stack([unit[i] for i in members])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least_of = {}
    for i in range(n):
        if ok[i]:
            least_of[find(i)] = min(least_of.get(find(i), ids[i]), ids[i])
    comp = [least_of[find(i)] if ok[i] else ids[i] for i in range(n)]
    return sorted(((ids[i], links[i], comp[i], ids[i] == comp[i]) for i in range(n)), key=str)


def test_query_against_brute_force(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
        want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
        got = sorted(map(tuple, op4_embeddings(spark, f"/root/testdata/{sf}").collect()), key=str)
        assert got == want


def test_hot_groups_blocks_and_edge_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    vectors = [(b + rng.normal(size=16) * 0.12).tolist() for b in base for _ in range(4)] + [(base[0] + rng.normal(size=16) * 0.1).tolist() for _ in range(80)]
    vectors += [base[1].tolist()] * 40 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    ids = [*range(len(vectors))]
    ids[5] = ids[4]
    ids.append(None)
    vectors.append(base[0].tolist())
    df = spark.createDataFrame(list(zip(ids, vectors, [1] * len(ids), strict=True)), "vec_id long, embedding array<double>, n_links int")
    for block in (8, 512):
        got = sorted(map(tuple, embeddings.near_duplicates(df, cells=6, block=block).collect()), key=str)
        assert got == [(a, b, c, True if a is None else d) for a, b, c, d in brute(ids, vectors)]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def planted(rng, n, dim, rank, least=0.9001, most=0.95):
    """n pairs of unit vectors of a cosine just over 0.9, all in `rank` directions."""
    frame = np.linalg.qr(rng.normal(size=(dim, rank)))[0].T
    base = rng.normal(size=(n, rank))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1)[:, None] * base
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(least, most, size=(n, 1))
    return (np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * aside]) @ frame).tolist()


@pytest.mark.parametrize(("dim", "rank", "cells"), [(8, 8, None), (16, 16, 40), (64, 8, 40), (64, 64, None), (768, 768, 12)])
def test_planted_links_at_the_default_margin(spark, dim, rank, cells):
    vectors = planted(np.random.default_rng(dim + rank), 1500 if dim < 100 else 500, dim, rank, 0.9001, 0.92)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddings.near_duplicates(df, cells=cells, block=256).collect()), key=str)
    want = brute(list(range(len(vectors))), vectors)
    assert sum(r[1] for r in want) >= len(vectors)
    assert got == want


def test_tiny_and_huge_vectors_change_no_other_row(spark):
    vectors = planted(np.random.default_rng(2), 700, 16, 16)
    rows = list(enumerate(vectors))
    odd = [[1e-200 * (k + 1) for k in range(16)], [1e200 * (k + 1) for k in range(16)], [5e-324] * 16, [1.7e308] * 16]
    both = spark.createDataFrame([*rows, *((9000 + i, v) for i, v in enumerate(odd))], "vec_id long, embedding array<double>")
    got = {r.vec_id: tuple(r) for r in embeddings.near_duplicates(both, cells=8).collect()}
    want = {r[0]: r for r in brute(list(range(len(vectors))), vectors)}
    assert {i: got[i] for i in want} == want
    assert [got[9000 + i][1:3] for i in range(4)] == [(1, 9000), (1, 9000), (1, 9002), (1, 9002)]


def test_query_with_links_planted_in_its_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    rng = np.random.default_rng(5)
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1)[:, None] * x
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(0.9001, 0.92, size=(len(x), 1))
    vectors = [v.tolist() for v in np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * aside]).astype(np.float32)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = brute(list(range(len(vectors))), vectors)
    assert sum(r[1] for r in want) >= len(vectors)
    assert sorted(map(tuple, op4_embeddings(spark, str(tmp_path)).collect()), key=str) == want
