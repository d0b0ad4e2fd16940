from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from tessella.llm import simhash


def brute(rows, width=5, least=0.8):
    """The rows that stay, as (id, text), by all pairs of sets of shingles as words."""

    def of(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()

    sets = [of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y)):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    kept = (min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values())
    return sorted((rows[i][0] for i in kept), key=str)


def near(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"x{rng.random()}"
    return words


@pytest.mark.parametrize("cut", [True, False])
def test_stage_against_brute_force(spark, monkeypatch, cut):
    if cut:  # groups of several blocks
        whole = simhash.similar_sets
        monkeypatch.setattr(simhash, "similar_sets", lambda *a: whole(*a, block=16, room=2000, most=16))
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(8, 200))
        texts += [base, *(near(rng, base, max(1, len(base) * k // 100)) for k in (1, 2, 3, 4)), [*passage, *base]]
    hot = rng.choices(vocabulary, k=120)
    texts += [near(rng, hot, rng.randint(0, 3)) for _ in range(60)]
    for n in range(4, 30):  # sets of few shingles, one more word apart
        base = rng.choices(vocabulary, k=n + 4)
        texts += [base, [*base, "more"], [*base, "more", "words"], base[1:]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, ""), (901, None), (902, "One two"), (903, "one TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute(rows)


def test_near_copies_many_bits_apart_go(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near(rng, base, 4)))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()] == [1]


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    other, third = (" ".join(f"{c}{i}" for i in range(50)) for c in "uv")
    rows = [(1, long), (2, long), (2, other), (3, third), (3, third), (4, other + " end"), (None, long), (None, "alone with no id at all"), (None, "alone with no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, long), (2, other), (3, third), (None, "alone with no id at all")], key=str)
    assert corpus_pipeline.distinct(spark, docs.limit(0), "").count() == 0


def test_no_link_at_the_threshold_is_lost(spark):
    rng = np.random.default_rng(3)
    for n, more, pairs in ((4, 1, 4000), (9, 1, 2000), (64, 0, 1000), (80, 20, 1000), (900, 0, 200)):
        apart = []
        for _ in range(pairs):
            if more:
                b = rng.integers(0, 2**64, n + more, np.uint64)
                a = b[:n]
            else:  # two of one size that share 8 in 9
                whole = rng.integers(0, 2**64, n + n // 8 + 1, np.uint64)
                a, b = whole[: n], whole[n // 9 :][:n]
            x, y = (np.array(simhash.wide_fingerprint(s), np.uint64) for s in (a, b))
            apart.append(int(np.bitwise_count(x ^ y).sum()))
        assert np.mean(np.array(apart) > 72) <= (0.001 if n == 4 else 0), (n, max(apart))


def test_columns_of_any_name_pass(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "p", "q"), (2, text, "r", "s"), (2, "other words", "t", "u")], "doc_id long, text string, `a.b` string, __0 string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, text, "p", "q"), (2, "other words", "t", "u")]


def test_candidates_of_other_sizes_or_strips_are_no_links():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**64, 40 + 40 * (k % 2), np.uint64)) for k in range(6)]
    x = np.array([simhash.wide_fingerprint(s) for s in sets], np.uint64)
    for radius in (72, 256):
        assert simhash._verified(x, sets, None, 0.8, radius, step=2).tolist() == [0, 1, 2, 3, 4, 5]
    label = simhash._verified(x[[0, 1, 0]], [sets[0], sets[1], sets[0]], None, 0.8, 72, step=1)
    assert label[0] == label[2] != label[1]
