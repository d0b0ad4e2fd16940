from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessella.llm import ctph
from tessella.llm.queries import op8_fingerprints

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text: bytes) -> str:
    """The definition, byte by byte."""
    m32, m64 = (1 << 32) - 1, (1 << 64) - 1

    def rolled(i):
        window = bytes(max(0, 6 - i)) + text[max(0, i - 6) : i + 1]
        h = sum(b * pow(0x2C9277B5, 6 - k, 1 << 32) for k, b in enumerate(window)) & m32
        return (h * 0x9E3779B1 & m32) >> 7

    hashes = [rolled(i) for i in range(len(text))]
    level = max(2, (len(text) // 64).bit_length() - 1)
    ends = lambda k: [i for i, h in enumerate(hashes) if h & ((1 << k) - 1) == (1 << k) - 1]
    while len(ends(level)) < 16 and level > 2:
        level -= 1
    while len(ends(level)) > 64 and len(ends(level + 1)) >= 16:
        level += 1
    first = lambda cut: cut if len(cut) <= 64 else cut[:63]

    def signature(cut):
        out, start = "", 0
        for e in [*cut, len(text) - 1]:
            if start > e:
                continue
            h = sum((b + 1) * pow(0x01000193, k, 1 << 64) for k, b in enumerate(text[start : e + 1])) & m64
            out += ctph.ALPHABET.decode()[(h * 0x9E3779B97F4A7C15 & m64) >> 58]
            start = e + 1
        return out

    return f"{level}:{signature(first(ends(level)))}:{signature(first(ends(level + 1)))}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_likeness(a, b):
    alike = lambda x, y: 1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0
    (la, a1, a2), (lb, b1, b2) = a.split(":"), b.split(":")
    la, lb = int(la), int(lb)
    if la == lb:
        return 1.0 if a == b else max(alike(a1, b1), alike(a2, b2))
    return alike(a1, b2) if la == lb + 1 else alike(a2, b1) if lb == la + 1 else 0.0


def test_fingerprint_is_the_definition():
    r = random.Random(4)
    texts = [b"", b"a", b"abcdefg", b"a" * 3000, bytes(r.randrange(256) for _ in range(5000)), " ".join(r.choice(["und", "der", "été"]) for _ in range(900)).encode(), b"one line again and again\n" * 200, b"ab " * 900]
    for t in texts:
        assert ctph.fingerprint(t) == slow_fingerprint(t)


def test_long_texts_do_not_depend_on_the_parts(monkeypatch):
    r = random.Random(1)
    text = bytes(r.randrange(97, 123) for _ in range(40_000))
    whole = ctph.fingerprint(text)
    monkeypatch.setattr(ctph, "_PART", 1000)
    assert ctph.fingerprint(text) == whole
    moved = ctph.fingerprint(b"some words more " + text)
    assert slow_likeness(whole, moved) > 0.9


def test_query_against_the_definition(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in op8_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    fps = [ctph.fingerprint(t.encode()) for _, t in docs]
    by_text, near_edited, near_next = {}, [], []
    for k, (i, t) in enumerate(docs):
        e = ctph.edited(t, docs[(k + 1) % len(docs)][1])
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_sha256) == (len(t), fps[k], hashlib.sha256(e.encode()).hexdigest())
        assert r.edited_fingerprint == ctph.fingerprint(e.encode())
        if k < 150:
            assert abs(r.near_edited - slow_likeness(fps[k], r.edited_fingerprint)) < 1e-12
            assert abs(r.near_next - slow_likeness(fps[k], fps[(k + 1) % len(docs)])) < 1e-12
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if len(t) > 200:
            near_edited.append(r.near_edited)
            near_next.append(r.near_next)
    assert np.median(near_edited) > 0.4 and np.median(near_next) < 0.25


def place(row):
    """Null ids first, then by id, XXH64 and SHA-256 of the text."""
    data = (row[1] or "").encode()
    h = xxhash.xxh64_intdigest(data, 42)
    return (row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h, hashlib.sha256(data).digest())


def test_repetitive_texts_have_pieces():
    text = b"the same words in every line of it\n" * 400
    cut = text[: len(text) // 2] + bytes(range(97, 123)) * 300
    assert len(ctph.fingerprint(text).split(":")[1]) > 16
    assert slow_likeness(ctph.fingerprint(text), ctph.fingerprint(cut)) > 0


def test_hot_ids_and_ranges_of_bytes(spark):
    r = random.Random(6)
    rows = [(5, f"copy {k} " + "x" * r.randrange(300)) for k in range(600)] + [(None, f"none {k}") for k in range(300)] + [(k, "w " * r.randrange(2000)) for k in range(400)] + [(5, "same")] * 3
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    order = sorted(rows, key=place)
    want = [(x[0], hashlib.sha256(ctph.edited(x[1], order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, x in enumerate(order)]
    got = ctph.edit_probe(df)
    assert sorted(((x.doc_id, x.edited_sha256) for x in got.collect()), key=str) == sorted(want, key=str)


def test_edge_rows(spark):
    rows = [(3, None), (1, "é漢x" * 10), (2, ""), (2, "b" * 70_000), (9, "z"), (None, "null id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, near_next int")
    order = sorted(rows, key=place)
    want = [(r[0], hashlib.sha256(ctph.edited(r[1] or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, r in enumerate(order)]
    got = ctph.edit_probe(df)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got.collect()), key=str) == sorted(want, key=str)
    alone = ctph.edit_probe(df.where("doc_id = 9")).first()
    assert alone.near_edited == 1.0 and alone.near_next == 1.0
    assert ctph.edit_probe(df.limit(0)).count() == 0
    assert ctph.fingerprints(df).count() == 6
    assert got.where(F.col("near_edited").isNull() | ~F.col("near_edited").between(0, 1)).count() == 0
