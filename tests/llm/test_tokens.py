from __future__ import annotations

import inspect
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing, tokens
from tessella.llm.queries import RANKS, TOKENIZER, op3_packing, op5_tokens

SF = "/root/testdata/sf0.01"
PLAIN = Tokenizer.from_file(TOKENIZER)
ENC = tokens.encoder(TOKENIZER, RANKS)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_every_character_of_the_fast_path():
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    texts = [f"a{c}b {c} {c}{c}1{c}  {c}\n{c}'s" for c in chars]
    assert all(ENC._plain(t) for t in texts)
    assert [x.tolist() for x in ENC.encode(texts)] == [ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8")) | st.text("ab \n\t'sé<|endoftext>12\u2028\u00a0") | st.lists(st.sampled_from(["<|endoftext|>", " ", "ab", "漢", "'re"])).map("".join))
def test_ids_are_the_librarys(text):
    assert ENC.encode([text])[0].tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x", " ", "\n", "é", "漢字", "<|endoftext|>", "!!", "12", "'s", "\x1c", "\u00a0"]), max_size=400).map("".join), st.integers(4, 60), st.integers(1, 12))
def test_spliced_counts_are_whole_counts(text, chunk, overlap):
    assert tokens.spliced_count(text, ENC, chunk, overlap) == len(ids(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "x", " ", "\n", "é", "ß", "\u00a0", "\x1c", "<|endoftext|>", "!!", "12", "'s", "–"]), max_size=200).map("".join))
def test_fast_offsets_are_the_librarys(text):
    ids_, begun = ENC.starts(text)
    e = PLAIN.encode(text, add_special_tokens=False)
    assert ENC._plain(text) and ids_.tolist() == e.ids and begun.tolist() == [a for a, _ in e.offsets]


def test_long_documents_of_every_scale_are_spliced(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        texts = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").where(f"length(text) > {inspect.signature(tokens.count_tokens).parameters['huge'].default}").collect()]
        assert texts, sf
        assert [tokens.spliced_count(t, ENC) for t in texts] == [len(ids(t)) for t in texts]


def test_splicing_widens_where_no_space_helps():
    for text in ("a" * 5000, "ab " * 10 + "x1" * 3000 + " end " * 40, " " * 4000, "漢" * 3000):
        assert tokens.spliced_count(text, ENC, 256, 8) == len(ids(text))


def test_counts_against_the_library(spark):
    got = {r.doc_id: r for r in op5_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n = len(ids(d.text))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 1024)


def test_count_edge_rows(spark):
    long = "some words and 12 é " * 20_000
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "a b", 0), (3, "a b", 0), (4, long, 0), (5, "<|endoftext|>", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, TOKENIZER, RANKS).collect()))
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), len(ids(r[1]))) for r in rows)
    assert tokens.count_tokens(docs.limit(0), TOKENIZER).count() == 0


def check_packed(rows, docs, window=1024):
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(ids(t) + [0])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d, all_ids in texts.items():
        want = all_ids[0]
        pieces = sorted(by_doc[d], key=lambda r: (r.start, r.length))
        assert sum(r.length for r in pieces) == sum(map(len, all_ids))
        at = 0
        for r in pieces[:: len(all_ids)]:
            if len(all_ids) == 1:
                assert r.start == at
                at += r.length
            assert r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded


def test_packing_is_a_partition_without_padding(spark):
    rows = op3_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id for r in rows} == {d for d, _ in docs}
    assert check_packed(rows, docs) == 0
    again = op3_packing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_edge_rows(spark):
    docs = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 40_000), (4, "tie"), (5, "tie"), (6, "same"), (6, "same")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, offset int")
    assert check_packed(packing.pack(df, TOKENIZER, RANKS).collect(), docs) == 0
    assert packing.pack(df.limit(0), TOKENIZER, RANKS).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, TOKENIZER, window=1000)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_fill_is_optimal(counts, room):
    sums = {0}
    for length, k in counts.items():
        sums = {s + length * i for s in sums for i in range(k + 1)}
    chosen = packing.best_fill(counts, room)
    assert all(0 < k <= counts[length] for length, k in chosen.items())
    assert sum(length * k for length, k in chosen.items()) == max(s for s in sums if s <= room)
