"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import partitions, quoted

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET, np.uint8)
WINDOW = 7
LENGTH = 64  # pieces aimed at
FEWEST = 16  # of longer texts
SMALLEST = 2  # log2 of the smallest block size
TOP = 24  # log2 of the largest
FINE = 8  # ranges measured for each range that one task is given
_MIX = np.uint32(0x9E3779B1)
_STEP = 0x01000193  # odd, so its powers have inverses modulo 2^64
_INVERSE = pow(_STEP, -1, 1 << 64)
_PART = 1 << 16


def _powers(base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_PART - 1, np.uint64(base), np.uint64)]))


_UP, _DOWN = _powers(_STEP), _powers(_INVERSE)
_ROLL = [np.uint32(pow(0x2C9277B5, WINDOW - 1 - i, 1 << 32)) for i in range(WINDOW)]


def _triggers(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the hash of the last WINDOW bytes ends in `level` one bits, in order, and those hashes."""
    found, hashes, mask = [], [], np.uint32((1 << level) - 1)
    for a in range(0, len(data), _PART):
        part = data[max(0, a - WINDOW + 1) : a + _PART].astype(np.uint32)
        if a == 0:
            part = np.concatenate([np.zeros(WINDOW - 1, np.uint32), part])
        n = len(part) - WINDOW + 1
        h = part[:n] * _ROLL[0]
        for i in range(1, WINDOW):
            h += part[i : i + n] * _ROLL[i]
        h = (h * _MIX) >> np.uint32(7)
        at = np.flatnonzero((h & mask) == mask)
        found.append(at + a)
        hashes.append(h[at])
    return (np.concatenate(found), np.concatenate(hashes)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def _signatures(data: np.ndarray, cuts: list[np.ndarray]) -> list[str]:
    """For each array of piece ends, one letter for every piece of data (the last ends with the data).

    A piece's hash is the sum of (byte + 1) * step^(position in the piece), so it depends on its bytes alone.
    """
    if not len(data):
        return ["" for _ in cuts]
    starts = [np.concatenate([[0], ends + 1]) for ends in cuts]
    starts = [s[s < len(data)] for s in starts]
    hashes = [np.zeros(len(s), np.uint64) for s in starts]
    for a in range(0, len(data), _PART):
        b = min(len(data), a + _PART)
        terms = (data[a:b].astype(np.uint64) + np.uint64(1)) * _UP[: b - a]
        for s, h in zip(starts, hashes, strict=True):
            i, j = int(np.searchsorted(s, a, "right")) - 1, int(np.searchsorted(s, b, "left"))
            begun = np.maximum(s[i:j], a) - a
            back = _DOWN[begun]
            if s[i] < a:  # a piece that began in an earlier part
                back[0] = np.uint64(pow(_STEP, int(a - s[i]), 1 << 64))
            h[i:j] += np.add.reduceat(terms, begun) * back
    return [_LETTERS[((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)].tobytes().decode() for h in hashes]


def fingerprint(text: bytes) -> str:
    """"level:pieces:coarser pieces". Block size 2^level; the second signature is that of twice the block size.

    The level starts from the length, so that about LENGTH pieces arise; it falls while fewer than FEWEST
    do, and rises while there are more than LENGTH, unless that would leave too few, as in texts that
    repeat themselves: then all after the first LENGTH is one last piece. An empty text gives "SMALLEST::".
    """
    data = np.frombuffer(text, np.uint8)
    level = min(TOP, max(SMALLEST, (len(data) // LENGTH).bit_length() - 1))
    ends, hashes = _triggers(data, level)
    while len(ends) < FEWEST and level > SMALLEST:
        level -= 1
        ends, hashes = _triggers(data, level)
    rarer = lambda: (hashes >> np.uint32(level)) & np.uint32(1) == 1
    while len(ends) > LENGTH and level < TOP and (more := rarer()).sum() >= FEWEST:
        ends, hashes, level = ends[more], hashes[more], level + 1
    fine, half = _signatures(data, [cut if len(cut) <= LENGTH else cut[: LENGTH - 1] for cut in (ends, ends[rarer()])])
    return f"{level}:{fine}:{half}"


def _alike(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance over the longer length, of the signatures at a block size both have; else 0.

    Equal fingerprints give 1. Null gives null.
    """
    x, y = F.split(a, ":"), F.split(b, ":")
    la, lb = x[0].cast("int"), y[0].cast("int")
    return F.when(a == b, 1.0).when(la == lb, F.greatest(_alike(x[1], y[1]), _alike(x[2], y[2]))).when(la == lb + 1, _alike(x[1], y[2])).when(lb == la + 1, _alike(x[2], y[1])).when(a.isNotNull() & b.isNotNull(), 0.0)


def edited(text: str, following: str) -> str:
    """`text` with its last half of code points replaced by the first as many (or all) of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_chars, fingerprint) per row, of whole texts; null counts as empty. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    shaped = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return shaped.mapInArrow(run, "id long, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text (see `edited`), with the next document by id.

    Returns (`id_col`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).
    The next after the last is the first; a lone document is its own next. Documents are cut into ranges of
    about equal bytes, texts travel once, compressed, to their range's task, and the first document of each
    range also to the one before. Null text counts as empty; null ids come first; rows that repeat an id
    follow each other in the order of their texts' XXH64 and then SHA-256, and an id that many rows have is
    cut by it too; an empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    low = -(1 << 63)
    text = F.col(quoted(text_col)).cast("string")
    shaped = docs.select(F.coalesce(F.col(quoted(id_col)).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("text"))
    # Fine ranges, FINE for each task: where they are cut, the least document that each holds, and its bytes.
    shares = [i / (n * FINE) for i in range(1, n * FINE)]
    quantiles = np.array(shaped.agg(F.percentile_approx("id", shares, 10_000).alias("q")).first()["q"] or [], np.int64)
    at, times = np.unique(quantiles, return_counts=True)
    cuts = [(int(i), low if k == 0 else int((k / int(m) - 0.5) * 2.0**64)) for i, m in zip(at, times, strict=True) for k in range(int(m))]
    cut_ids, cut_hashes = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))

    def fine(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """How many cuts each document is not before."""
        first, last = np.searchsorted(cut_ids, ids, "left"), np.searchsorted(cut_ids, ids, "right")
        out = np.where(last - first > 0, first + 1, first)  # an id's first cut lies before all its rows
        for a in np.unique(first[last - first > 1]).tolist():
            mine = (first == a) & (last - first > 1)
            b = int(last[mine][0])
            out[mine] = a + np.searchsorted(cut_hashes[a:b], hashes[mine], "right")
        return out

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, sizes = (batch.column(c).to_numpy() for c in range(3))
            r = fine(ids, hashes)
            order = np.lexsort((hashes, ids))
            found, first = np.unique(r[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.astype(np.int32), ids[order][first], hashes[order][first], np.bincount(r, sizes)[found].astype(np.int64))], names=["r", "id", "h", "bytes"])

    sized = shaped.select("id", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("bytes"))
    found = sized.mapInArrow(measure, "r int, id long, h long, bytes long").groupBy("r").agg(F.min(F.struct("id", "h")).alias("least"), F.sum("bytes").alias("bytes")).collect()
    rows_of = sorted((x["r"], tuple(x["least"]), x["bytes"]) for x in found)  # at most n * FINE
    total, passed, ranges = sum(x[2] for x in rows_of), 0, np.zeros(len(cuts) + 1, np.int32)
    least: dict[int, tuple[int, int]] = {}
    for r, document, size in rows_of:
        ranges[r] = (passed + size // 2) * n // max(1, total)
        passed += size
        least.setdefault(int(ranges[r]), document)
    held = sorted(least)
    before = {least[r]: held[i - 1] for i, r in enumerate(held)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            places = ranges[fine(batch.column(0).to_numpy(), batch.column(1).to_numpy())].tolist()
            for r, i, h, t in zip(places, *(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = (t or "").encode()
                row = (i, h, hashlib.sha256(data).digest(), fingerprint(data), packer.compress(data))
                out.append((r, 0, *row))
                if (i, h) in before:  # the range before needs it as the next of its last document
                    out.append((before[i, h], 1, *row))
                size += len(row[4])
                if size > 1 << 23:
                    yield rows(out, wire)
                    out, size = [], 0
            if out:
                yield rows(out, wire)

    wire = {"r": pa.int32(), "look": pa.int32(), "id": pa.int64(), "h": pa.int64(), "sha": pa.binary(), "fp": pa.string(), "z": pa.binary()}
    result = {"id": pa.int64(), "n_chars": pa.int64()} | dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"), pa.string())

    def rows(found: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=[*types])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        last: tuple | None = None  # the document that still waits for the next
        closed = -1  # the range whose next was found
        out: list[tuple] = []

        def pair(a: tuple, b: tuple) -> tuple:
            text = edited(a[2], b[2])
            data = text.encode()
            return a[0], len(a[2]), hashlib.sha256(data).hexdigest(), a[1], fingerprint(data), b[1]

        for batch in batches:
            for r, look, i, fp, z in zip(*(batch.column(c).to_pylist() for c in ("r", "look", "id", "fp", "z")), strict=True):
                if r == closed:
                    continue
                doc = (i, fp, unpacker.decompress(z).decode())
                if last is not None:
                    out.append(pair(last, doc))
                last, closed = (None, r) if look else (doc, closed)
            yield rows(out, result)
            out = []

    sent = shaped.mapInArrow(send, "r int, look int, id long, h long, sha binary, fp string, z binary")
    ordered = sent.repartitionById(n, "r").sortWithinPartitions("r", "look", "id", "h", "sha").select("r", "look", "id", "fp", "z")
    met = ordered.mapInArrow(meet, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return met.select(
        F.when(F.col("id") != low, F.col("id")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
