"""Packing documents into token windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length come closest to `room` without passing it: {length: number}.

    Bit b of `reach` says that some choice adds up to b. A length with c pieces enters as 1, 2, 4, ... of
    them, each one shift of the bitset, largest lengths first, until `room` itself is reached or all have
    entered; the choice is then traced back through the bitsets kept on the way.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            k = min(part, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left, part = left - k, part * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += k
            at -= length * k
    return dict(chosen)


class Packer:
    """Packs the documents of one partition; holds at most about `pool` pieces shorter than a window."""

    def __init__(self, window: int, pool: int, first_id: int):
        self.window, self.pool, self.next_id = window, pool, first_id
        self.pieces: dict[int, list[tuple]] = defaultdict(list)
        self.held = 0
        self.rest: list[tuple] = []
        self.rest_tokens = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        full = total // w * w
        for a in range(0, full, w):
            self.emit([(doc, a, ids[a : a + w], total)])
        if total > full:
            self.pieces[total - full].append((doc, full, ids[full:], total))
            self.held += 1
        if self.held > self.pool:
            self.fill(self.pool // 4)

    def fill(self, down_to: int) -> None:
        while self.held > down_to:
            seed = max(self.pieces)
            counts = {k: len(v) for k, v in self.pieces.items()}
            counts[seed] -= 1
            chosen = best_fill(counts, self.window - seed)
            taken = [self.pieces[seed].pop()]
            for length, k in chosen.items():
                taken += [self.pieces[length].pop() for _ in range(k)]
            for length in (seed, *chosen):
                if length in self.pieces and not self.pieces[length]:
                    del self.pieces[length]
            self.held -= len(taken)
            if sum(len(p[2]) for p in taken) == self.window:
                self.emit(taken)
            else:  # slack that no choice closes: these are cut to whole windows
                self.rest += taken
                self.rest_tokens += sum(len(p[2]) for p in taken)
                while self.rest_tokens >= self.window:
                    self.cut(self.window)

    def cut(self, size: int) -> None:
        """The next `size` tokens of the rest as one sequence; the piece at its end may be cut."""
        taken, need = [], size
        while need:
            doc, start, ids, total = self.rest[0]
            part = ids[:need]
            taken.append((doc, start, part, total))
            need -= len(part)
            if len(part) == len(ids):
                self.rest.pop(0)
            else:
                self.rest[0] = (doc, start + len(part), ids[len(part) :], total)
        self.rest_tokens -= size
        self.emit(taken)

    def finish(self) -> None:
        """Packs what is held; the last tokens become sequences of powers of two, which need no padding."""
        self.fill(0)
        while self.rest_tokens:
            self.cut(1 << (self.rest_tokens.bit_length() - 1))


def pack(
    docs: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, pool: int = 4096
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then `end_id`; a null text counts as empty, so it is one token. Whole
    windows are cut off long documents, the remainders are packed by minimum bin slack, and every
    sequence has exactly `window` tokens but for those that end a partition, which have powers of two:
    no padding at all. `window` must be a power of two. Each partition is packed where it lies, without a
    shuffle, so a hot source costs nothing; its sequence ids begin at its number times 2^33, and a task that
    is run again gives the same rows. Repeated rows and null ids are packed like any others; an empty table
    gives no rows; extra columns are not read.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks_path)
        packer = Packer(window, pool, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True)) or [[]] * 7
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                ids = batch.column(0).slice(a, 256).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(a, 256).to_pylist()]
                for doc, found in zip(ids, enc.encode(texts), strict=True):
                    packer.add(doc, np.concatenate([found, end]).astype("<u4"))
                if len(packer.out) > 20_000:
                    yield rows()
        packer.finish()
        yield rows()

    shaped = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return shaped.mapInArrow(run, SCHEMA)
