"""Token ids of a byte-level BPE as its library gives them, and counts of huge documents by spliced chunks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted

#: Character classes of code points below U+0250 are the same in both libraries; other texts go to `tokenizers`.
_OTHER = re.compile("[^\x00-ɏ‐-‧]")


class Encoder:
    """Encodes with `tokenizers`; with ranks of the same vocabulary, plain texts take the faster `tiktoken`.

    Both give the same ids: special strings inside a text become their special id, as is the default of
    `tokenizers`, and texts with characters whose class may differ between the libraries are never sent to
    the second.
    """

    def __init__(self, path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.added = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
            self.lengths = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, np.int64)  # bytes of each id
            for token, i in [*((t.encode(), i) for t, i in self.added.items()), *ranks.items()]:
                self.lengths[i] = len(token)

    def _plain(self, text: str) -> bool:
        return text.isascii() or not _OTHER.search(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.fast is not None and self._plain(t):
                out[i] = np.array(self.fast.encode(t, allowed_special="all"), np.uint32)
            else:
                rest.append(i)
        for a in range(0, len(rest), 64):
            part = rest[a : a + 64]
            for i, e in zip(part, self.exact.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out  # type: ignore[return-value]

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, the code point at which each token starts) of one text; a token inside a character has that character's."""
        if self.fast is not None and self._plain(text):
            ids = np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
            data = np.frombuffer(text.encode(), np.uint8)
            begun = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point to which each byte belongs
            return ids, begun[np.cumsum(self.lengths[ids]) - self.lengths[ids]]
        e = self.exact.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array([a for a, _ in e.offsets], np.int64)


@lru_cache(maxsize=4)
def encoder(path: str, ranks_path: str | None = None) -> Encoder:
    """One per worker process."""
    return Encoder(path, ranks_path)


def _stable(text: str, a: int, b: int) -> set[int]:
    """Positions p in (a, b) where ASCII white space follows a non-space: every pre-token, whatever stands around it, ends there."""
    return {a + m.start() + 1 for m in re.finditer(r"\S(?=[ \t\n\r])", text[a:b])}


def spliced_count(text: str, enc: Encoder, chunk: int = 1 << 13, overlap: int = 256) -> int:
    """Tokens of a text of any length, from overlapping chunks encoded with offsets.

    Neighbouring chunks are joined at a position inside their overlap where both encodings start a token
    and white space follows a non-space: no pre-token and no special string crosses such a place, so what
    stands before it in the left chunk and after it in the right one is what the whole text gives. If the
    overlap has no such place it is widened twofold, at last to the text's end.
    """
    total, start = 0, 0
    n = len(text)
    while True:
        end, width = min(n, start + chunk), overlap
        left_ids, left = enc.starts(text[start:end])
        if end == n:
            return total + len(left_ids)
        while True:
            begin = max(start + 1, end - width)
            stop = min(n, begin + 2 * width)
            right = enc.starts(text[begin:stop])[1] + begin
            common = _stable(text, begin, end - 1) & set((left + start).tolist()) & set(right.tolist())
            if common:
                break
            if end == n:
                return total + len(left_ids)
            width *= 2
            end = min(n, start + max(chunk, width) + width)
            left_ids, left = enc.starts(text[start:end])
        at = max(common)
        total += int((left < at - start).sum())
        start = at


def count_tokens(
    docs: DataFrame, path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, huge: int = 1 << 14
) -> DataFrame:
    """(`id_col`, n_bytes, n_tokens, over_limit) per row, of whole texts and without added special tokens.

    Null and empty texts have 0 of each. Texts of more than `huge` code points are counted in spliced
    chunks, so memory doesn't follow the longest document's encoding; any value gives the same counts.
    The default calls a document huge from about 3,000 words on. Repeated rows, null ids and empty
    tables pass through as they are; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks_path)
        for batch in batches:
            counts: list[int] = []
            sizes: list[int] = []
            for a in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(a, 256).to_pylist()]
                sizes += [len(t) if t.isascii() else len(t.encode()) for t in texts]
                short = [t if len(t) <= huge else "" for t in texts]
                counts += [len(ids) if len(t) <= huge else spliced_count(t, enc) for t, ids in zip(texts, enc.encode(short), strict=True)]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    shaped = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return shaped.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
