"""Python-literal list columns, parsed once at ingest."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: One entry of a list and what ends it: a flat dict, a string or None. What looks otherwise, or has triple quotes, is parsed as a whole.
_STRING = r"""'(?:[^'\\\n]++|\\.)*+'|"(?:[^"\\\n]++|\\.)*+\""""
_ENTRY = re.compile(rf"""[ \t\r\n]*+(?:\{{(?:[^{{}}\[\]()'"#\\]++|{_STRING})*+\}}|{_STRING}|None)[ \t\r\n]*+(?:,|$)""")
#: Entries whose syntax trees stand at once, characters of a piece of a text, and rows of a batch that goes back.
_AT_ONCE, _PIECE, _BATCH = 1000, 4096, 20_000


def _literal(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def entries(text: str, names: tuple[str, ...]) -> list[tuple[str | None, ...]] | None:
    """The named fields of each entry of a list literal as strings, nulls for one that is no dict; None for what is no list.

    A syntax tree takes a hundred times the text, so a long list is parsed some entries at a time.
    """
    get = lambda d: tuple(None if not isinstance(d, dict) or d.get(k) is None else str(d[k]) for k in names)
    ends = _ends(text)
    if ends is None:
        found = _literal(text)
        return [get(d) for d in found] if isinstance(found, list) else None
    out: list[tuple[str | None, ...]] = []
    for start, end in zip(ends, ends[1:], strict=False):
        found = _literal(f"[{text[start:end]}]")
        if found is None:
            return None
        out += map(get, found)
    return out


def _ends(text: str) -> list[int] | None:
    """Where a list of plain entries may be cut; None where its text isn't so plain."""
    if not (text[:1] == "[" and text[-1:] == "]") or "'''" in text or '"""' in text:
        return None
    at, ends, n, last = 1, [1], 0, len(text) - 1
    while at < last and text[at:last].strip(" \t\r\n") if last - at < 64 else at < last:
        m = _ENTRY.match(text, at, last)
        if not m:
            return None
        at, n = m.end(), n + 1
        if n % _AT_ONCE == 0:
            ends.append(at)
    return ends if ends[-1] == last else [*ends, last]


def parser(fields: dict[str, str]):
    """A vectorized function from a list literal of dicts to an array of structs of string fields.

    Null for what is no list; an entry that is no dict stays in its place as a struct of nulls, so positions hold.
    """
    schema = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in fields.values()]))

    def one(text: str | None):
        found = None if text is None else entries(text, tuple(fields))
        return None if found is None else [dict(zip(fields.values(), x, strict=True)) for x in found]

    @F.pandas_udf(schema)
    def parse(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(one)

    return parse


def authors_of(papers: DataFrame, column: str = "authors", key: str = "paper_id") -> DataFrame:
    """(key, pos, n_authors, author_id, name): one row per listed author; bad lists and entries without id and name give none.

    Texts come to Python in pieces and rows go back in batches, so a worker holds one paper's list, not a batch of papers.
    """
    pieces = F.regexp_extract_all(F.col(column), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    rows = papers.select(F.col(key), pieces.alias("l")).select(F.col(key), F.size("l").alias("n"), F.posexplode("l").alias("i", "piece"))
    names = T.StructType([papers.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("pos", "n_authors")), *(T.StructField(c, T.StringType()) for c in ("author_id", "name"))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[str] = []
        for b in parts:
            for j, (n, i, piece) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                text.append(piece)
                if i + 1 < n:
                    continue
                found = entries("".join(text), ("id", "name")) or []
                text.clear()
                rows = [(pos, *x) for pos, x in enumerate(found, 1) if x != (None, None)]
                for at in range(0, len(rows), _BATCH):
                    pos, ids, called = zip(*rows[at : at + _BATCH], strict=True)
                    keys = b.column(0).take(pa.array([j] * len(pos), pa.int64()))
                    sizes = pa.array([len(found)] * len(pos), pa.int32())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), sizes, pa.array(ids, pa.string()), pa.array(called, pa.string())], [key, "pos", "n_authors", "author_id", "name"])

    return rows.mapInArrow(run, names)
