"""URL rules by a bit-parallel wildcard automaton over canonical URLs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = 0xFF  # between host and path; no byte of UTF-8
ANY, MANY = -1, -2  # one byte, any run of bytes


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def globs(rule: Rule) -> list[list[int]]:
    """A rule as patterns over host, BETWEEN, path: its host or any subdomain, and paths that start with its path.

    `*` and `?` in a rule stand for any run and any one byte; the byte BETWEEN is a fixed point of every
    pattern and occurs once in a URL, so no wildcard reaches from host to path.
    """
    token = {ord("*"): MANY, ord("?"): ANY}
    host, path = ([token.get(b, b) for b in s.encode()] for s in (rule.host, rule.path))
    return [[*host, BETWEEN, *path, MANY], [MANY, ord("."), *host, BETWEEN, *path, MANY]]


class Automaton:
    """All patterns at once, one bit per state, packed into as many 64-bit words as they need.

    Shift-And: the states after a byte are those before it, moved up by one where the byte fits, and those
    that stay because a `*` stands there. A pattern's start bit fits no byte, so nothing moves in from the
    pattern below it.
    """

    def __init__(self, patterns: list[list[int]]):
        fits: list[int] = [0] * 256
        self.accept: list[int] = []
        stays = starts = bit = 0
        for pattern in patterns:
            starts |= 1 << bit
            for token in pattern:
                if token == MANY:
                    stays |= 1 << bit
                    continue
                bit += 1
                for b in range(256) if token == ANY else (token,):
                    if token != ANY or b != BETWEEN:
                        fits[b] |= 1 << bit
            self.accept.append(bit)
            bit += 1
        self.words = (bit + 63) // 64
        self.fits = np.array([self._split(x) for x in fits], np.uint64)
        self.stays, self.starts = (np.array(self._split(x), np.uint64) for x in (stays, starts))

    def _split(self, bits: int) -> list[int]:
        return [bits >> (64 * i) & (1 << 64) - 1 for i in range(self.words)]

    def run(self, texts: list[bytes], cells: int = 1 << 21) -> np.ndarray:
        """(texts, patterns) booleans: which patterns each whole text matches. Texts of like length advance together."""
        out = np.zeros((len(texts), len(self.accept)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * (len(texts[order[b]]) + 1) <= cells:
                b += 1
            part = order[a:b]
            width = len(texts[part[-1]])
            matrix = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            lengths = np.array([len(texts[i]) for i in part])
            state = np.tile(self.starts, (len(part), 1))
            for t in range(width):
                first = int(np.searchsorted(lengths, t, side="right"))  # shorter ones have ended
                live = state[first:]
                moved = live << np.uint64(1)
                moved[:, 1:] |= live[:, :-1] >> np.uint64(63)
                state[first:] = (moved & self.fits[matrix[first:, t]]) | (live & self.stays)
            for p, bit in enumerate(self.accept):
                out[part, p] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
            a = b
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end.

    Both are empty for null and without ://.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(`id_col`, host, path, rule, verdict) per row: of the rules that fit the longest, else null and `default`.

    Equally long rules: the first given. Null and malformed URLs have an empty host and path, which no rule
    with a host fits. Repeated rows, null ids and empty tables pass through; other columns are not read.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    patterns = [p for i in order for p in globs(rules[i])]
    names = np.array([*[rules[i].text for i in order], None], object)
    verdicts = np.array([*[rules[i].verdict for i in order], default], object)
    machine = Automaton(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [h + bytes([BETWEEN]) + p for h, p in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True)]
            fit = machine.run(texts).reshape(len(texts), len(order), 2).any(axis=2)
            best = np.where(fit.any(axis=1), fit.argmax(axis=1), len(order)) if order else np.zeros(len(texts), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], names=["id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col(url_col).cast("string"))
    shaped = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    return shaped.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
         translate(regexp_extract(COALESCE(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(COALESCE(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT s.page_id, s.host, s.path, r.h || r.p AS rule, r.verdict,
         ROW_NUMBER() OVER (PARTITION BY s.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS n
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p)
)
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
