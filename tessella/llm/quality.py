"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary, quoted

FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "log_longest_word", "upper", "lower", "digit", "space", "stop", "bang", "pipe", "symbol",
    "non_ascii", "distinct_words", "top_word", "adjacent_repeats", "all_caps_words", "log_lines", "mean_line", "repeated_lines", "marked_words",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?'\"()-", "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "non_ascii": bytes(range(128, 256)),
}
_CLASS_OF = np.array([[float(b in members) for members in _CLASSES.values()] for b in range(256)])
_MARKS = tuple(bytes([c]) for c in _CLASSES["symbol"] + b"!|")


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES. Empty texts give zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [np.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    shares = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS_OF / n).tolist()
    k = len(words)
    lengths = np.fromiter(map(len, words), np.int64, k)
    counts = Counter(words)
    lines = text.split(b"\n")
    return [
        np.log1p(n), np.log1p(k), lengths.mean(), lengths.std(), np.log1p(lengths.max()), *shares,
        len(counts) / k, max(counts.values()) / k, sum(map(eq, words[1:], words)) / k, sum(w.isupper() for w in words) / k,
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(w.endswith(_MARKS) for w in words) / k,
    ]


@dataclass
class Trees:
    """A boosted ensemble, flattened: row t of each array is one complete tree in heap order."""

    prior: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    value: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x; all rows and trees descend one level at a time."""
        trees, inner = self.feature.shape
        margin = np.full(len(x), self.prior)
        if trees:
            t = np.arange(trees)
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                row = np.arange(len(part))[:, None]
                node = np.zeros((len(part), trees), np.int64)
                while node[0, 0] < inner:
                    node = 2 * node + 1 + (part[row, self.feature[t, node]] > self.threshold[t, node])
                margin[a : a + 2048] += self.value[t, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting on binned features. No rows give probability 1/2; one class gives its smoothed share."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(d) * bins
    feature, threshold, value = [], [], []
    margin = np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, thr = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (d * bins) + flat).ravel()
            total = lambda w: np.bincount(slot, np.repeat(w, d), width * d * bins).reshape(width, d, bins)  # noqa: B023, E731
            left_g, left_h, left_n = (total(w).cumsum(axis=2) for w in (g, h, np.ones(len(y))))
            all_g, all_h, all_n = (v[:, :, -1:] for v in (left_g, left_h, left_n))
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_n < least) | (all_n - left_n < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    f[first + k], thr[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > thr[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += v[leaf]
        feature.append(f), threshold.append(thr), value.append(v)
    return Trees(prior, np.array(feature), np.array(threshold), np.array(value))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that no label is learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Trees:
    """Learns from at most `sample` labelled documents (a documented bound of this fit alone): those of least hash.

    Labels of held-out ids, null labels or ids, labels other than 0 and 1, and ids with both labels are
    left out; of rows that repeat an id that of the least text hash is used. No usable label gives a model that says 1/2.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("y2"))
        .where("y = y2")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
        .select("id", "y")
    )
    picked = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in binary(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), *batch.columns[2:]], names=["id", "x", "y", "h"])

    rows = picked.select("id", "text", "y", F.xxhash64("text").alias("h")).mapInArrow(run, "id long, x array<double>, y int, h long")
    rows = rows.groupBy("id").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("id", "r.x", "r.y").toPandas().sort_values("id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep_cols: list[str] | None = None) -> DataFrame:
    """(`id_col`, score, predicted) per row, with `keep_cols` in between. Null text counts as empty and is scored too."""
    kept = keep_cols or []
    names = [f"c{i}" for i in range(len(kept))]
    shaped = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), *[F.col(quoted(c)).alias(n) for c, n in zip(kept, names, strict=True)])
    types = "".join(f", {n} {shaped.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in binary(batch.column(1))]).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[batch.column(2 + i) for i in range(len(kept))], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=["id", *names, "score", "predicted"],
            )

    scored = shaped.mapInArrow(run, f"id long{types}, score double, predicted int")
    return scored.select(F.col("id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """Trains on `labels` and scores every row: (`id_col`, held_out, score 0..1, predicted).

    Only the text is an input of a score, so equal texts score alike. Null and empty texts get a score;
    repeated rows stay; a null id is scored with held_out false; empty tables give an empty result or,
    without labels, the score 1/2; extra columns are not read.
    """
    scored = score(docs, train(docs, labels, id_col, text_col, sample=sample), id_col, text_col, threshold)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more. The row itself is judged, so nothing is joined back; columns of any name pass through."""
    model = train(docs, labels, id_col, text_col, sample=sample)
    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in binary(batch.column(at).cast(pa.string()))]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows.mapInArrow(judge, rows.schema).toDF(*docs.columns)
