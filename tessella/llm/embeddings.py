"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import join_hot, partitions, quoted, written
from tessella.llm.components import connected_components, least_of, merged_labels


SAMPLE_BYTES = 1 << 26  # of the vectors on which centroids are fit


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; a cell that loses all its rows is given the row worst served."""
    rng = np.random.default_rng(seed)
    centroids = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))].copy()
    for _ in range(rounds):
        parts = (x[a : a + 4096] @ centroids.T for a in range(0, len(x), 4096))
        nearest, best = (np.concatenate(found) for found in zip(*((d.argmax(axis=1), d.max(axis=1)) for d in parts), strict=True))
        worst = np.argsort(best, kind="stable")
        order = np.argsort(nearest, kind="stable")
        edges = np.searchsorted(nearest[order], np.arange(len(centroids) + 1))
        for c in range(len(centroids)):
            members = x[order[edges[c] : edges[c + 1]]]
            total = members.sum(axis=0) if len(members) else x[worst[c % len(x)]]
            norm = np.linalg.norm(total)
            if norm > 0:
                centroids[c] = total / norm
    return centroids


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows, none of them zero, as unit vectors: first over their largest component, so that no norm under- or overflows."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as unit vectors in double precision."""
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


class _Block:
    """One block of a cell: its own vectors, compared with each other, and then visitors as they come.

    Holds the block and a strip of products, never all visitors.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: float, strip: int = 1 << 22):
        self.node, self.copies, self.x = (np.concatenate(p) for p in zip(*parts, strict=True))
        self.least, self.step = least, max(1, strip // len(self.node))
        self.links = np.zeros(len(self.node))
        self.label = np.arange(len(self.node))
        for a in range(0, len(self.node), self.step):
            close = self.x[a : a + self.step] @ self.x.T >= least
            i = np.arange(len(close))
            close[i, a + i] = False
            self.links[a : a + len(close)] = close @ self.copies
            i, j = np.nonzero(close & (self.label[a : a + len(close), None] != self.label[None]))
            self.label = merged_labels(self.label, i + a, j)
        self.first = least_of(self.node, self.label)

    def meet(self, node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(node), self.step):
            close = x[a : a + self.step] @ self.x.T >= self.least
            found = np.flatnonzero(close.any(axis=1))
            if not len(found):
                continue
            close = close[found]
            self.links += copies[a + found] @ close
            yield _found(node[a + found], close @ self.copies)
            i, j = np.nonzero(close)
            i, first = np.unique(np.stack([found[i], self.first[j]]), axis=1)
            yield _found(node[a + i], np.zeros(len(i)), first)

    def close(self) -> Iterator[pa.RecordBatch]:
        linked = np.flatnonzero(self.links)
        yield _found(self.node[linked], self.links[linked])
        moved = np.flatnonzero(self.node != self.first)
        yield _found(self.node[moved], np.zeros(len(moved)), self.first[moved])


def _found(node: np.ndarray, links: np.ndarray, peer: np.ndarray | None = None) -> pa.RecordBatch:
    other = pa.nulls(len(node), pa.int64()) if peer is None else pa.array(peer)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), other], names=["node", "links", "peer"])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, cells: int | None = None, margin: float | None = None, sample: int = 1 << 15, block: int = 8192
) -> DataFrame:
    """One row per vector: (`id_col`, n_links, component_id, kept).

    Equal vectors are one node with a count. A node lives in the cell of its nearest centroid and also
    visits each earlier cell whose centroid it is nearly as close to: the two dot products differ by at
    most `margin` times the centroids' distance. Unless given, that is the farthest apart that unit vectors of
    cosine `least` are, sqrt(2 - 2 * least), and nothing is missed: of two that differ by less, the one nearer to
    its own centroid by more than this could not have the other beyond the plane between the two. A smaller
    margin misses pairs. All pairs of a cell, visitors included, are compared in blocks of double-precision
    products; only pairs of cosine `least` or more count. The centroids are fit on at most `sample` nodes (and
    64 MB of them), those of least hash; every row is indexed. Unless given, their number is one for 4096 nodes, 16 at least (of 1024
    nodes or more) and at most one for 8 of the sample; a cell of more than `block` nodes is cut into blocks.
    A task holds one block and streams the visitors past it. Vectors without clusters are near to half of all
    cells, whatever their number.

    n_links counts other rows, copies included; component_id is the smallest id reachable and kept says
    that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of different lengths don't link with each other. Tiny and huge components
    count as they are, for vectors are scaled before their norm is taken. A row with a null id
    counts as nobody's link: its n_links is 0, its component_id null and kept true. Rows that repeat an id
    are rows of their own. An empty table gives an empty result; extra columns are not read.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # half the bytes, and exact in double
    kind = "array<float>" if single else "array<double>"
    # Adding zero turns a negative zero into the one that it equals.
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.transform(F.col(quoted(vector_col)).cast(kind), lambda x: x + F.lit(0).cast("float" if single else "double")).alias("v"))
    usable = F.coalesce(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    rows = written(rows.withColumn("ok", usable), "vectors")
    distinct = written(rows.where("ok").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "distinct")
    seed = 0  # a node is named by the hash of its vector, under the first seed that gives each its own
    while not distinct.groupBy(F.xxhash64("v", F.lit(seed))).count().where("count > 1").isEmpty():
        seed += 1
    nodes = distinct.withColumn("node", F.xxhash64("v", F.lit(seed)))
    n_nodes = distinct.count()
    margin = np.sqrt(max(0, 2 - 2 * least)) if margin is None else margin
    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # centroids, and how much farther than the nearest a cell may be
    widest = distinct.agg(F.max("dim")).first()[0] or 1
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * widest)))
    picked = nodes.orderBy("node").limit(sample).select("node", "dim", "v").toPandas().sort_values("node")
    for dim, part in picked.groupby("dim"):
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        centroids = spherical_kmeans(_scaled(x), cells or max(1, min(len(x) // 8, max(n_nodes // 4096, min(16, n_nodes // 64)))))
        fitted[int(dim)] = centroids, margin * np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) + 1e-9  # rounding

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = _unit(part.column("v"))
                centroids, slack = fitted.get(int(dim), (np.eye(1, int(dim)), np.zeros((1, 1))))
                dots = x @ centroids.T
                own = dots.argmax(axis=1)
                near = dots.max(axis=1)[:, None] - dots <= slack[own]
                near &= np.arange(len(centroids))[None] <= own[:, None]
                row, cell = np.nonzero(near)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array((cell == own[row]).astype(np.int32)), taken.column("node"), taken.column("copies"), taken.column("v")],
                    names=["dim", "cell", "home", "node", "copies", "v"],
                )

    placed = nodes.select("dim", "node", "copies", "v").mapInArrow(place, f"dim int, cell int, home int, node long, copies long, v {kind}")
    placed = written(placed, "placed")
    blocks = placed.where("home = 1").groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    spread = (
        placed.join(blocks, ["dim", "cell"])
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("blk", F.explode(F.sequence(F.lit(0), F.when(F.col("home") == 1, F.col("mine")).otherwise(F.col("blocks") - 1))))
        .select("dim", "cell", "blk", ((F.col("home") == 0) | (F.col("blk") != F.col("mine"))).cast("int").alias("visits"), "node", "copies", "v")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own, met = None, [], None
        for batch in (b for b in batches if b.num_rows):
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)  # dim, cell, block and whether it visits
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                part, key = batch.slice(a, b - a), tuple(keys[a, :3])
                if key != current:
                    if own or met:
                        yield from (met or _Block(own, least)).close()
                    current, own, met = key, [], None
                held = part.column("node").to_numpy(), part.column("copies").to_numpy().astype(np.float64), _unit(part.column("v"))
                if keys[a, 3] == 0:
                    own.append(held)
                elif own or met:
                    met, own = met or _Block(own, least), []
                    yield from met.meet(*held)
        if own or met:
            yield from (met or _Block(own, least)).close()

    key = ["dim", "cell", "blk"]
    found = written(spread.repartition(partitions(spark), *key).sortWithinPartitions(*key, "visits").mapInArrow(compare, "node long, links long, peer long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("peer is not null").select(F.col("node").alias("u"), F.col("peer").alias("v")))
    judged = nodes.select("node", "least", "copies").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    judged = written(judged, "judged")
    smallest = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = judged.join(smallest, "component").select("node", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = join_hot(rows.where("ok").select("id", F.xxhash64("v", F.lit(seed)).alias("node")), written(judged, "components"), "node", "copies").select("id", "n_links", "component_id")
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
