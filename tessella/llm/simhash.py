"""SimHash near-duplicates: fingerprints, and an exact tiled comparison of all of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import binary, free_names, join_hot, partitions, quoted, streamed_groups, written
from tessella.llm.components import connected_components, least_of, merged_labels

WORDS = 4  # a fingerprint of 64 bits is read as this many words of 16 bits
BITS = 16
_EPS = 1e-9

#: One lane of 8 bits for each bit of a byte, so 255 bytes add up without overflow.
_LANES = np.array([[(b >> i) & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def _shingles(text: bytes, width: int, seed: int) -> list[int]:
    """Hashes of the shingles of `width` words (A-Z lower-cased, ASCII white space between words).

    Shorter texts give one shingle of all their words, texts without words none.
    """
    words = text.lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    return [xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))]


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the 64-bit numbers have."""
    n, counts = len(h), np.zeros(64, np.int64)
    for a in range(0, n, 255 * 256):
        lanes = _LANES[h[a : a + 255 * 256].view(np.uint8).reshape(-1, 8)]
        counts += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of UTF-8 `text`: 64 bits of the multiset of its shingles; 0 for texts without words."""
    return _majority(np.array(_shingles(text, width, seed), "<u8"))


def shingle_set(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(np.array(_shingles(text, width, seed), "<u8"))


def wide_fingerprint(found: np.ndarray, words: int = 4) -> list[int]:
    """SimHash of a set of shingle hashes, `words` numbers of 64 bits; every word but the first mixes the hashes anew."""
    out = [_majority(found)]
    for k in range(1, words):
        h = found + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(_majority(h ^ (h >> np.uint64(29))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long: the unsigned fingerprint's bits) for every row. Null text counts as empty; no other column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in binary(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of x and y that differ by `radius` bits or less; a row is one or more words of 64 bits."""
    last = x.shape[1] - 1
    bits = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0]).astype(np.uint8 if last < 4 else np.uint16, copy=False)
    for w in range(1, last):
        bits += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    i, j = np.nonzero(bits <= radius)
    if last:  # of the last word only what is still near is looked at
        keep = bits[i, j].astype(np.int64) + np.bitwise_count(x[i, last] ^ y[j, last]) <= radius
        i, j = i[keep], j[keep]
    return i, j


def _tile_labels(x: np.ndarray, split: int | None, radius: int, step: int = 512) -> np.ndarray:
    """Labels that join the rows of x within `radius`: all of them, or where `split` is given those before it with those after.

    Rows go by ascending population count; strips whose counts differ beyond the radius are skipped.
    """
    label = np.arange(len(x))
    count = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    own = np.arange(len(x)) if split is None else np.arange(split)
    others = own if split is None else np.arange(split, len(x))
    own, others = own[np.argsort(count[own], kind="stable")], others[np.argsort(count[others], kind="stable")]
    for a in range(0, len(own), step):
        p = own[a : a + step]
        for b in range(a if split is None else 0, len(others), step):
            q = others[b : b + step]
            if count[q[0]] - count[p[-1]] > radius:
                break
            if count[p[0]] - count[q[-1]] > radius:
                continue
            i, j = _within(x[p], x[q], radius)
            label = merged_labels(label, p[i], q[j])
    return label


def near_pairs(tiled: DataFrame, moves: list[tuple[int, Column | None]], radius: int, block: int) -> DataFrame:
    """tiled(node long, w0 long, w1 ..., tile long) -> edges (u, v) that connect all nodes whose words differ by `radius` bits or less.

    Without a column node, w0 is the node. `moves` are the non-positive differences of tile numbers that may
    hold near nodes, 0 among them, each with a condition on the tile it starts from. Tiles are cut into
    blocks of about `block` nodes, each packed in one row. Every pair of blocks meets once: the visitors of a
    block are streamed past it, about as many at a time as it may hold itself. What is emitted is a spanning
    forest of what met, not all its pairs. The number of tiles must be bounded, for it is broadcast.
    """
    n = partitions(tiled.sparkSession)
    words = [c for c in tiled.columns if c.startswith("w")]
    packed = [c for c in tiled.columns if c != "tile"]
    tiles = tiled.groupBy("tile").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    tiles = F.broadcast(written(tiles, "tiles"))
    cut = tiled.join(tiles, "tile").withColumn("blk", F.pmod(F.xxhash64("w0"), F.col("blocks")).cast("int"))
    cut = written(cut.groupBy("tile", "blk").agg(F.collect_list(F.struct(*packed)).alias("held")), "blocks")
    # Of two blocks of one tile the home is that from which the other is less than half way round.
    ahead = F.pmod(F.col("b") - F.col("blk"), F.col("blocks"))
    half = (2 * ahead < F.col("blocks")) | ((2 * ahead == F.col("blocks")) & (F.col("b") > F.col("blk")))
    fits = F.col("s") == 0
    for s, condition in moves:
        if s:
            fits |= (F.col("s") == s) & (F.lit(True) if condition is None else condition)
    home = cut.select("tile", "blk", F.lit(0).alias("visits"), "held")
    visitor = cut.withColumn("s", F.explode(F.array(*[F.lit(s) for s, _ in moves]))).withColumn("tile", F.col("tile") - F.col("s")).where(fits).join(tiles, "tile")
    visitor = visitor.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where((F.col("s") != 0) | ((F.col("b") != F.col("blk")) & half))
    visitor = visitor.select("tile", F.col("b").alias("blk"), F.lit(1).alias("visits"), "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(node: np.ndarray, x: np.ndarray, split: int | None) -> Iterator[pa.RecordBatch]:
            least = least_of(node, _tile_labels(x, split, radius))
            moved = np.flatnonzero(node != least)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(least[moved])], names=["u", "v"])

        def met() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                yield from edges(*(np.concatenate(p) for p in zip(*held, strict=True)), len(held[0][0]))
                del held[1:]

        current, held = None, []
        for batch in batches:
            for k, (tile, blk, visits) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "blk", "visits")), strict=True)):
                flat = batch.column("held").slice(k, 1).flatten()
                columns = {c: flat.field(i).to_numpy(zero_copy_only=False) for i, c in enumerate(packed)}
                node, x = columns.get("node", columns["w0"]), np.stack([columns[w] for w in words], axis=1).view(np.uint64)
                if not visits:
                    yield from met()
                    current, held = (tile, blk), [(node, x)]
                    yield from edges(node, x, None)
                elif current == (tile, blk):
                    held.append((node, x))
                    if sum(len(h[0]) for h in held[1:]) >= block:
                        yield from met()
        yield from met()

    return home.unionByName(visitor).repartition(n, "tile", "blk").sortWithinPartitions("tile", "blk", "visits").mapInArrow(run, "u long, v long")


def close_fingerprints(distinct: DataFrame, radius: int = 2, block: int = 1 << 15) -> DataFrame:
    """distinct(fp long, no repeats) -> edges (u, v) that connect all fingerprints within `radius` bits.

    Tiles are the vectors of population counts of the four 16-bit words. Two fingerprints within the
    radius differ by at most the radius in the sum of those counts' differences, so tile pairs beyond it
    are skipped and all others are compared whole (exclusive-or and bit counts): nothing is missed.
    """
    side = BITS + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))) for i in range(WORDS)]
    weight = [side ** (WORDS - 1 - i) for i in range(WORDS)]
    tile = sum((c.cast("long") * w for c, w in zip(counts, weight, strict=True)), F.lit(0).cast("long"))
    # A move that leaves the range of one count lands on a tile that is too far: such pairs are left out.
    moves = []
    for d in product(range(-radius, radius + 1), repeat=WORDS):
        s = sum(x * w for x, w in zip(d, weight, strict=True))
        if sum(map(abs, d)) <= radius and s <= 0:
            inside = F.lit(True)
            for x, w in zip(d, weight, strict=True):
                if x:
                    inside &= (F.floor(F.col("tile") / w) % side + x).between(0, BITS)
            moves.append((s, inside))
    # At most 17^4 tiles, whatever the input.
    return near_pairs(distinct.select(F.col("fp").alias("w0"), tile.alias("tile")), moves, radius, block)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: (`id_col`, fingerprint of 16 hex digits, component_id).

    Documents link when their fingerprints differ by `radius` bits or less, and component_id is the
    smallest id reachable, the document itself included. Null or empty texts have fingerprint 0 and link
    like any other; repeated rows and repeated ids stay as they are (rows of one id may differ in
    fingerprint); a row with a null id never gives its id to a component, and its component_id is null
    when no other row is reachable. An empty table gives an empty result; extra columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    nodes = connected_components(close_fingerprints(classes.select("fp"), radius))
    linked = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    linked = written(linked, "linked")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = written(linked.join(smallest, "component").select("fp", "component_id", "copies"), "judged")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_hot(fps, by_class, "fp", "copies").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _name(found: np.ndarray) -> int:
    """A set's name: the hash of all that is in it, as a signed long."""
    h = xxhash.xxh64_intdigest(found.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def similar_sets(classes: DataFrame, docs: DataFrame, width: int, least: float, radius: int, block: int = 1 << 14, room: int = 1 << 21, most: int = 1 << 11) -> DataFrame:
    """classes(node, id, n, w0, ...), docs(id, text) -> edges (u, v) of Jaccard `least` or more that connect all sets so similar within `radius` bits.

    Tiles are classes of set size a factor of `least` apart, so a set is compared with its own tile and the
    next; all of that is compared by fingerprint. The candidate groups that arise are then compared by the
    sets themselves, made anew from one text each. A group is cut into blocks of about `room` shingles or
    `most` sets, every two of which meet in one task. Inside it pairs that are already connected are skipped,
    so a group of n copies takes about n exact comparisons.
    """
    n = partitions(classes.sparkSession)
    words = [c for c in classes.columns if c.startswith("w")]
    step = -np.log(least) * (1 + 1e-9)
    # A set as near to another has at least as many shingles.
    able = classes.where(F.col("n") >= least / (1 - least) - _EPS) if least < 1 else classes.where("false")
    tiled = able.select("node", *words, F.floor(F.ln("n") / F.lit(step)).alias("tile"))
    groups = written(connected_components(near_pairs(tiled, [(0, None), (-1, None)], radius, block)), "groups")
    wanted = written(groups.join(classes, "node"), "wanted")
    # Written, so that its size is known: Spark itself then broadcasts it or, beyond its threshold, shuffles.
    ids = written(wanted.select(F.col("id").alias("wanted_id")).distinct(), "ids")
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends each set once
        for batch in batches:
            made = {_name(x): x.tobytes() for x in (shingle_set(t, width) for t in binary(batch.column(0)))}
            new = [k for k in made if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([made[k] for k in new], pa.binary())], names=["node", "elements"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), group in streamed_groups(batches, 3):
            group = group.take(np.unique(group.column("node").to_numpy(), return_index=True)[1])
            node = group.column("node").to_numpy()
            x = np.stack([group.column(c).to_numpy() for c in words], axis=1).view(np.uint64)
            found = [np.frombuffer(e, np.uint64) for e in group.column("elements").to_pylist()]
            mine = group.column("mine").to_numpy()
            first = least_of(node, _verified(x, found, None if a == b else mine == a, least, radius))
            moved = np.flatnonzero(node != first)
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(first[moved])], names=["u", "v"])

    totals = wanted.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("members"))
    big = totals.select("component", F.ceil(F.greatest(F.col("total") / room, F.col("members") / most)).cast("int").alias("blocks")).where("blocks > 1")
    placed = wanted.join(big, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = texts.mapInArrow(sets, "node long, elements binary").join(written(placed.drop("id", "n"), "placed"), "node")
    met = placed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.greatest("mine", "c").alias("a"), F.least("mine", "c").alias("b"), "node", "mine", *words, "elements")
    key = ["component", "a", "b"]
    return met.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(check, "u long, v long")


def _shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set `one` are in each of the others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    edges = np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), edges)


def _verified(x: np.ndarray, sets: list[np.ndarray], home: np.ndarray | None, least: float, radius: int, step: int = 256) -> np.ndarray:
    """Labels that join all pairs of Jaccard `least` or more within `radius` bits: among all, or of `home` with the others."""
    size = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    own = np.arange(len(sets)) if home is None else np.flatnonzero(home)
    others = own if home is None else np.flatnonzero(~home)
    for a in range(0, len(own), step):
        part = own[a : a + step]
        i, j = _within(x[part], x[others], radius)
        p, q = part[i], others[j]
        fits = (np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]) - _EPS) & ((q < p) | (home is not None))
        p, q = p[fits], q[fits]
        order = np.lexsort((np.bitwise_count(x[p] ^ x[q]).sum(axis=1, dtype=np.int64), p))  # of each set's partners the nearest first
        p, q = p[order], q[order]
        if not len(p):
            continue
        edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        for s, e in zip(edges, [*edges[1:], len(p)], strict=True):
            one, rest, take = int(p[s]), q[s:e], 1
            while len(rest := rest[label[rest] != label[one]]):
                tried, rest = rest[:take], rest[take:]
                shared = _shared(sets[one], [sets[k] for k in tried])
                for k in tried[shared >= least * (size[one] + size[tried] - shared) - _EPS].tolist():
                    label[label == label[k]] = label[one]
                take = min(2 * take, 1024)
    return label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, words: int = 4, radius: int = 72) -> DataFrame:
    """The rows of `docs`, all columns, of which one stays for each group of near-duplicates: that of the smallest id.

    Documents link when the sets of their shingles of `width` words have Jaccard `least` or more; groups are
    what links connect. Candidates are the fingerprints of 64 * `words` bits within `radius` bits, compared
    in tiles; each is then checked by its sets, so nothing unlike is dropped. At Jaccard 0.8 two fingerprints
    of 256 bits differ by 39 bits, or 48 for sets of four and five, with a deviation of 6: 72 loses no link
    in a million, of the smallest sets 6 in 100,000. Null or empty texts are copies of each other and near to
    nothing else. What stays is chosen by id and shingle set, so rows of one id whose texts differ are judged
    apart; a row with a null id stays only where its group has no other id; of rows that repeat both, one
    stays. Columns of any name pass through. An empty table gives an empty result.
    """
    shaped = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    bits = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in binary(batch.column(1))]
            x = np.array([wide_fingerprint(s, words) for s in sets], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_name, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), *[pa.array(x[:, k]) for k in range(words)]], names=["id", "node", "n", *bits])

    rows = written(shaped.mapInArrow(run, f"id long, node long, n int, {', '.join(f'{b} long' for b in bits)}"), "shingled")
    classes = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in bits], F.count("*").alias("copies"))
    classes = written(classes, "classes")
    groups = connected_components(similar_sets(classes.drop("copies"), shaped, width, least, radius))
    named = written(classes.select("node", "id", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    chosen = named.groupBy("component").agg(first.alias("s")).select("component", F.col("s.id").alias("kept_id"), F.col("s.node").alias("kept_node"))
    by_node = written(named.join(chosen, "component").select("node", "kept_id", "kept_node", "copies"), "chosen")
    gone = ~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node")))
    dropped = written(join_hot(rows.select("id", "node"), by_node, "node", "copies").where(gone).select("id", "node").distinct(), "dropped")
    own_id, own_node, gone_id, gone_node = free_names(docs, 4)
    identity = docs.withColumn(own_id, F.col(quoted(id_col)).cast("long"))
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return identity.join(dropped.select(F.col("id").alias(gone_id)), F.col(own_id) == F.col(gone_id), "left_anti").drop(own_id)

    @F.pandas_udf("long")
    def node(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: _name(shingle_set((t or "").encode(), width))).astype("int64")

    identity = identity.withColumn(own_node, node(F.col(quoted(text_col)).cast("string")))
    gone_too = dropped.select(F.col("id").alias(gone_id), F.col("node").alias(gone_node))
    kept = identity.join(gone_too, F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_node) == F.col(gone_node)), "left_anti")
    return kept.dropDuplicates([own_id, own_node]).drop(own_id, own_node)
