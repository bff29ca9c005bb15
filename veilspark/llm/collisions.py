"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Each table has one random projection, by which vectors are sorted, and a few random sign bits, which cut the sorted list into cells: by
the projections alone any two vectors, however far apart, would meet in some window.  Pairs within a window around each vector are counted over
all tables; those that pass the count are verified in double precision.  Tables, window and count follow from the recall wanted
at the limit.  Cells that many vectors share are compared in tiles instead, which give sums and a forest, never their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .simhash import _mixed, _star, components

SEED = 11
#: Window on each side, in standard deviations of the difference of two vectors at the limit.
WINDOW = 1.5
#: Collisions that a pair needs.
COUNT = 2
#: Vectors a cell from which on it is compared in tiles, and rows of a tile's side.
CROWDED, BLOCK = 128, 2048
#: Most rows of crowded cells that are broadcast (8 bytes each).
SENT_CELLS = 100_000


def calibrate(n: int, least: float, recall: float) -> tuple[int, int, float]:
    """Sign bits a table, tables and the window for n vectors, such that a pair at the limit has COUNT collisions with that probability.

    Bits grow with the logarithm of n, so a cell keeps about 16 vectors, and tables with a small power of n.
    """
    bits = max(2, math.ceil(math.log2(max(2, n))) - 4)
    apart = math.sqrt(2 - 2 * least)
    # A difference's projection is normal with the distance as deviation; a sign is the same unless the hyperplane parts the pair.
    p = (1 - math.acos(least) / math.pi) ** bits * math.erf(WINDOW / math.sqrt(2))
    tables = COUNT
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COUNT)) > 1 - recall:
        tables += 1
    return bits, tables, WINDOW * apart


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so that no square overflows."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(v: Column) -> Column:
    """Whether a vector has a direction: neither null, empty nor zero, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """The lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists in that column have the same length."""
    size = np.diff(batch.column(column).offsets.to_numpy())
    for n in np.unique(size):
        yield batch if (size == n).all() else batch.take(pa.array(np.flatnonzero(size == n)))


def cells(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """own, t, cell, at (the place in the table's projection): a row for each vector of distinct (own, v) and table."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        power = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            for own in _by_length(batch, 1):
                for i in range(0, own.num_rows, 2048):
                    part = own.slice(i, 2048)
                    x = unit(_matrix(part.column(1)))
                    n = x.shape[1]
                    if n not in lines:
                        lines[n] = np.random.default_rng([SEED, n]).standard_normal((n, tables * (bits + 1)))
                    y = (x @ lines[n]).reshape(len(x), tables, bits + 1)
                    code = (y[:, :, 1:] > 0).astype(np.uint64) @ power
                    # Vectors of other lengths never share a cell.
                    cell = _mixed(code ^ _mixed(np.arange(tables, dtype=np.uint64) << np.uint64(32) | np.uint64(n), 1), 2)
                    arrays = [np.repeat(part.column(0).to_numpy(), tables), np.tile(np.arange(tables, dtype=np.int32), len(x)), cell.reshape(-1).view(np.int64), y[:, :, 0].reshape(-1)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["own", "t", "cell", "at"])

    return distinct.select("own", "v").mapInArrow(build, "own long, t int, cell long, at double")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ordered by their first column, cut such that equal values stay together."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = held.column(0).to_numpy()
        if cut := int(np.searchsorted(key, key[-1])):
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def window_pairs(rows: DataFrame, window: float) -> DataFrame:
    """a, b: pairs of rows (own, cell, at) of one cell that lie within each other's window, once for each table."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches):
            cell, at, own = (batch.column(i).to_numpy() for i in range(3))
            now = np.arange(len(cell))
            step = 1
            while True:
                now = now[now + step < len(cell)]
                now = now[(cell[now] == cell[now + step]) & (at[now + step] - at[now] <= window)]
                if not len(now):
                    break
                a, b = own[now], own[now + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                step += 1

    ordered = rows.select("cell", "at", "own").repartition("cell").sortWithinPartitions("cell", "at")
    return ordered.mapInArrow(pairs, "a long, b long")


def verified(pairs: DataFrame, distinct: DataFrame, crowd: DataFrame, least: float) -> DataFrame:
    """a, b, ma, mb of pairs (a, b) whose cosine is at least ``least`` and that share no crowded cell; ma, mb: how many copies they have."""
    rows = distinct.join(crowd, "own", "left").select("own", "v", "m", "crowded")
    side = lambda x: rows.select(F.col("own").alias(x), F.col("v").alias(f"v{x}"), F.col("m").alias(f"m{x}"), F.col("crowded").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(~F.coalesce(F.arrays_overlap("ca", "cb"), F.lit(False)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch, 4):
                keep = (unit(_matrix(part.column(4))) * unit(_matrix(part.column(5)))).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:4]], names=["a", "b", "ma", "mb"])

    return both.select("a", "b", "ma", "mb", "va", "vb").mapInArrow(check, "a long, b long, ma long, mb long")


def crowded_links(crowded: DataFrame, sizes: DataFrame, distinct: DataFrame, crowd: DataFrame, tables: int, least: float) -> DataFrame:
    """own, links, other: within crowded cells (own, t, cell), what each tile adds to a vector's links, and one that it is connected with.

    A pair that shares several crowded cells counts in the first table alone.
    """
    parts = sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts"))
    placed = crowded.join(parts, "cell").withColumn("p", F.pmod(F.xxhash64("own"), F.col("parts")))
    units = placed.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = units.join(distinct.select("own", "v", "m"), "own").join(crowd, "own")
    low, high = F.least("p", "q"), F.greatest("p", "q")
    rows = rows.select(F.xxhash64("cell", low, high).alias("unit"), "t", (F.col("p") > F.col("q")).cast("int").alias("side"), (F.col("p") == F.col("q")).cast("int").alias("same"), "own", "m", "shared", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches):
            unit_of = batch.column(0).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(unit_of)) + 1, [len(unit_of)]])
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                rows = batch.slice(i, j - i)
                table, side, same = rows.column(1)[0].as_py(), rows.column(2).to_numpy(), rows.column(3)[0].as_py()
                own, m, shared, x = rows.column(4).to_numpy(), rows.column(5).to_numpy(), _matrix(rows.column(6), np.int64), unit(_matrix(rows.column(7)))
                left = np.flatnonzero(side == 0)
                right = left if same else np.flatnonzero(side == 1)
                links, label = np.zeros(len(own), np.int64), np.arange(len(own))
                for k in range(0, len(left), 256):
                    a = left[k : k + 256]
                    hit = x[a] @ x[right].T >= least
                    for before in range(table):
                        if not hit.any():
                            break
                        s = shared[a, before]
                        hit &= (s[:, None] != shared[right, before]) | (s == 0)[:, None]
                    u, w = np.nonzero(hit)
                    u, w = a[u], right[w]
                    u, w = (y[u < w] if same else y for y in (u, w))
                    np.add.at(links, u, m[w])
                    np.add.at(links, w, m[u])
                    if len(u):
                        _star(u, w, label)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(links[some]), pa.array(own[label[some]])], names=["own", "links", "other"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "own long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id (smallest id reached by links, its own included), kept (id = component_id) of every row of ``vectors``.

    Two vectors of one length link if they are found and their cosine is at least ``least``; a pair at the limit is found with
    probability ``recall``, closer ones more surely, equal ones always.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of different lengths.  Rows that repeat link with each other.  Null ids
    take part; they are a component's id only where all of it is null.  Other columns are not read.  An empty table gives an empty result.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(v), v.cast("array<double>")).alias("v"))
    # Copies meet by 128 bits of hashes.
    rows = materialise(rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit("again"), "v")}), "vectors")
    some = rows.where("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("m"))
    distinct = materialise(some.withColumn("own", F.monotonically_increasing_id()), "vectors-distinct")
    bits, tables, window = calibrate(distinct.count(), least, recall)
    dealt = materialise(cells(distinct, bits, tables), "vectors-cells")
    sizes = materialise(dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED), "vectors-crowded")
    sent = F.broadcast(sizes) if sizes.count() <= SENT_CELLS else sizes
    crowded = materialise(dealt.join(sent, "cell", "left_semi").select("own", "t", "cell"), "vectors-in-crowds")
    # At most one cell a table: 0 where a vector is in no crowd.
    places = F.map_from_entries(F.collect_list(F.struct("t", "cell")))
    shared = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.coalesce(F.try_element_at("places", t), F.lit(0).cast("long")))
    crowd = crowded.groupBy("own").agg(places.alias("places")).select("own", shared.alias("shared"), F.map_values("places").alias("crowded"))
    crowd = materialise(crowd, "vectors-crowd")
    counted = window_pairs(dealt.join(sent, "cell", "left_anti"), window).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT)
    pairs = materialise(verified(counted.select("a", "b"), distinct, crowd.select("own", "crowded"), least), "vectors-pairs")
    tiles = materialise(crowded_links(crowded, sizes, distinct, crowd.select("own", "shared"), tables, least), "vectors-tiles")
    ends = pairs.select(F.col("a").alias("own"), F.col("mb").alias("links")).union(pairs.select("b", "ma")).union(tiles.select("own", "links"))
    links = ends.groupBy("own").agg(F.sum("links").alias("links"))
    edges = pairs.select("a", "b").union(tiles.select(F.col("own").alias("a"), F.col("other").alias("b")))
    roots = materialise(components(edges, "vectors-components"), "vectors-roots")
    full = distinct.join(links, "own", "left").join(roots, distinct["own"] == roots["node"], "left")
    full = materialise(full.select("k1", "k2", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "own").alias("root")), "vectors-full")
    ids = full.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = full.join(ids, "root").select("k1", "k2", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.where("v is not null").select("id", "k1", "k2").join(by_key, ["k1", "k2"]).select("id", "n_links", "component_id")
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
