"""SimHash near-duplicates: exact linking of fingerprints by tiles, and connected components.

Fingerprints are made distinct first.  Of 64 bits, two that differ in at most ``radius`` agree in one of radius + 1 blocks of
bits (or, for many fingerprints, in several of more blocks), so all pairs meet in the buckets of some block.  Longer
fingerprints of several lanes, for wide radii, meet in the buckets of sampled bits.  Within a bucket, tiles ordered by population
count are compared exactly with numpy, skipping tiles that are too far apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, unused

SEED = 42
#: Bits of a sampled key at least; a table more of them halves the rows of a bucket.
KEY_BITS = 12
_GOLDEN = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split() parts at 0x20 and 0x09-0x0D."""
    return text.lower().split()


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Another 64 bits for each hash, for lanes from 1 on."""
    x = h + np.uint64(lane * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(words: list[bytes], size: int = 3, lanes: int = 1) -> np.ndarray:
    """SimHash of 64 bits a lane over all shingles, repeats included; fewer words: one shingle; none: 0.  The first lane's hash is XXH64."""
    if not words:
        return np.zeros(lanes, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))], np.uint64)
    ones = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i : i + 16384]
        wide = np.stack([part, *(_mixed(part, lane) for lane in range(1, lanes))], axis=1).astype(">u8")
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.frombuffer(np.packbits(2 * ones > len(h)).tobytes(), ">u8").astype(np.uint64)


def _lanes(n: int) -> list[str]:
    return [f"f{i}" for i in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id, f0, f1, ... (64 bits each as a signed long).  A null text has no words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(words_of(x.as_py() or b""), size, lanes) for x in batch.column(1)], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(values[:, i]).view(np.int64)) for i in range(lanes))], names=["doc_id", *_lanes(lanes)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(build, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _lanes(lanes)))


def block_tables(n: int, radius: int) -> list[list[int]]:
    """Tables (lists of bits) for one lane: of 64 bits cut into m blocks a pair within the radius agrees in m - radius at least.

    Each choice of that many blocks is one table, so no pair is missed; more blocks as fingerprints grow in number.
    """
    m = radius + 1 if n < 2**22 else radius + 2 if n < 2**28 else radius + 3
    edges = [64 * i // m for i in range(m + 1)]
    return [[bit for b in blocks for bit in range(edges[b], edges[b + 1])] for blocks in combinations(range(m), m - radius)]


def sampled_tables(n: int, radius: int, lanes: int, recall: float) -> list[list[int]]:
    """Tables of bits drawn once for all (not by the data) for several lanes: a pair at the radius agrees in one of them with probability ``recall``.

    More bits a table as fingerprints grow in number, and so more tables.  Closer pairs are found all the more surely.
    """
    bits = max(KEY_BITS, math.ceil(math.log2(max(2, n))) - 6)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - radius / (64 * lanes)) ** bits))
    return [np.random.default_rng([SEED, t]).permutation(64 * lanes)[:bits].tolist() for t in range(tables)]


def bucket_rows(distinct: DataFrame, tables: list[list[int]], lanes: int) -> DataFrame:
    """bucket, id, pop, f0, f1, ...: each fingerprint of distinct (id, f0, ...) once for each table."""
    names = ["bucket", "id", "pop", *_lanes(lanes)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                own = np.stack([part.column(1 + lane).to_numpy() for lane in range(lanes)], axis=1)
                bits = np.unpackbits(own.astype(">i8").view(np.uint8).reshape(len(own), -1), axis=1).astype(np.uint64)
                pop = pa.array(bits.sum(axis=1).astype(np.int32))
                for t, places in enumerate(tables):
                    key = bits[:, places] @ (np.uint64(1) << np.arange(len(places), dtype=np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(key ^ _mixed(np.array([t], np.uint64), 1), 2).view(np.int64)), part.column(0), pop, *part.columns[1 : 1 + lanes]], names=names)

    return distinct.select("id", *_lanes(lanes)).mapInArrow(build, "bucket long, id long, pop int, " + ", ".join(f"{c} long" for c in _lanes(lanes)))


def _star(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Join the classes of the pairs (a, b) in label (an index of a smaller or equal member for each row)."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if np.array_equal(before, label):
            return


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints whose lanes are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def link_tile(fp: np.ndarray, pop: np.ndarray, radius: int, tile: int = 256) -> np.ndarray:
    """For each fingerprint (rows of lanes, ordered by population count) the index of one it is connected with: a forest of all links."""
    n, label = len(fp), np.arange(len(fp))
    for i in range(0, n, tile):
        a = fp[i : i + tile]
        for j in range(i, n, tile):
            if pop[j] - pop[min(i + tile, n) - 1] > radius:
                break  # tiles are ordered: all later ones are farther still
            x, y = np.nonzero(_apart(a[:, None], fp[None, j : j + tile]) <= radius)
            x, y = x + i, y + j
            if (keep := x < y).any():
                _star(x[keep], y[keep], label)
    return label


def links(distinct: DataFrame, radius: int = 3, lanes: int = 1, rows_per_tile: int = 4096, recall: float = 0.95) -> DataFrame:
    """Pairs (a, b) of ids whose links connect what all pairs that meet in a bucket and lie within the radius connect.

    ``distinct`` has each fingerprint once: id, f0, f1, ...  With one lane all pairs within the radius meet.  A bucket of more than
    rows_per_tile fingerprints is ordered by population count and cut into parts; pairs of parts are units of work of their own,
    but those whose population counts differ beyond the radius are left out, so that no bucket lands in one task.
    """
    n = distinct.count()
    keyed = materialise(bucket_rows(distinct, block_tables(n, radius) if lanes == 1 else sampled_tables(n, radius, lanes, recall), lanes), "simhash-buckets")
    large = materialise(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > rows_per_tile).select("bucket"), "simhash-large")
    inside = keyed.join(large, "bucket", "left_semi")
    # By population count: at most 64 * lanes + 1 rows a bucket.
    pops = inside.groupBy("bucket", "pop").agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("bucket").orderBy("pop")) - F.col("m")
    pops = materialise(pops.withColumn("before", before), "simhash-pops")
    part = lambda x: F.floor(x / rows_per_tile).cast("long")
    parts = pops.select("bucket", "pop", F.explode(F.sequence(part(F.col("before")), part(F.col("before") + F.col("m") - 1))).alias("part")).groupBy("bucket", "part").agg(F.min("pop").alias("low"), F.max("pop").alias("high"))
    other = parts.select("bucket", F.col("part").alias("q"), F.col("low").alias("q_low"))
    pairs = parts.join(other, "bucket").where((F.col("part") <= F.col("q")) & (F.col("q_low") - F.col("high") <= radius)).select("bucket", "part", "q", F.xxhash64("bucket", "part", "q").alias("unit"))
    place = pairs.select("bucket", "part", "unit").union(pairs.where("part < q").select("bucket", F.col("q").alias("part"), "unit"))
    rows = inside.join(pops, ["bucket", "pop"]).withColumn("part", part(F.col("before") + F.pmod(F.xxhash64("id"), F.col("m"))))
    many = rows.join(place, ["bucket", "part"]).select("unit", "pop", "id", *_lanes(lanes))
    ones = keyed.join(large, "bucket", "left_anti").select(F.col("bucket").alias("unit"), "pop", "id", *_lanes(lanes))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by unit and population count; a unit may go on in the next batch."""
        held: list[np.ndarray] = []

        def done(unit: np.ndarray, pop: np.ndarray, ids: np.ndarray, *own: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            fp = np.stack(own, axis=1).view(np.uint64)
            edge = np.flatnonzero(np.diff(unit)) + 1
            start, size = np.concatenate([[0], edge]), np.diff(np.concatenate([[0], edge, [len(unit)]]))
            # Small units together: all pairs at distance 1, 2, ... within a unit.
            few = np.repeat(size <= 64, size)
            left = np.repeat(size, size) - (np.arange(len(unit)) - np.repeat(start, size))
            at = np.flatnonzero(few & (left > 1))
            for step in range(1, 64):
                at = at[left[at] > step]
                if not len(at):
                    break
                hit = at[_apart(fp[at], fp[at + step]) <= radius]
                a.append(ids[hit])
                b.append(ids[hit + step])
            for i, n in zip(start[size > 64], size[size > 64], strict=True):
                label = link_tile(fp[i : i + n], pop[i : i + n], radius)
                other = np.flatnonzero(label != np.arange(n))
                a.append(ids[i + label[other]])
                b.append(ids[i + other])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            # Tables find a pair again and again: each task gives it once.
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held = own if not held else [np.concatenate(x) for x in zip(held, own, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield done(*(x[:cut] for x in held))
            held = [x[cut:].copy() for x in held]
        if held:
            yield done(*held)

    return ones.union(many).repartition("unit").sortWithinPartitions("unit", "pop").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of edges (a, b): node, root, with the smallest node as root, for nodes that have an edge.

    Each round links the larger neighbours of every node, and then all smaller ones, to its smallest (large and small
    stars); it ends when nothing changes, after about as many rounds as the logarithm of the longest chain.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("b", "m", F.explode(F.array("a", "b")).alias("x")).where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        now = materialise(small, tag)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        seen = tuple(total)


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.95) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a lane), component_id: the smallest id that is reached over links, its own included.

    A null or empty text and one of white space alone has fingerprint zero and is linked like any other.  Null ids take
    part in links but are no component's id unless all of it is null.  Rows that repeat are kept.  Very long texts are hashed whole,
    a bounded number of shingles at a time.  Other columns are not read.  An empty table gives an empty result.
    """
    names = _lanes(lanes)
    prints = materialise(fingerprints(docs, id_col, text_col, size, lanes), "simhash-prints")
    own = (F.col("f0") if lanes == 1 else F.xxhash64(*names)).alias("id")
    distinct = materialise(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).select("*", own), "simhash-distinct")
    roots = materialise(components(materialise(links(distinct, radius, lanes, recall=recall), "simhash-links")), "simhash-roots")
    joined = distinct.join(roots, distinct["id"] == roots["node"], "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(ids, "root").select(F.col("id").alias("_id"), "component_id")
    digits = F.concat(*(F.lower(F.lpad(F.hex(f), 16, "0")) for f in names))
    return prints.select("doc_id", digits.alias("fingerprint"), own).join(by_print, F.col("id") == F.col("_id")).select("doc_id", "fingerprint", "component_id")


def one_of_each_group(docs: DataFrame, radius: int = 44, size: int = 5, lanes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id stays (null ids last, then by text).

    With five words a shingle and 256 bits, texts that share shingles at a Jaccard similarity of 0.8 differ in 39 bits on average,
    give or take 6; the radius of 44 finds most of them, and texts that share nothing differ in 128.  Rows are numbered when
    they are written once, so null and repeated ids don't matter; reruns keep the same documents.  All columns stay, whatever their names.
    """
    row, best = unused(docs.columns, "row", "best")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    groups = near_duplicates(rows, radius, size, lanes, row, text_col).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row).alias("row"))
    ranked = groups.join(rows.select(row, rank.alias("rank")), row)
    # The best rank names its row, so rows are picked by their own number and never meet on a large group's id.
    kept = ranked.groupBy("group").agg(F.min("rank").alias(best)).select(F.col(f"{best}.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
