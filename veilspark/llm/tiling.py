"""Benchmark decontamination by greedy string tiling.

Runs of ``min_words`` words are the seeds, as Karp-Rabin values.  Documents give the seeds that some benchmark item may have, by
a bitmap of fixed size, and these are joined with the items' seeds.  For each pair that shares one, the longest match of
words not yet marked is sought by running Karp-Rabin over both texts, again and again, and marked; the share of a test's words
that end up marked is its coverage.  Passages that a document brings in another order are covered all the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, map_bits, materialise, may_have, unused

#: A-Z to lower case; ASCII punctuation and control characters to a blank.
_TABLE = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: Items from which on a seed counts as common.
COMMON = 20
#: Most numbers of rows that are broadcast to take the rows out (8 bytes each).
SENT_ROWS = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def word_ids(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` remembers them."""
    if len(known) > 1_000_000:
        known.clear()
    get = known.get
    ids = [get(w) for w in words]
    for i, w in enumerate(words):
        if ids[i] is None:
            ids[i] = known[w] = xxhash.xxh64_intdigest(w)
    return np.array(ids, np.uint64)


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """The Karp-Rabin value of each run of n ids (modulo 2 ** 64), mixed with n."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + ids[i : i + len(out)]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
    return out ^ (out >> np.uint64(32))


class _Runs:
    """A text's Karp-Rabin values for runs of any length, and which of its words are still free."""

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        self.ids, self.free = ids, free
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), np.uint64(_BASE))]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), _INVERSE)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((ids + np.uint64(1)) * power[:-1], dtype=np.uint64)])

    def room(self) -> np.ndarray:
        """How many free words stand from each place on."""
        place = np.arange(len(self.ids))
        stop = np.where(self.free, len(place), place)
        return np.minimum.accumulate(stop[::-1])[::-1] - place

    def values(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]


def _any_common(item: _Runs, doc: _Runs, own: np.ndarray, other: np.ndarray, n: int) -> bool:
    """Whether item and doc have an equal run of n free words."""
    i, d = np.flatnonzero(own >= n), np.flatnonzero(other >= n)
    if not len(i) or not len(d):
        return False
    values, seen = item.values(i, n), doc.values(d, n)
    order = np.argsort(seen, kind="stable")
    spot = np.minimum(np.searchsorted(seen, values, sorter=order), len(seen) - 1)
    return any(np.array_equal(item.ids[i[k] : i[k] + n], doc.ids[d[order[spot[k]]] : d[order[spot[k]]] + n]) for k in np.flatnonzero(seen[order[spot]] == values).tolist())


def _mark_all(item: _Runs, doc: _Runs, own: np.ndarray, other: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Mark equal runs of n free words, the longest there are: those first in the item come first, each with the first free place in doc."""
    i, d = np.flatnonzero(own >= n), np.flatnonzero(other >= n)
    values, seen = item.values(i, n), doc.values(d, n)
    order = np.argsort(seen, kind="stable")
    low, high = (np.searchsorted(seen, values, side=side, sorter=order) for side in ("left", "right"))
    free = lambda x: doc.free[d[order[x]]] and doc.free[d[order[x]] + n - 1]
    # Of each value the places before its own next one have been marked by now.
    following: dict[int, int] = {}
    out = []
    for k in np.flatnonzero(low < high).tolist():
        a = int(i[k])
        # All runs marked here have n words, so one that meets another has its first or last word in common with it.
        if not (item.free[a] and item.free[a + n - 1]):
            continue
        at = following.get(int(low[k]), int(low[k]))
        while at < high[k] and not free(at):
            at += 1
        following[int(low[k])] = at
        b = next((d[order[x]] for x in range(at, int(high[k])) if free(x) and np.array_equal(item.ids[a : a + n], doc.ids[d[order[x]] : d[order[x]] + n])), None)
        if b is not None:
            item.free[a : a + n] = doc.free[b : b + n] = False
            out.append((a, int(b)))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, length >= n): the longest match of free words first, then the first in the item.

    ``doc`` has the hashes of the document's words at the places ``pos``.  All tiles of one length are marked together, after as many
    passes over both texts as the longest match has binary digits, however often words repeat.
    """
    gaps = np.flatnonzero(np.diff(pos) != 1) + 1
    a, b = _Runs(item, np.ones(len(item), bool)), _Runs(np.insert(doc, gaps, 0), np.insert(np.ones(len(doc), bool), gaps, False))
    pos, out, most = np.insert(pos, gaps, -1), [], len(item)
    while True:
        own, other = a.room(), b.room()
        low, high, best = n, min(most, int(own.max(initial=0)), int(other.max(initial=0))), 0
        while low <= high:
            middle = (low + high) // 2
            if _any_common(a, b, own, other, middle):
                best, low = middle, middle + 1
            else:
                high = middle - 1
        if not best:
            return out
        out += [(i, int(pos[d]), best) for i, d in _mark_all(a, b, own, other, best)]
        most = best - 1


def _item_rows(benchmark: DataFrame) -> DataFrame:
    """item, item_id, w: numbered items with the hashes of their words; items without words are left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            ids = [word_ids(words_of(x.as_py()), known).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["item_id", "w"])

    item_type = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(build, f"item_id {item_type}, w array<long>")
    return materialise(rows.where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()), "tiling-items")


def _item_seeds(items: DataFrame, min_words: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """All seeds of items (item, n, h), and those to join by: item, h, places (how often the item has it), need.  An item shorter than a run has one seed: itself.

    A document that covers enough of an item has seeds at so many of its places that some may be left out: of seeds which many items have,
    the most frequent, but so few that the rest must still show the document at ``need`` places at least.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, w in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = w.values.to_numpy().view(np.uint64)
                n = min(min_words, len(ids))
                h, places = np.unique(rolling(ids, n), return_counts=True)
                # A tile of L words, n at least, begins at L - n + 1 places, so n times the places are no fewer than the words.
                least = max(1, int(np.ceil(coverage * len(ids) / n - 1e-9)))
                fill = lambda x, kind: pa.array(np.full(len(h), x, kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([fill(item, np.int64), fill(n, np.int32), pa.array(h.view(np.int64)), pa.array(places.astype(np.int64)), fill(least, np.int64)], names=["item", "n", "h", "places", "least"])

    seeds = materialise(items.select("item", "w").mapInArrow(build, "item long, n int, h long, places long, least long"), "tiling-seeds")
    common = seeds.groupBy("h").agg(F.count("*").alias("many")).where(F.col("many") > COMMON)
    ranked = seeds.join(common, "h", "left").withColumn("many", F.coalesce("many", F.lit(0).cast("long")))
    # A window over one item's seeds.
    upto = F.sum("places").over(W.partitionBy("item").orderBy(F.desc("many"), "h"))
    out = ranked.withColumn("left_out", (F.col("many") > 0) & (upto < F.col("least")))
    lost = F.sum(F.when(F.col("left_out"), F.col("places")).otherwise(0)).over(W.partitionBy("item"))
    return seeds, materialise(out.withColumn("need", F.col("least") - lost).where("not left_out").select("item", "h", "places", "need"), "tiling-rare")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int, coverage: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, item_id, coverage, tiles of pairs that reach the coverage."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = _item_rows(benchmark)
    seeds, rare = _item_seeds(items, min_words, coverage)
    lengths = sorted(r["n"] for r in seeds.select("n").distinct().collect())  # 1 to min_words
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(seeds, "h", map_bits(seeds.count())))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            rows, found = [], {"h": [], "w": [], "pos": []}
            for row, text in enumerate(batch.column(1)):
                ids = word_ids(words_of(text.as_py()), known)
                covered, hits = np.zeros(len(ids) + 1, np.int64), []
                for n in lengths:
                    h = rolling(ids, n)
                    here = np.flatnonzero(may_have(shared.value, h))
                    if len(here):
                        hits.append(h[here])
                        np.add.at(covered, here, 1)
                        np.add.at(covered, here + n, -1)
                if hits:
                    pos = np.flatnonzero(np.cumsum(covered)[:-1])
                    rows.append(row)
                    for name, x in (("h", np.unique(np.concatenate(hits)).view(np.int64)), ("w", ids[pos].view(np.int64)), ("pos", pos)):
                        found[name].append(x)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(found[c], pa.list_(pa.int64())) for c in found)], names=["doc_id", *found])

    # Numbered once when written: null and repeated ids don't matter.
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scanned = materialise(own.mapInArrow(scan, f"doc_id {id_type}, h array<long>, w array<long>, pos array<long>").withColumn("doc", F.monotonically_increasing_id()), "tiling-scan")
    # Only pairs with seeds at as many places as the coverage takes have their words brought together.
    met = scanned.select("doc", F.explode("h").alias("h")).join(rare, "h")
    pairs = met.groupBy("doc", "item").agg(F.sum("places").alias("met"), F.first("need").alias("need")).where("met >= need").select("doc", "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, share, where = [], [], []
            for row in range(batch.num_rows):
                doc, pos, item = (batch.column(c)[row].values.to_numpy() for c in (2, 3, 4))
                found = tiles(item.view(np.uint64), doc.view(np.uint64), pos, min(min_words, len(item)))
                part = sum(x[2] for x in found) / len(item)
                if part >= coverage:
                    rows.append(row)
                    share.append(part)
                    where.append([{"item_at": i, "doc_at": d, "words": n} for i, d, n in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(share, pa.float64()), pa.array(where, pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])))],
                names=["doc_id", "item_id", "coverage", "tiles"],
            )

    both = pairs.join(scanned.select("doc", "doc_id", "w", "pos"), "doc").join(items.select("item", "item_id", F.col("w").alias("v")), "item").select("doc_id", "item_id", "w", "pos", "v")
    return both.mapInArrow(tile, f"doc_id {id_type}, item_id {item_type}, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs doc_id, item_id, coverage, tiles (structs item_at, doc_at, words) of documents that hold that much of a test.

    Null or empty texts and items match nothing.  Items that repeat are reported once each; rows that repeat an id are reported
    once each.  An item of fewer than min_words words is matched as a whole.  Very long and repetitive texts are read whole.  Other
    columns are not read, whatever their names.  An empty table of either kind gives an empty result.
    """
    return overlaps(docs, benchmark, min_words, coverage, id_col, text_col)


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_words: int = 5, coverage: float = 0.8, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold less than that much of every test, with all their columns; null and repeated ids don't matter."""
    (row,) = unused(docs.columns, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "tiling-docs")
    found = materialise(overlaps(rows, benchmark, min_words, coverage, row, text_col).select(F.col("doc_id").alias(row)).distinct(), "tiling-found")
    found = F.broadcast(found) if found.count() <= SENT_ROWS else found
    return rows.join(found, row, "left_anti").select(*docs.columns)
