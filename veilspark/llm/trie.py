"""Conversation prefix trie by splitter and skeleton.

Conversations are ordered by their paths (digests of their turns one after the other) and cut into ranges.  A node whose members lie
in more than one range is a beginning of a splitter's path; these nodes, the skeleton, are broadcast.  Each range, in order, finishes
all other nodes by itself and gives what it has of the skeleton's; those parts are combined by reduction.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Characters of a turn's digest in a path: 120 bits.
WIDTH = 20
#: Turns of a splitter's path at most: with the number of ranges it bounds the skeleton.
SKELETON_DEPTH = 64
#: Conversations sampled for each range, and in all at most, to find splitters.
SAMPLED, MOST_SAMPLED = 20, 100_000
#: Bytes of ids that a skeleton node's part holds before it is written.
CHUNK = 1 << 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PARTS = f"{NODE}, under int, node int, words long, shard int, seq int, chunk binary"
_NOBODY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """15 bytes (WIDTH characters in base 64) that tell turns apart by role and text."""
    return F.to_binary(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 30), F.lit("hex"))


def rebuilt(turns: DataFrame, stride: int = 20, most: int = 4) -> DataFrame:
    """id, path, words (of each turn) of every conversation: the first h turns of conversation id - id % stride, then its own after its first h.

    h is crc32 of the id's decimal digits, modulo ``most``.  Turns are ordered by turn, null first, equal ones by digest; null role
    and text are empty.  Turns without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("id"), F.struct(F.col("turn").isNotNull().alias("there"), "turn", turn_digest(role, text).alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    lists = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(F.base64(t["key"]).alias("key"), t["words"].alias("words")))
    own = materialise(own.groupBy("id").agg(lists.alias("own")), "trie-turns")
    base = own.where(F.col("id") % stride == 0).select(F.col("id").alias("base"), F.slice("own", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumns({"base": F.col("id") - F.col("id") % stride, "h": h}).join(base, "base", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    path = F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest))
    return both.select("id", path.alias("p")).select("id", F.array_join(F.transform("p", lambda t: t["key"]), "").alias("path"), F.transform("p", lambda t: t["words"]).alias("words"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[str, int]]:
    """At most shards - 1 places (path, id) that cut paths into ranges of about as many rows, from a bounded sample."""
    n = paths.count()
    every = max(1, n // min(MOST_SAMPLED, SAMPLED * shards))
    cut = F.substring("path", 1, SKELETON_DEPTH * WIDTH)
    sampled = paths.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(cut.alias("path"), F.when(F.col("path") == cut, F.col("id")).alias("id")).limit(4 * MOST_SAMPLED)
    # A cut path stands before all rows that begin with it.
    rows = sorted((r["path"], -(1 << 63) if r["id"] is None else r["id"]) for r in sampled.toLocalIterator())
    return sorted({rows[i * len(rows) // shards] for i in range(1, shards)}) if len(rows) > 1 else []


def skeleton_of(places: list[tuple[str, int]]) -> list[str]:
    """All beginnings of the splitters' paths in order, the root first."""
    return sorted({path[: i * WIDTH] for path, _ in places for i in range(len(path) // WIDTH + 1)} | {""})


class _Open:
    """A node on the path that is just read."""

    __slots__ = ("at", "chunk", "convs", "children", "ends", "leaves", "least", "node", "saved", "words")

    def __init__(self, at: int, node: int | None, words: int):
        self.at, self.node, self.words = at, node, words
        self.convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None
        self.chunk = bytearray()


def walk(rows: Iterator[tuple[int, str, int, list[int]]], skeleton: dict[str, int]) -> Iterator[tuple]:
    """Rows of _PARTS from (shard, path, id, words) in order: finished nodes, and parts of skeleton nodes for each shard.

    Only the nodes below one child of a skeleton node are held: their parents' smallest members are known when it is done.
    """
    stack: list[_Open] = []
    before, shard, seq = "", None, 0
    done: list[tuple] = []
    least: dict[int, int] = {}

    def part(x: _Open, depth: int, last: bool) -> tuple:
        nonlocal seq
        seq += 1
        sums = (x.least, depth, None, x.convs, x.children, x.leaves, x.saved) if last else (None, depth, None, 0, 0, 0, 0)
        chunk = bytes(x.chunk) if x.chunk else None
        x.chunk = bytearray()
        return (*sums, None, None, x.node, x.words, shard, seq, chunk)

    def close(depth: int) -> Iterator[tuple]:
        """Close all nodes deeper than depth (of turns; the root is at 0)."""
        while len(stack) > depth + 1 or (depth < 0 and stack):
            x = stack.pop()
            above = stack[-1] if stack else None
            if x.node is None:
                leaves = x.leaves if x.children else 1
                x.leaves, x.saved = leaves, x.saved + (x.convs - 1) * x.words
                least[x.at] = x.least
                done.append((x.at, above.at, x.least, len(stack), x.convs, x.children, leaves, x.saved, x.ends.hexdigest() if x.ends else _NOBODY))
                above.children += 1
            else:
                yield part(x, len(stack), True)
            if above is not None:
                above.convs, above.leaves, above.saved = above.convs + x.convs, above.leaves + x.leaves, above.saved + x.saved
                above.least = x.least if above.least is None else min(above.least, x.least)
                if x.node is None and above.node is not None:
                    for at, up, conv, deep, *rest in done:
                        yield (conv, deep, least.get(up), *rest, above.node if at == x.at else None, None, None, None, None, None)
                    done.clear()
                    least.clear()

    count = 0
    for now, path, conv, words in rows:
        if now != shard:
            yield from close(-1)
            stack.append(_Open(-1, 0, 0))
            before, shard = "", now
        same, most = 0, min(len(before), len(path))
        while same < most and before[same : same + WIDTH] == path[same : same + WIDTH]:
            same += WIDTH
        yield from close(same // WIDTH)
        for at in range(same, len(path), WIDTH):
            count += 1
            up = stack[-1]
            stack.append(_Open(count, skeleton.get(path[: at + WIDTH]) if up.node is not None else None, words[at // WIDTH]))
        before = path
        x = stack[-1]
        x.convs += 1
        x.least = conv if x.least is None else min(x.least, conv)
        if x.node is None:
            if x.ends is None:
                x.ends = hashlib.sha256(b"%d" % conv)
            else:
                x.ends.update(b",%d" % conv)
        else:
            x.chunk += b",%d" % conv
            if len(x.chunk) >= CHUNK:
                yield part(x, len(path) // WIDTH, False)
    yield from close(-1)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes (NODE) of the trie over paths (id, path, words): see conversation_trie().

    A node with very many members that end there gives their ids to one task in the end, bytes in order, as SHA-256 asks for it.
    """
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = materialise(paths, "trie-paths")
    places = splitters(paths, shards)
    names = skeleton_of(places)
    # At most shards * SKELETON_DEPTH nodes and their paths.
    sent = spark.sparkContext.broadcast((places, {path: i for i, path in enumerate(names)}))
    into = _arrow("shard int, path string, id long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, _ = sent.value
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shard = [bisect_right(cuts, x) for x in zip(own, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(1), batch.column(0), batch.column(2)], names=[*into.names, "words"])

    dealt = paths.select("id", "path", "words").mapInArrow(deal, "shard int, path string, id long, words array<int>")
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "id")
    out = _arrow(_PARTS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return _batches(walk(rows, sent.value[1]), out)

    parts = materialise(ordered.mapInArrow(finish, _PARTS), "trie-parts")
    skeleton = parts.where("node is not null")
    sums = skeleton.groupBy("node").agg(F.min("conv_id"), F.min("depth"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words"))
    found = {r[0]: list(r)[1:] for r in sums.collect()}  # one row for each skeleton node
    own = {i: (r[4], r[5]) for i, r in found.items()}
    rows = []
    place = {path: i for i, path in enumerate(names)}
    for i in reversed(range(len(names))):  # children before parents
        if i not in found:
            continue
        conv, depth, convs, children, leaves, saved, words = found[i]
        leaves, saved = leaves if children else 1, saved + (convs - 1) * words
        up = place[names[i][:-WIDTH]] if depth else None
        if up is not None:
            above = found[up]
            # What lies outside the skeleton has already been added on the way up within the ranges.
            above[3], above[4], above[5] = above[3] + 1, above[4] + leaves - own[i][0], above[5] + saved - own[i][1]
        rows.append((i, conv, depth, None if up is None else found[up][0], convs, children, leaves, saved))
    table = spark.createDataFrame(rows, "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h, first = None, None, True
        for batch in batches:
            for i, chunk in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != node:
                    if h:
                        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])
                    node, h, first = i, hashlib.sha256(), True
                h.update(chunk.as_py()[first:])  # without the first comma
                first = False
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    chunks = skeleton.where("chunk is not null").select("node", "shard", "seq", "chunk").repartition("node").sortWithinPartitions("node", "shard", "seq").select("node", "chunk")
    ends = chunks.mapInArrow(hashed, "node int, ends_sha256 string")
    names_of = [x.split()[0] for x in NODE.split(", ")]
    top = table.join(ends, "node", "left").select(*names_of[:-1], F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"))
    above = table.select(F.col("node").alias("under"), F.col("conv_id").alias("above"))
    rest = parts.where("node is null").join(F.broadcast(above), "under", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*names_of)
    return top.union(rest)


def conversation_trie(turns: DataFrame, stride: int = 20, most: int = 4, shards: int | None = None) -> DataFrame:
    """A row for each distinct beginning (node) of rebuilt() conversations: conv_id (smallest member), depth, parent_conv_id (the parent's conv_id;
    null for the root), n_convs (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens ((n_convs - 1) * words of
    the last turn, summed over the subtree), ends_sha256 (of the ids, ascending, comma-joined, of members without another turn).

    ``turns``: conv_id, turn, role, text; other columns are not read.  Null role and text are empty, null turns come first, rows that
    repeat are turns of their own, turns with a null conv_id belong to no conversation.  A text may be very long: only its digest
    moves on.  A conversation's digests, 20 bytes a turn, are one row.  An empty table has no node, not even the root.
    """
    return prefix_trie(rebuilt(turns, stride, most), shards)
