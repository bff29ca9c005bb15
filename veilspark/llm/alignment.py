"""Alignment of two tokenizers' tokens by exact-text deduplication.

Texts are shuffled by their full text, each distinct one is tokenised and aligned once, its pair counts weigh as much as it has copies, and
its measures are joined to the ids of all its copies.  Both tokenizers part a text before a space between two visible characters, so
within a task equal stretches between such spaces are tokenised and aligned once; a text's tokens are those of its stretches.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs with the highest counts that are broadcast, 17 bytes each; the counts of all others are joined.
FREQUENT = 1 << 20
#: Characters of texts worked off at a time (at least one text), and those of the stretches that a task remembers.
SLICE, REMEMBERED = 500_000, 3_000_000
#: A space between two visible characters, and one that isn't.
_PARTING, _OTHER_SPACE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])"), re.compile(r"(?<![!-~\w]) | (?![!-~\w])")
MEASURES = ["n_a", "n_b", "n_groups", "n_links"]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: visible Latin-1 ones stand for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Aligner:
    """Both tokenizers, and what is known of stretches of text: numbers of tokens, groups and links, groups as text, linked pairs."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_file.decode()), sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True
        to_byte = byte_level()
        self.a_bytes = [bytes(to_byte.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        #: A pair's key: A's id above so many bits of B's.
        self.shift = max(1, (len(self.b_bytes) - 1).bit_length())
        # Whether a space between visible characters parts tokens for sure.
        spec = json.loads(a_file)
        self.parted = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known = 0  # characters
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, whether both give the bytes back
        self.groups: list[str] = []
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        """The text in stretches, each without the space before it: it is parted at spaces between visible characters."""
        if not self.parted:
            return [text]
        return text.split(" ") if _OTHER_SPACE.search(text) is None else _PARTING.split(text)

    def learn(self, new: list[str]) -> None:
        """Tokenise and align stretches, each with a space before it, all at once: where one ends tokens of both end."""
        want = [b" " + x.encode() for x in new]
        sides = [[e.ids for e in self.a.encode_batch_fast([" " + x for x in new], add_special_tokens=False)], self.b.encode(new, num_threads=1)]
        fine = self._fine(sides, want)
        counts = np.array([[len(x) for x in side] for side in sides], np.int64)
        n = len(new)
        ids, marks, total = [], [], sum(len(w) for w, ok in zip(want, fine, strict=True) if ok)
        for side, size in zip(sides, (self.a_size, self.b_size), strict=True):
            own = np.fromiter(chain.from_iterable(x for x, ok in zip(side, fine, strict=True) if ok), np.int64)
            mark = np.zeros(total + 1, np.int64)
            mark[np.cumsum(size[own])] = 1
            ids.append(own)
            marks.append(mark)
        # Every stretch of bytes without an end inside it is in one token of A and one of B, which it links.
        ends = np.flatnonzero(marks[0] | marks[1])
        both = marks[0] & marks[1]
        before = [np.cumsum(m) for m in marks]
        pairs = ids[0][before[0][ends - 1]] << self.shift | ids[1][before[1][ends - 1]]
        # Groups as text: tokens of A, then those of B, each with the sign before it.
        group_of = [np.cumsum(both)[np.flatnonzero(m) - 1] for m in marks]
        start = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=int(both.sum())))]) for g in group_of]
        place = [np.arange(len(ids[0])) + start[1][group_of[0]], np.arange(len(ids[1])) + start[0][group_of[1] + 1]]
        leads = [np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool) for g in group_of]
        sign = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        which = np.zeros_like(sign)
        for i, lead in ((0, 1), (1, 2)):
            sign[place[i]], which[place[i]] = np.where(leads[i], lead, 0), ids[i]
        signs = (",", ";", "|")
        text = [signs[k] + str(x) for k, x in zip(sign.tolist(), which.tolist(), strict=True)]
        numbers = np.zeros((n, 5), np.int64)
        numbers[:, :2], numbers[:, 4] = counts.T, fine
        good = np.flatnonzero(fine)
        bytes_upto = np.cumsum([len(want[i]) for i in good])
        for column, mark in ((2, both), (3, marks[0] | marks[1])):
            numbers[good, column] = np.diff(np.concatenate([[0], np.cumsum(mark)[bytes_upto]])) if len(good) else 0
        edges = np.concatenate([[0], np.cumsum(counts.sum(axis=0)[good])]).tolist()
        groups = [""] * n
        for k, i in enumerate(good.tolist()):
            groups[i] = "".join(text[edges[k] : edges[k + 1]])[1:]  # without the first sign
        for x in new:
            self.index[x] = len(self.index)
            self.known += len(x)
        self.groups += groups
        self.numbers = np.concatenate([self.numbers, numbers])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(numbers[:, 3])])

    def _fine(self, sides: list[list[list[int]]], want: list[bytes]) -> np.ndarray:
        """Whether the tokens of both give each stretch's bytes back."""
        tables = (self.a_bytes, self.b_bytes)
        edges, all_bytes = np.cumsum([len(w) for w in want]), b"".join(want)

        def whole(side: list[list[int]], table: list[bytes], size: np.ndarray) -> bool:
            ids = list(chain.from_iterable(side))
            upto = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum([len(x) for x in side])]
            return np.array_equal(upto, edges) and b"".join(map(table.__getitem__, ids)) == all_bytes

        if all(map(whole, sides, tables, (self.a_size, self.b_size))):
            return np.ones(len(want), bool)
        return np.array([all(b"".join([table[i] for i in side[k]]) == w for side, table in zip(sides, tables, strict=True)) for k, w in enumerate(want)], bool)

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of tokens of A and B, groups and links of each text; digests of its groups; linked pairs: their text, key and how often."""
        split = [self.stretches(t) if t else [] for t in texts]
        if self.known > REMEMBERED:
            self.forget()
        if new := list(dict.fromkeys(x for s in split for x in s if x not in self.index)):
            self.learn(new)
        size = np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, size.sum())
        of = np.repeat(np.arange(len(texts)), size)
        numbers = np.zeros((len(texts), 5), np.int64)
        np.add.at(numbers, of, self.numbers[at])
        fine = (numbers[:, 4] == size) & (size > 0)
        numbers[~fine] = 0
        edges = np.concatenate([[0], np.cumsum(size)]).tolist()
        groups = [self.groups[k] for k in at.tolist()]
        digests = [hashlib.sha256(";".join(groups[i:j]).encode()).hexdigest() if ok else "" for ok, i, j in zip(fine.tolist(), edges[:-1], edges[1:], strict=True)]
        at, of = at[fine[of]], of[fine[of]]
        n = self.first[at + 1] - self.first[at]
        place = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        # Keys have far fewer than 40 bits.
        both, times = np.unique(np.repeat(of, n) << 40 | self.pairs[place], return_counts=True)
        return numbers[:, :4], digests, both >> 40, both & ((1 << 40) - 1), times


def _list_array(values: np.ndarray, of: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """Values, ordered by the row that they are of, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), pa.array(values, kind))


_ALIGNED = "key binary, m long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs array<long>, times array<int>"


def align_distinct(distinct: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """_ALIGNED of distinct texts (key, m, text): measures, and each linked pair with how often the text links it."""
    sent = distinct.sparkSession.sparkContext.broadcast({"files": (a_file, b_file)})  # two fixed vocabularies

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that goes on to another task keeps what it has read of the broadcast, and so its aligner.
        if "aligner" not in sent.value:
            sent.value["aligner"] = Aligner(*sent.value["files"])
        aligner = sent.value["aligner"]
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column(2)).to_numpy())
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE, side="right")))
                part = batch.slice(start, stop - start)
                numbers, digests, of, pairs, times = aligner.measure(part.column(2).to_pylist())
                lists = [_list_array(pairs, of, part.num_rows, pa.int64()), _list_array(times.astype(np.int32), of, part.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(4)), pa.array(digests), *lists], names=[x.split()[0] for x in _ALIGNED.split(", ")])
                start = stop

    return distinct.select("key", "m", "text").mapInArrow(work, _ALIGNED)


def pair_counts(measured: DataFrame, shift: int) -> DataFrame:
    """pair, n, best: how many links of the corpus hold it linked, and whether no pair of the same B id has more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            weight = times.flatten().to_numpy().astype(np.int64) * np.repeat(batch.column(0).to_numpy(), np.diff(pairs.offsets.to_numpy()))
            own, at = np.unique(pairs.flatten().to_numpy(), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, at, weight)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["pair", "n"])

    counts = measured.select("m", "pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << shift) - 1))), "pairs")
    # At most as many rows as B has ids.
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    return materialise(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def looked_up(measured: DataFrame, counts: DataFrame, frequent: int) -> DataFrame:
    """key, n_best, count_sum of every distinct text.

    The most frequent pairs, as many as ``frequent`` allows, are broadcast and looked up within the text; what is left of a text's pairs,
    none of them frequent, is joined with the counts.
    """
    spark = measured.sparkSession
    level = F.floor(4 * F.log2("n"))
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level).count().collect()), reverse=True)  # at most four rows a power of two
    floor, have = (sizes[0][0] + 1 if sizes else 0), 0
    for at, n in sizes:
        if have + n > frequent:
            break
        floor, have = at, have + n
    table = counts.where(level >= floor).toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    sent = spark.sparkContext.broadcast((pair[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order].astype(bool)))
    whole = have == sum(n for _, n in sizes)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lists = part.column(1)
                pairs, times = lists.flatten().to_numpy(), part.column(2).flatten().to_numpy().astype(np.int64)
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                there = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], of[there], times[there] * best[at[there]])
                np.add.at(sums[1], of[there], times[there] * n[at[there]])
                rest = [_list_array(x[~there], of[~there], part.num_rows, k) for x, k in ((pairs, pa.int64()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[0]), pa.array(sums[1]), *rest], names=["key", "n_best", "count_sum", "pairs", "times"])

    found = measured.select("key", "pairs", "times").mapInArrow(find, "key binary, n_best long, count_sum long, pairs array<long>, times array<long>")
    if whole:
        return found.select("key", "n_best", "count_sum")
    found = materialise(found, "pairs-found")
    rest = found.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts.where(level < floor), "pair").select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return found.select("key", "n_best", "count_sum").union(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, folder: str = TOKENIZERS, a_name: str = BYTE_BPE, b_name: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    A is a byte-level BPE, B a piece BPE with byte fallback; both encode a space and the text, strings of special tokens as plain text.
    Tokens of A and B are linked where their byte ranges overlap; groups lie between offsets where both end.  n_best counts the links
    whose pair is linked as often as any of its B id, count_sum adds up how often their pairs are linked in all of docs.  A null or
    empty text, and one whose tokens don't give its bytes back, has zeros and an empty digest, and its links count nowhere.  Rows that
    repeat weigh as often as they are there.  Null ids and other columns don't matter.  Very long texts are aligned whole.  An empty
    table gives an empty result.  The files are read by the driver alone.
    """
    files = []
    for name in (a_name, b_name):
        with open(f"{folder}/{name}", "rb") as f:
            files.append(f.read())
    text = F.coalesce(text_col, F.lit(""))
    digest = lambda t: F.unhex(F.sha2(t, 256))
    distinct = docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("m"))
    path = scratch_path(docs.sparkSession, "aligned")
    align_distinct(distinct.select(digest(F.col("text")).alias("key"), "m", "text"), *files).write.option("compression", "zstd").parquet(path)
    measured = docs.sparkSession.read.parquet(path)
    counts = pair_counts(measured, Aligner(*files).shift)
    found = looked_up(measured, counts, frequent)
    full = measured.select("key", *MEASURES, F.col("digest").alias("groups_sha256")).join(found, "key")
    full = materialise(full, "aligned-measures")
    names = [*MEASURES, "n_best", "count_sum"]
    rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("key")).join(full, "key", "left")
    return rows.select(F.col("id").alias(id_col), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
