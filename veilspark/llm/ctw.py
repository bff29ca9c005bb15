"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

The code of a text begins with the language that its pairs of bytes look like, which the text alone decides (their counts are learned from the
training texts by their column lang); then come its words and the white space between them.  So a text has one code, and the probabilities of all
texts add up to no more than 1.  Each byte of a word, and the word's end, is coded as eight binary choices.  A choice has a context tree of its own over the DEPTH bytes before it; before
a word's first byte stand a start mark and two bytes that tell the language.  A node holds a Krichevsky-Trofimov estimate of the
training counts, and weighting mixes the estimates of all depths by how well each codes these counts.  Where training never
came by, the deepest node that it reached has all the weight that is left.  White space is coded by what stands before it.

As contexts end at the word's start, a word has one code length in a language, wherever it stands: Spark counts words over all
texts, their contexts become cells (context, byte, count), and the tree is weighted bottom-up and read top-down as tables.  Every
context is kept, however rare.  Depths SPLIT to DEPTH of a subtree are worked off together in numpy, one suffix of SPLIT bytes
after the other; the depths above are aggregations and joins.

Beside it stands the base model that scores are compared with: add-one unigrams over words.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Stands for a word's start and end; never part of UTF-8.
MARK = b"\xff"
DEPTH, SPLIT = 6, 3
#: Most words whose scores and counts are sent to all tasks (the others are joined).
FREQUENT = 1 << 19
#: Most cells (16 bytes each) that are sent to all tasks to score words; beyond it words' places are joined with them.
SENT_CELLS = 1 << 22
#: Kinds of places for white space: 0 inside a word, 1 to 6 the bytes, 7 the text's start or end.
_PLACE = np.zeros(256, np.uint8)
_PLACE[[9, 10, 11, 12, 13, 32]] = np.arange(1, 7)
_CHUNK, _CELLS = 1 << 22, 200_000
#: Languages that codes tell apart: the most frequent in training, each with a number for every pair of bytes.
LANGUAGES = 32
_U8 = np.uint64(8)


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts of a batch with the first one's row, about _CHUNK bytes at a time."""
    texts, size, first = [], 0, 0
    for row, x in enumerate(batch.column(column)):
        texts.append((x.as_py() or b"").lower())
        size += len(texts[-1])
        if size >= _CHUNK:
            yield first, texts
            texts, size, first = [], 0, row + 1
    if texts:
        yield first, texts


def _gaps(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """White space as pairs of places (8 * before + after) along all texts, and the first pair of each text."""
    data = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8)
    place = _PLACE[data].copy()
    ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    place[ends] = 7
    # Of a word, its first byte alone stands in the row of places.
    keep = np.ones(len(place), bool)
    keep[1:] = (place[1:] != 0) | (place[:-1] != 0)
    row = place[keep].astype(np.int64)
    at = (np.cumsum(keep) - 1)[ends]
    return 8 * row[:-1] + row[1:], at


def _byte_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes, marks between the texts included, and the first of each text; each has one at least."""
    data = np.frombuffer(MARK + b"".join(t + MARK for t in texts), np.uint8)
    return data[:-1].astype(np.int32) << 8 | data[1:], np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]


def learn_languages(docs: DataFrame, most: int = LANGUAGES) -> dict:
    """What languages look like, from texts to learn from (columns lang, text as binary, held_out): names, whole numbers for byte pairs and for each language.

    Without a training text there is one language.  Texts of languages beyond ``most`` are taken for the others' that they look like.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], names=["lang", "pair", "n"])
            held.clear()

        for batch in batches:
            langs, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in _chunks(batch, 1):
                by_lang: dict[str, list[bytes]] = defaultdict(list)
                for row, text in enumerate(texts, first):
                    if not out[row]:
                        by_lang[langs[row]].append(text)
                for lang, own in by_lang.items():
                    n = held.setdefault(lang, np.zeros((1 << 16) + 1, np.int64))
                    n[:-1] += np.bincount(_byte_pairs(own)[0], minlength=1 << 16)
                    n[-1] += len(own)
                if len(held) > 64:
                    yield from rows()
        yield from rows()

    counts = docs.select("lang", "text", "held_out").mapInArrow(count, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "ctw-languages")
    top = [(r["lang"], r["n"]) for r in counts.where(F.col("pair") == 1 << 16).orderBy(F.desc("n"), "lang").limit(most).collect()] or [("", 0)]
    names = [g for g, _ in top]
    n = np.zeros((len(top), 1 << 16))
    table = counts.where((F.col("pair") < 1 << 16) & F.col("lang").isin(names)).toArrow()  # at most 65,536 rows a language
    n[np.array([names.index(g) for g in table.column("lang").to_pylist()], np.int64), table.column("pair").to_numpy()] = table.column("n").to_numpy()
    # Thousandths of bits, as whole numbers: their sums are exact, whatever texts stand beside one.
    pairs = np.rint(1000 * np.log2((n + 1) / (n.sum(axis=1, keepdims=True) + (1 << 16)))).astype(np.int32)
    share = np.array([t + 0.5 for _, t in top]) / (sum(t for _, t in top) + 0.5 * len(top))
    return {"names": names, "pairs": pairs, "share": np.rint(1000 * np.log2(share)).astype(np.int64)}


def languages_of(model: dict, texts: list[bytes]) -> list[str]:
    """The language that each lower-cased text looks like; the more frequent one of equals."""
    names = model["names"]
    if len(names) == 1 or not texts:
        return [names[0]] * len(texts)
    pair, start = _byte_pairs(texts)
    likely = [np.add.reduceat(own[pair], start, dtype=np.int64) + share for own, share in zip(model["pairs"], model["share"], strict=True)]
    return [names[k] for k in np.argmax(likely, axis=0).tolist()]


def before_word(lang: str) -> bytes:
    """The DEPTH bytes before a word of a language: two that tell it, and the start mark."""
    code = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFF
    return bytes(DEPTH - 3) + bytes([code >> 8, code & 255]) + MARK


def word_cells(langs: list[str], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all coded bytes of the words (ends included), and the first of each word.

    A cell is the DEPTH bytes before, the nearest lowest, times 256, plus the byte.
    """
    front = {g: before_word(g) for g in set(langs)}
    data = np.frombuffer(b"".join([front[g] + w + MARK for g, w in zip(langs, words, strict=True)]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(np.arange(1, len(words) + 1) * DEPTH, size)
    key = data[at]
    for d in range(1, DEPTH + 1):
        key = key | data[at - d] << np.uint64(8 * d)
    return key, first


def count_words(docs: DataFrame, model) -> DataFrame:
    """Counts in texts to learn from (columns text as binary, held_out; model: a broadcast of learn_languages()) in one pass: kind 0, a word by language; 1, a pair of places; 2, texts by language.

    Words of texts that are held out are there too, with the count that learning gives them (0, if they occur nowhere else).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        pairs, ends = np.zeros(64, np.int64), Counter()

        def rows(kind: int, lang: str, w: list[bytes], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array([lang] * len(w), pa.string()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], names=["kind", "lang", "w", "n"])

        for batch in batches:
            held = batch.column(1).to_pylist()
            for first, texts in _chunks(batch, 0):
                langs = languages_of(model.value, texts)
                for row, text in enumerate(texts, first):
                    own = words[langs[row - first]]
                    if held[row]:
                        for w in set(text.split()):
                            own[w] += 0
                    else:
                        own.update(text.split())
                        ends[langs[row - first]] += 1
                if learned := [t for row, t in enumerate(texts, first) if not held[row]]:
                    pairs += np.bincount(_gaps(learned)[0], minlength=64)
                if sum(map(len, words.values())) > 500_000:
                    for lang, own in words.items():
                        yield rows(0, lang, list(own.keys()), list(own.values()))
                    words.clear()
        for lang, own in words.items():
            yield rows(0, lang, list(own.keys()), list(own.values()))
        if ends:
            used = np.flatnonzero(pairs)
            yield rows(1, "", [bytes([x]) for x in used], pairs[used].tolist())
            for lang, n in ends.items():
                yield rows(2, lang, [b""], [n])

    partial = docs.select("text", "held_out").mapInArrow(count, "kind int, lang string, w binary, n long")
    return materialise(partial.groupBy("kind", "lang", "w").agg(F.sum("n").alias("n")), "ctw-words")


def count_cells(words: DataFrame) -> DataFrame:
    """key, n: all cells of words (lang, w, n), with how often training met them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, own, n = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i in range(0, len(own), 100_000):
                key, first = word_cells(langs[i : i + 100_000], own[i : i + 100_000])
                key, back = np.unique(key, return_inverse=True)
                total = np.bincount(back, weights=np.repeat(n[i : i + 100_000], np.diff(first)), minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(total)], names=["key", "n"])

    return materialise(words.select("lang", "w", "n").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "ctw-cells")


def _log_gamma(x, log):
    """log of the gamma function for x from 0.5 on, of numpy arrays or of columns."""
    y = x + 7
    series = (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))


def _log_kt(n0, n1, log):
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5, log) + _log_gamma(n1 + 0.5, log) - _log_gamma(n0 + n1 + 1.0, log) - math.log(math.pi)


class Level:
    """Nodes of one depth: key (context * 256 + path of bits), counts, log of the weighted probability, share of the own estimate."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        own = _log_kt(n0, n1, np.log)
        if below is None:
            self.weighted, self.beta = own, np.ones(len(own))
        else:
            self.weighted = np.logaddexp(own, below) - math.log(2)
            self.beta = np.exp(own - math.log(2) - self.weighted)
        self.up = np.zeros(0, np.int64)

    def parent(self, depth: int) -> Level:
        """The level above, at this depth; self.up then has each node's place in it."""
        context = (self.key >> _U8) & np.uint64((1 << (8 * depth)) - 1)
        key, self.up = np.unique(context << _U8 | self.key & np.uint64(255), return_inverse=True)
        total = lambda x: np.bincount(self.up, weights=x, minlength=len(key))
        return Level(key, total(self.n0), total(self.n1), total(self.weighted))


def _bits(byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The path of the first j bits, and the next bit."""
    return np.uint64(1 << j) | byte >> np.uint64(8 - j), byte >> np.uint64(7 - j) & np.uint64(1)


def grow(cells: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels SPLIT to DEPTH of the subtrees of all cells given."""
    context, byte = cells >> _U8, cells & np.uint64(255)
    parts = [_bits(byte, j) for j in range(8)]
    key, back = np.unique(np.concatenate([context << _U8 | node for node, _ in parts]), return_inverse=True)
    ones, times = np.concatenate([bit for _, bit in parts]).astype(bool), np.tile(n, 8).astype(float)
    levels = [Level(key, *(np.bincount(back, weights=times * x, minlength=len(key)) for x in (~ones, ones)), None)]
    for d in range(DEPTH - 1, SPLIT - 1, -1):
        levels.insert(0, levels[0].parent(d))
    return levels


def read(levels: list[Level], share: np.ndarray, rest: np.ndarray, end: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """log10 of each cell's byte, from what the nodes of the first level have: share, rest and end (see _down)."""
    for level in levels[1:]:
        share, rest, end = share[level.up], rest[level.up], end[level.up]
        seen, kt = level.n0 + level.n1 > 0, (level.n1 + 0.5) / (level.n0 + level.n1 + 1)
        share, rest, end = np.where(seen, share + rest * level.beta * kt, end), np.where(seen, rest * (1 - level.beta), 0.0), np.where(seen, share + rest * kt, end)
    context, byte = cells >> _U8, cells & np.uint64(255)
    out = np.zeros(len(cells))
    for j in range(8):
        node, bit = _bits(byte, j)
        p = np.clip(end[np.searchsorted(levels[-1].key, context << _U8 | node)], 1e-12, 1 - 1e-12)
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come ordered by their first column: about _CELLS rows at a time, each value's rows together."""
    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        size += batch.num_rows
        if size < _CELLS or not batch.num_rows:
            continue
        own = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut:
            yield [x[:cut] for x in own]
        held, size = [[x[cut:].copy() for x in own]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _suffix(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND((1 << (8 * SPLIT)) - 1)


def _up(nodes: DataFrame, depth: int) -> DataFrame:
    """The level above ``nodes`` (key, n0, n1, weighted), at this depth, with each node's beta."""
    key = F.shiftleft(F.shiftright("key", 8).bitwiseAND((1 << (8 * depth)) - 1), 8).bitwiseOR(F.col("key").bitwiseAND(255))
    total = nodes.groupBy(key.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
    own = total.withColumn("own", _log_kt(F.col("n0"), F.col("n1"), F.log))
    most, least = F.greatest("own", "below"), F.least("own", "below")
    mixed = own.withColumn("weighted", most + F.log1p(F.exp(least - most)) - math.log(2))
    return materialise(mixed.select("key", "n0", "n1", "weighted", F.exp(F.col("own") - math.log(2) - F.col("weighted")).alias("beta")), "ctw-nodes")


def _down(nodes: DataFrame, above: DataFrame, depth: int) -> DataFrame:
    """key, share, rest, end of nodes at this depth, from those above.

    A node's end is the probability of a 1 if its path ends there; share is what the depths up to it give to a longer path, and
    rest the weight that they leave to deeper nodes.
    """
    n, kt = F.col("n0") + F.col("n1"), (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    up = F.shiftleft(F.shiftright("key", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1), 8).bitwiseOR(F.col("key").bitwiseAND(255)) if depth else F.lit(None).cast("long")
    seen = lambda then, other: F.when(n > 0, then).otherwise(other)
    rows = nodes.withColumn("_up", up).join(above.select(F.col("key").alias("_up"), F.col("share").alias("s"), F.col("rest").alias("r"), F.col("end").alias("e")), "_up")
    s, r, e = (F.col(c) for c in "sre")
    return rows.select("key", seen(s + r * F.col("beta") * kt, e).alias("share"), seen(r * (1 - F.col("beta")), F.lit(0.0)).alias("rest"), seen(s + r * kt, e).alias("end"))


def weigh(cells: DataFrame) -> DataFrame:
    """key, lp: log10 of the byte of each cell after its context, in the weighted tree of all cells (key, n)."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in _suffixes(batches):
            top = grow(key.view(np.uint64), n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(top.key.view(np.int64)), *map(pa.array, (top.n0, top.n1, top.weighted, top.beta))], names=["key", "n0", "n1", "weighted", "beta"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, share, rest, end in _suffixes(batches):
            top = np.flatnonzero(n < 0)
            top = top[np.argsort(key[top])]
            own = n >= 0
            cell = key[own].view(np.uint64)
            # The first level's nodes are those that the tables above have, in the order of their keys.
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(read(grow(cell, n[own]), share[top], rest[top], end[top], cell))], names=["key", "lp"])

    suffix = _suffix(F.col("key"), 8).alias("suffix")
    rows = cells.select(suffix, "key", "n")
    levels = [materialise(rows.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(up, "key long, n0 double, n1 double, weighted double, beta double"), "ctw-nodes")]
    for d in range(SPLIT - 1, -1, -1):
        levels.insert(0, _up(levels[0], d))
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    # The root has every path: nothing stands above it.
    state = levels[0].select("key", (F.col("beta") * kt).alias("share"), (1 - F.col("beta")).alias("rest"), kt.alias("end"))
    for d in range(1, SPLIT + 1):
        state = _down(levels[d], state, d)
    state = materialise(state, "ctw-state")
    none = F.lit(None).cast("double")
    both = rows.select("*", none.alias("share"), none.alias("rest"), none.alias("end")).union(state.select(suffix, "key", F.lit(-1).cast("long").alias("n"), "share", "rest", "end"))
    return materialise(both.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(finish, "key long, lp double"), "ctw-read")


def score_words(words: DataFrame, cells: DataFrame, most_sent: int = SENT_CELLS) -> DataFrame:
    """k, lp: log10 of each word of words (lang, w, k) and its end, the sum over its cells.

    Up to most_sent cells go to all tasks; more of them are joined with the words' places.  The sums are the same.
    """
    if cells.count() <= most_sent:
        table = cells.toArrow()
        key, lp = table.column("key").to_numpy().view(np.uint64), table.column("lp").to_numpy()
        order = np.argsort(key)
        shared = words.sparkSession.sparkContext.broadcast((key[order], lp[order]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, lp = shared.value
            for batch in batches:
                langs, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i in range(0, len(own), 20_000):
                    cell, first = word_cells(langs[i : i + 20_000], own[i : i + 20_000])
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 20_000), pa.array(np.add.reduceat(lp[np.searchsorted(key, cell)], first[:-1]))], names=["k", "lp"])

        return words.select("lang", "w", "k").mapInArrow(score, "k long, lp double")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, own, k = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for i in range(0, len(own), 20_000):
                cell, first = word_cells(langs[i : i + 20_000], own[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k[i : i + 20_000], np.diff(first))), pa.array(cell.view(np.int64))], names=["k", "key"])

    return words.select("lang", "w", "k").mapInArrow(places, "k long, key long").join(cells, "key").groupBy("k").agg(F.sum("lp").alias("lp"))


def gap_model(pairs: np.ndarray) -> np.ndarray:
    """log10 of each place after each other one, from 64 counts: three binary choices, each a tree of depth 1."""
    n, out = pairs.reshape(8, 8).astype(float), np.zeros((8, 8))
    for j in range(3):
        for path in range(1 << j):
            width = 8 >> j
            low, high = path * width, path * width + width // 2
            n0, n1 = n[:, low:high].sum(axis=1), n[:, high : low + width].sum(axis=1)
            own, below = _log_kt(np.array([n0.sum()]), np.array([n1.sum()]), np.log)[0], _log_kt(n0, n1, np.log).sum()
            beta = 1 / (1 + math.exp(min(700.0, below - own)))
            p = beta * (n1.sum() + 0.5) / (n0.sum() + n1.sum() + 1) + (1 - beta) * (n1 + 0.5) / (n0 + n1 + 1)
            out[:, low:high] += np.log10(1 - p)[:, None]
            out[:, high : low + width] += np.log10(p)[:, None]
    return out.reshape(-1)


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", most_sent: int = SENT_CELLS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents that are not held out and scores all.  The score is log10 of the probability of the text's code, which
    the text alone decides: a column ``lang`` is looked at in training only, to learn what languages look like; without it there is one
    language.  A null text is empty: it has its end alone.  Repeated rows count as often as they stand there and score alike.  Very long texts are read whole, one at a time.
    The ``frequent`` most frequent words are looked up in a table of bounded size, all others by a join.  No training text: all counts are 0.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), held_out.alias("held_out"), lang.alias("lang"))
    model = spark.sparkContext.broadcast(learn_languages(rows))
    counts = count_words(rows, model)
    word_key = F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(b"\x00"), F.col("w")))  # seed 42
    words = counts.where("kind = 0").select("lang", "w", "n", word_key.alias("k"))
    pairs = np.zeros(64)
    for r in counts.where("kind = 1").collect():  # at most 64
        pairs[r["w"][0]] = r["n"]
    ends = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_lang = counts.where("kind = 2").groupBy("lang").agg(F.sum("n").alias("texts"))
    langs = len(model.value["names"])
    scored_words = score_words(words, weigh(count_cells(words)), most_sent)
    known = words.groupBy(F.xxhash64("w").alias("kw")).agg(F.sum("n").alias("c"))
    table = words.select("k", F.xxhash64("w").alias("kw")).join(scored_words, "k").join(known, "kw").select("k", "c", "lp")
    table = materialise(table, "ctw-vocabulary")
    distinct, total = known.where("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    steps = range(50)
    above = table.agg(*(F.count_if(F.col("c") >= F.lit(1 << j)) for j in steps)).first()
    least = next(1 << j for j in steps if above[j] <= frequent or j == steps[-1])
    top = table.where(F.col("c") >= least).toArrow()  # at most `frequent` words
    order = np.argsort(top.column("k").to_numpy())
    shared = spark.sparkContext.broadcast((*(top.column(c).to_numpy()[order] for c in ("k", "c", "lp")), gap_model(pairs)))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, log_p, gaps = shared.value
        for batch in batches:
            for first, texts in _chunks(batch, 1):
                n, every = len(texts), languages_of(model.value, texts)
                split = [text.split() for text in texts]
                size = np.array([len(x) for x in split], np.int64)
                index: dict[str, dict[bytes, int]] = defaultdict(dict)
                ids = []
                for g, x in zip(every, split, strict=True):
                    own = index[g]
                    put = own.setdefault
                    ids.append(np.fromiter((put(w, len(own)) for w in x), np.int64, len(x)))
                offset = dict(zip(index, np.cumsum([0, *map(len, index.values())]).tolist(), strict=False))
                ids = np.concatenate([i + offset[g] for i, g in zip(ids, every, strict=True)])
                k = np.fromiter((xxhash.xxh64_intdigest(front + w, 42) for g, own in index.items() for front in [g.encode() + b"\x00"] for w in own), np.uint64, sum(map(len, index.values()))).view(np.int64)
                spot = np.minimum(np.searchsorted(key, k), max(0, len(key) - 1))
                hit = key[spot] == k if len(key) else np.zeros(len(k), bool)
                c, lp = (np.where(hit, x[spot], 0) if len(key) else np.zeros(len(k)) for x in (number, log_p))
                text_of = np.repeat(np.arange(n), size)
                # Each text is summed by itself, so that its score doesn't depend on the texts beside it.
                total_of = lambda x: np.bincount(text_of, weights=x[ids], minlength=n)  # noqa: B023, E731
                pair, start = _gaps(texts)
                here = np.flatnonzero(~hit[ids])
                once, times = np.unique(text_of[here] * max(1, len(k)) + ids[here], return_counts=True)
                offsets = np.searchsorted(once, np.arange(n + 1) * max(1, len(k))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(first, n) for i in (0, 2)), pa.array(every, pa.string()), pa.array(size + 1), pa.array(total_of((c > 0).astype(float)).astype(np.int64)), pa.array(total_of(np.log10(c + 1.0))),
                        pa.array(total_of(lp) + np.add.reduceat(gaps[pair], start[:-1])), pa.array(np.array([len(x) + 1 for x in texts], np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(k[once % max(1, len(k))])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))),
                    ],
                    names=["doc_id", "held_out", "lang", "n_tokens", "known", "partial", "score", "bytes", "rest_k", "rest_n"],
                )

    schema = f"doc_id {id_type}, held_out boolean, lang string, n_tokens long, known long, partial double, score double, bytes long, rest_k array<long>, rest_n array<long>"
    scored = materialise(rows.select("doc_id", "text", "held_out").mapInArrow(score, schema).withColumn("_row", F.monotonically_increasing_id()), "ctw-scored")
    rest = scored.select("_row", F.explode(F.arrays_zip("rest_k", "rest_n")).alias("x")).select("_row", F.col("x.rest_k").alias("k"), F.col("x.rest_n").alias("times"))
    times = F.col("times")
    found = rest.join(table.where(F.col("c") < least), "k").groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("m_known"), F.sum(times * F.log10(F.col("c") + 1)).alias("m_log"), F.sum(times * F.col("lp")).alias("m_score"))
    more = lambda name, zero: F.coalesce(name, F.lit(zero))
    share = (more("texts", 0) + 0.5) / (ends + 0.5 * langs)
    score_all = F.col("score") + more("m_score", 0.0) + F.log10(share)
    return scored.drop("rest_k", "rest_n").join(found, "_row", "left").join(by_lang, "lang", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + more("m_known", 0) + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("partial") + more("m_log", 0.0) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), score_all.alias("score"),
        (score_all * (-math.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
