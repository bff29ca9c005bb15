"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text, and perplexity quantiles by language.

Counts of runs of words, their continuation counts and their context sums are Spark aggregations over 64-bit hashes of the runs.
The model is learned from a bounded sample of trusted documents, so the orders below trigrams and the weights of contexts have a
bounded size and go to all tasks; they give each text's bits as if no trigram were known.  The trigrams that may be known (both
their pairs are, and a bitmap of fixed size has their hash) are then joined, sharded by hash, with the trigram counts, and what the join finds is added to each text's bits.
Thresholds are of all trusted documents that the model didn't learn from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, discard, materialise, may_have, others, unused

OWN = ["bits", "words", "surprise", "perplexity", "threshold", "kept"]
#: Most numbers of rows that are broadcast to take the rows out (8 bytes each).
SENT_ROWS = 1_000_000
START, STOP = xxhash.xxh64_intdigest(b"\x00<s>"), xxhash.xxh64_intdigest(b"\x00</s>")
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _K) ^ b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' different words (and of start and stop), texts as numbers of them between two starts and a stop; the
    places to score; the first such place of each text."""
    split = [(t or b"").split() for t in texts]
    size = np.array([len(x) for x in split], np.int64)
    index: dict[bytes, int] = {}
    put = index.setdefault
    ids = np.fromiter((put(w, len(index)) for x in split for w in x), np.int64, size.sum())
    own = np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index)), np.array([START, STOP], np.uint64)])
    first = np.concatenate([[0], np.cumsum(size + 3)])
    seq = np.full(first[-1], len(index))
    seq[first[1:] - 1] = len(index) + 1
    seq[np.arange(size.sum()) + np.repeat(3 * np.arange(len(texts)) + 2, size)] = ids
    scored = np.ones(len(seq), bool)
    scored[first[:-1]] = scored[first[:-1] + 1] = False
    return own, seq, np.flatnonzero(scored), np.concatenate([[0], np.cumsum(size + 1)])


def trusted(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """All ids whose labels are all 1 (null: none): doc_id, h."""
    h = F.xxhash64("doc_id", F.lit("trusted"))
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("q")).where("q = 1")
    return good.select("doc_id", h.alias("h"))


def fit_sample(good: DataFrame, rows: int) -> DataFrame:
    """doc_id of at most so many trusted documents to learn from, chosen by hash among 3 of 5."""
    return good.where(F.pmod("h", F.lit(5)) < 3).orderBy("h", "doc_id").limit(rows).select("doc_id")


def word_hashes(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the texts' words, with start and stop: 8 bytes a word, bounded by the sample."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(sequences(batch.column(0).slice(i, 500).to_pylist())[0]).view(np.int64))], names=["w"])

    own = texts.select("text").mapInArrow(words, "w long").distinct().toArrow().column("w").to_numpy().view(np.uint64)
    return np.unique(np.concatenate([own, np.array([START, STOP], np.uint64)]))


def count_trigrams(texts: DataFrame, known) -> DataFrame:
    """a, b, c, n of all texts (column text, binary), words as places in the broadcast vocabulary: partial sums in each task, then by trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                own, seq, at, _ = sequences(batch.column(0).slice(i, 500).to_pylist())
                seq = np.searchsorted(known.value, own).astype(np.int32)[seq]
                rows, n = np.unique(np.stack([seq[at - 2], seq[at - 1], seq[at]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(3)), pa.array(n.astype(np.int64))], names=["a", "b", "c", "n"])

    return texts.select("text").mapInArrow(count, "a int, b int, c int, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from how many runs were seen 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    clip = lambda x, most: min(most, max(0.1, x))
    return np.array([clip(1 - 2 * y * n2 / max(1, n1), 0.95), clip(2 - 3 * y * n3 / max(1, n2), 1.95), clip(3 - 4 * y * n4 / max(1, n3), 2.95)])


def _lost(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What counts lose to the discounts: 0 for no count."""
    return np.where(n > 0, d[np.minimum(n, 3) - 1], 0.0)


def pack_pairs(key: np.ndarray, n: np.ndarray, total: np.ndarray, lost: np.ndarray, once: float) -> dict[str, np.ndarray | float]:
    """Pairs of words by hash: how many different words stand before (n), how often the pair is a context (total), what its counts lose (lost).

    Most pairs are there once and so have the same numbers: of these only 48 bits of the hash are kept, sent as 32 and a table of
    where each 16 higher bits begin.  Plain arrays, so that workers can read a broadcast of them without this module.
    """
    order = np.argsort(key)
    key, n, total, lost = (x[order] for x in (key, n, total, lost))
    single = (n == 1) & (total == 1)
    rest = key[single] >> np.uint64(16)
    begin = np.searchsorted(rest, np.arange((1 << 16) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int64)
    return {
        "once": once, "low": (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32), "begin": begin,
        "key": key[~single], "n": n[~single].astype(np.int32), "total": total[~single].astype(np.int32), "lost": lost[~single],
    }


def find_pairs(pairs: dict, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, total and lost of pairs by hash: 0 for a pair that isn't there."""
    if "single" not in pairs:
        pairs["single"] = np.repeat(np.arange(1 << 16, dtype=np.uint64) << np.uint64(32), np.diff(pairs["begin"])) | pairs["low"]
    single, known = pairs["single"], pairs["key"]
    n, total, lost = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key))
    if len(single):
        short = key >> np.uint64(16)
        hit = single[np.minimum(np.searchsorted(single, short), len(single) - 1)] == short
        n[hit], total[hit], lost[hit] = 1, 1, pairs["once"]
    if len(known):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
        n[hit], total[hit], lost[hit] = pairs["n"][at[hit]], pairs["total"][at[hit]], pairs["lost"][at[hit]]
    return n, total, lost


def train(texts: DataFrame) -> tuple[dict, DataFrame]:
    """The model of texts (column text, binary): the lower orders as numbers of words and of pairs, and the trigrams as a table: k
    (hash), gain (count less discount).

    Pairs pass through the driver, 48 bytes each: no more than the sample's words.
    """
    words = word_hashes(texts)
    known = texts.sparkSession.sparkContext.broadcast(words)
    n3 = materialise(count_trigrams(texts, known), "kn-3")
    d3 = _discounts(*n3.agg(*(F.count_if(F.col("n") == i) for i in range(1, 5))).first())
    start = F.col("b") == int(np.searchsorted(words, np.uint64(START)))
    pairs = n3.groupBy("b", "c").agg(F.when(start, F.sum("n")).otherwise(F.count("*")).alias("n")).toArrow()
    b, c, n2 = (pairs.column(x).to_numpy().astype(np.int32) for x in ("b", "c", "n"))
    del pairs
    n1 = np.bincount(c, minlength=len(words))
    d2, d1 = (_discounts(*(np.count_nonzero(n == i) for i in range(1, 5))) for n in (n2, n1))
    every, vocabulary = int(n1.sum()), int(np.count_nonzero(n1))
    unknown = _lost(n1, d1).sum() / max(1, every) / (vocabulary + 1) if every else 1.0
    total2 = np.bincount(b, weights=n2, minlength=len(words))
    gamma2 = np.bincount(b, weights=_lost(n2, d2), minlength=len(words)) / np.maximum(total2, 1)
    k2 = _mix(words[b], words[c])
    del b, c
    of_lost = F.when(F.col("n") == 1, float(d3[0])).when(F.col("n") == 2, float(d3[1])).otherwise(float(d3[2]))
    ab = n3.groupBy("a", "b").agg(F.sum("n").cast("int").alias("total"), F.sum(of_lost).alias("lost")).toArrow()
    k3, total, lost = _mix(words[ab.column("a").to_numpy()], words[ab.column("b").to_numpy()]), ab.column("total").to_numpy(), ab.column("lost").to_numpy()
    del ab
    # One table of pairs, without copies that outlive their use.
    key = np.concatenate([k2, k3])
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    n, total3, lost3 = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32), np.zeros(len(key))
    n[np.searchsorted(key, k2)] = n2
    del k2
    at = np.searchsorted(key, k3)
    total3[at], lost3[at] = total, lost
    table = pack_pairs(key, n, total3, lost3, float(d3[0]))
    del k3, at, total, lost, key, n, total3, lost3

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = (known.value[batch.column(i).to_numpy()] for i in range(3))
            n = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_mix(_mix(a, b), c).view(np.int64)), pa.array(n - d3[np.minimum(n, 3) - 1])], names=["k", "gain"])

    trigrams = materialise(n3.select("a", "b", "c", "n").mapInArrow(gains, "k long, gain double"), "kn-trigrams")
    lower = {
        "words": words, "p1": (n1 - _lost(n1, d1)) / max(1, every) + unknown, "total2": total2, "gamma2": gamma2, "d2": d2, "unknown": unknown,
        "pairs": table, "map": bitmap(trigrams, "k"),
    }
    discard(n3)
    return lower, trigrams


def surprise(lower: dict, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits of each text without known trigrams, the words coded (its stop included); trigrams that may be known: their text, hash
    and odds (of a known one with gain g, its probability is 1 + g * odds times what the bits took it for)."""
    own, seq, at, first = sequences(texts)
    words = lower["words"]
    spot = np.minimum(np.searchsorted(words, own), len(words) - 1)
    there = words[spot] == own
    p1 = np.where(there, lower["p1"][spot], lower["unknown"])[seq[at]]
    total2, gamma2 = (np.where(there, lower[x][spot], 0.0)[seq[at - 1]] for x in ("total2", "gamma2"))
    # The pair of a place and the one behind it: what precedes a word is the pair one place before.
    n, total, lost = find_pairs(lower["pairs"], _mix(own[seq[:-1]], own[seq[1:]]))
    n, total, lost = n[at - 1], total[at - 2], lost[at - 2]
    p = np.where(total2 > 0, (n - _lost(n, lower["d2"])) / np.maximum(total2, 1) + gamma2 * p1, p1)
    p = np.where(total > 0, p * lost / np.maximum(total, 1), p)
    # A trigram is known only if both its pairs are, and never if the bitmap hasn't its hash.
    where = np.flatnonzero((n > 0) & (total > 0))
    k = _mix(_mix(own[seq[at[where] - 2]], own[seq[at[where] - 1]]), own[seq[at[where]]])
    there = may_have(lower["map"], k)
    where, k = where[there], k[there]
    odds = (1 / (total[where] * p[where])).astype(np.float32)
    text = np.searchsorted(first, where, side="right") - 1
    # Each text is summed by itself and in double precision, so that its bits don't depend on the texts beside it.
    bits = np.add.reduceat(-np.log2(p), first[:-1]) if len(texts) else np.zeros(0)
    return bits, np.diff(first), text, k, odds


def surprise_column(shared, text: Column) -> Column:
    """struct<bits, words, k, odds> of a text in the broadcast lower orders, in Arrow batches."""

    @F.pandas_udf("bits double, words long, k array<long>, odds array<float>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out, own, size = [], [], 0
            for i, text in enumerate(series):
                own.append(text)
                size += len(text or b"")
                if size > 2_000_000 or i == len(series) - 1:
                    bits, words, at, k, odds = surprise(shared.value, own)
                    cut = np.searchsorted(at, np.arange(1, len(own)))
                    out.append(pd.DataFrame({"bits": bits, "words": words, "k": np.split(k.view(np.int64), cut), "odds": np.split(odds, cut)}))
                    own, size = [], 0
            yield pd.concat(out) if out else pd.DataFrame({"bits": np.zeros(0), "words": np.zeros(0, np.int64), "k": [], "odds": []})

    return score(text.cast("binary"))


def exact_quantiles(rows: DataFrame, quantile: float, width: float = 1 / 256) -> DataFrame:
    """lang, t: each group's quantile of h, interpolated between neighbours as F.percentile does, over any number of rows.

    Counts by bins of h show which bins hold the two neighbours; only those bins' distinct values are put in order.
    """
    binned = rows.withColumn("bin", F.floor(F.col("h") / width))
    group = W.partitionBy("lang")
    sizes = binned.groupBy("lang", "bin").agg(F.count("*").alias("m"))
    rank = quantile * (F.sum("m").over(group) - 1)
    upto = F.sum("m").over(group.orderBy("bin")) - F.col("m")
    spots = sizes.select("lang", "bin", "m", upto.alias("before"), rank.alias("rank")).where((F.col("before") <= F.ceil("rank")) & (F.floor("rank") < F.col("before") + F.col("m")))
    spots = spots.select(F.col("lang").alias("_lang"), F.col("bin").alias("_bin"), "before", "rank")
    values = binned.join(F.broadcast(spots), (F.col("bin") == F.col("_bin")) & F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "bin", "before", "rank", "h")
    values = values.groupBy("lang", "bin", "before", "rank", "h").agg(F.count("*").alias("m"))
    last = F.col("before") + F.sum("m").over(W.partitionBy("lang", "bin").orderBy("h"))
    at = lambda r: F.max(F.when((F.col("last") - F.col("m") <= r) & (r < F.col("last")), F.col("h")))
    low, high = at(F.floor("rank")), at(F.ceil("rank"))
    ends = values.withColumn("last", last).groupBy("lang").agg(low.alias("low"), high.alias("high"), F.first("rank").alias("rank"))
    return ends.select("lang", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))).alias("t"))


def quality(
    docs: DataFrame, labels: DataFrame, sample: int = 5000, quantile: float = 0.995, prior_words: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = True
) -> DataFrame:
    """docs with bits, words, surprise (bits a word), perplexity, threshold and kept, which replace columns of these names.

    Of the trusted documents (all labels 1) three fifths, but at most ``sample``, train the model; all others, however many, give each
    language's quantile of surprise, in which ``prior_words`` words at the language's mean stand beside a text's own so that short texts
    aren't rejected by chance.  Languages with fewer than 50 such documents, and null ones, take the quantile over all.  No trusted
    documents: all are kept.  A null text is an empty one.  Rows that repeat are kept or rejected alike; very long texts are read whole.
    Other columns stay, whatever their names (without ``with_text`` all but the text).  An empty table gives an empty result.
    """
    rows, verdicts = judge(docs, labels, sample, quantile, prior_words, id_col, text_col, lang_col, with_text)
    (row,) = unused(docs.columns, "row")
    joined = rows.join(verdicts.withColumnsRenamed({"row": row} | {c: f"{row}{c}" for c in OWN}), row)
    return joined.select(*others(rows, [*OWN, row]), *(F.col(f"{row}{c}").alias(c) for c in OWN))


def kept_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns.  The numbers of rejected rows are broadcast while they are few."""
    rows, verdicts = judge(docs, labels, text_col=text_col)
    (row,) = unused(docs.columns, "row")
    rejected = materialise(verdicts.where("not kept").select(F.col("row").alias(row)), "kn-rejected")
    rejected = F.broadcast(rejected) if rejected.count() <= SENT_ROWS else rejected
    return rows.join(rejected, row, "left_anti").select(*docs.columns)


def judge(
    docs: DataFrame, labels: DataFrame, sample: int = 5000, quantile: float = 0.995, prior_words: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_text: bool = True
) -> tuple[DataFrame, DataFrame]:
    """docs as written once with a number for each row (an unused name), and each row's verdict: row and the columns of OWN."""
    spark = docs.sparkSession
    good = trusted(labels, id_col)
    chosen = materialise(fit_sample(good, sample), "kn-sample")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # The sample's ids are at most `sample` rows.
    learned = materialise(texts.join(F.broadcast(chosen), "doc_id").select("text"), "kn-texts")
    lower, trigrams = train(learned)
    discard(learned)
    row, name = unused(docs.columns, "row", "scored")
    own = [c for c in docs.columns if with_text or c != text_col]
    scored = docs.withColumn(name, surprise_column(spark.sparkContext.broadcast(lower), F.col(text_col))).select(*own, name)
    scored = materialise(scored.withColumn(row, F.monotonically_increasing_id()), "kn-scored")
    narrow = scored.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), f"{name}.bits", f"{name}.words")
    asked = scored.select(F.col(row).alias("row"), F.explode(F.arrays_zip(f"{name}.k", f"{name}.odds")).alias("x")).select("row", "x.k", "x.odds")
    known = asked.join(trigrams, "k").groupBy("row").agg(F.sum(F.log2(1 + F.col("gain") * F.col("odds"))).alias("less"))
    coded = materialise(narrow.join(known, "row", "left").select("row", "doc_id", "lang", (F.col("bits") - F.coalesce("less", F.lit(0.0))).alias("bits"), "words"), "kn-coded")
    # Trusted ids meet narrow rows.
    ids = good.join(F.broadcast(chosen), "doc_id", "left_anti").select("doc_id")
    held = materialise(coded.where("doc_id is not null").join(ids, "doc_id").select("lang", "bits", "words"), "kn-held")
    everything = held.agg(F.sum("bits") / F.sum("words")).first()[0]
    rows = scored.drop(name)
    if everything is None:
        empty = [F.lit(None).cast(t).alias(n) for n, t in (("surprise", "double"), ("perplexity", "double"), ("threshold", "double"))]
        return rows, coded.select("row", F.lit(None).cast("double").alias("bits"), F.lit(None).cast("long").alias("words"), *empty, F.lit(True).alias("kept"))
    means = materialise(held.groupBy("lang").agg((F.sum("bits") / F.sum("words")).alias("mean"), F.count("*").alias("n")).where("n >= 50 and lang is not null").select("lang", "mean"), "kn-means")
    smooth = lambda bits, words, mean: (bits + prior_words * mean) / (words + prior_words)
    smoothed = held.join(means, "lang", "left").select("lang", smooth(F.col("bits"), F.col("words"), F.coalesce("mean", F.lit(everything))).alias("h"), F.col("mean").isNotNull().alias("enough"))
    overall = exact_quantiles(smoothed.select(F.lit(None).cast("string").alias("lang"), "h"), quantile).first()["t"]
    # One row for each language with 50 documents or more.
    limits = materialise(exact_quantiles(smoothed.where("enough"), quantile).join(means, "lang").select("lang", "mean", "t"), "kn-limits")
    full = coded.join(limits, "lang", "left")
    bits, words, threshold = F.col("bits"), F.col("words"), F.coalesce("t", F.lit(overall))
    smoothed = smooth(bits, words, F.coalesce("mean", F.lit(everything)))
    return rows, full.select("row", "bits", "words", smoothed.alias("surprise"), F.pow(F.lit(2.0), bits / words).alias("perplexity"), threshold.alias("threshold"), (smoothed <= threshold).alias("kept"))
