"""Toxicity: a linear-chain conditional random field over words, learned from documents' labels.

Words that stand in many contexts of toxic documents and seldom in others form a lexicon; in toxic documents its words are
the labelled tokens.  A field of two tags (toxic or not) is trained on stretches of words: a word's emission is the sum of weights
of its identity, beginning, ending and length and of its two neighbours, all hashed, so that words which the lexicon doesn't have
are tagged too.  To score a text, forward and backward messages run over all its words.  The marginals give spans of
offending words, and together the text's score, which is calibrated on labelled documents that the field didn't learn from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, others, unused

#: A-Z to lower case; ASCII punctuation and control characters to a blank.
_TABLE = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256)).lower()
SEGMENT = 32
#: Weights of hashed features (as many for words as for their beginnings, endings and lengths); features of a word.
WEIGHTS, FEATURES = 1 << 16, 6
PENALTY = np.full(2 * WEIGHTS + 4, 0.5)
#: Words of texts that are worked off side by side (at least one text).
CELLS = 500_000
OWN = ["score", "predicted", "spans"]
#: Raw scores are cut at this and 1 minus this before they are calibrated.
LEAST = 1e-3


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def learn_lexicon(sample: DataFrame, least_contexts: int = 3, least_docs: int = 3, ratio: float = 10.0) -> set[bytes]:
    """Words that mark toxic documents (columns text as binary, y); no more than the sample has.

    Documents of either kind that hold a word are counted.  A word must stand in several toxic documents, and in several contexts
    (the word before) in them, so that copies of one document don't make all its words suspicious.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contexts, toxic, clean = set(), Counter(), Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                (toxic if y else clean).update(set(words))
                if y:
                    contexts.update(zip(words, [b"", *words], strict=False))
            every, contexts = [*{**toxic, **clean}], list(contexts)
            none = [0] * len(contexts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w for w, _ in contexts] + every, pa.binary()), pa.array([xxhash.xxh64_intdigest(b) >> 1 for _, b in contexts] + [None] * len(every), pa.int64()),
                    pa.array(none + [toxic[w] for w in every], pa.int64()), pa.array(none + [clean[w] for w in every], pa.int64()),
                ],
                names=["w", "context", "toxic", "clean"],
            )

    totals = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    pairs = sample.select("text", "y").mapInArrow(count, "w binary, context long, toxic long, clean long").groupBy("w", "context").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    stats = pairs.groupBy("w").agg(F.count("context").alias("contexts"), F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where((F.col("contexts") >= least_contexts) & (F.col("a") >= least_docs))
    odds = F.log((F.col("a") + 0.5) / float(totals[0] + 1)) - F.log((F.col("b") + 0.5) / float(totals[1] + 1))
    return {bytes(r["w"]) for r in stats.withColumn("odds", odds).where(F.col("odds") >= math.log(ratio)).select("w").collect()}


class Words:
    """Numbers words and holds their feature places: identity, beginning, ending, length; as a word before; as a word behind."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.places = np.zeros((1024, FEATURES), np.int32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        get, out = self.number.get, np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = get(w)
            if n is None:
                n = self.number[w] = len(self.number)
                if n == len(self.places):
                    self.places = np.concatenate([self.places, np.zeros_like(self.places)])
                own, digest = xxhash.xxh64_intdigest(w), xxhash.xxh32_intdigest
                self.places[n] = [x % WEIGHTS for x in (own, digest(b"<" + w[:3]), digest(b">" + w[-3:]), digest(b"#%d" % min(12, len(w))), own >> 16, own >> 32)]
                self.places[n, 1:4] += WEIGHTS
            out[i] = n
        return out


#: Of the stretches of texts that aren't toxic one in so many is learned from, by hash, with so many times the weight.
THINNED = 4


def segments(sample: DataFrame, lexicon: set[bytes], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature places of stretches of SEGMENT words (rows, SEGMENT, FEATURES; -1: no word), tags, and how much each weighs.

    All stretches with lexicon words and each text's first count, of other ones of texts that aren't toxic every fourth, four times.  The
    driver holds at most ``most`` different ones: those with tags come first, then the order is by hash, and those without tags
    weigh as much more as there are more of them than it holds, so what is left out is made up for.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, weights = [], [], []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                toxic = [w in shared.value for w in words]
                for i in range(0, len(words), SEGMENT):
                    part = b" ".join(words[i : i + SEGMENT])
                    sure = i == 0 or any(toxic[i : i + SEGMENT])
                    if sure or (y == 0 and xxhash.xxh32_intdigest(part) % THINNED == 0):
                        rows.append(part)
                        marks.append(sum(1 << k for k, t in enumerate(toxic[i : i + SEGMENT]) if t and y == 1))
                        weights.append(1 if sure else THINNED)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(marks, pa.int64()), pa.array(weights, pa.int64())], names=["x", "marks", "w"])

    every = materialise(sample.select("text", "y").mapInArrow(cut, "x binary, marks long, w long").groupBy("x", "marks").agg(F.sum("w").alias("n")), "crf-stretches")
    clean = every.agg(F.sum(F.when(F.col("marks") == 0, F.col("n")))).first()[0]
    found = every.orderBy(F.col("marks") == 0, F.xxhash64("x", "marks"), "x").limit(most).toPandas()
    known = Words()
    ids = [known(bytes(x).split()) for x in found["x"]]
    out = np.full((len(ids), SEGMENT, FEATURES), -1, np.int32)
    for row, x in enumerate(ids):
        out[row, : len(x), :4] = known.places[x, :4]
        out[row, 1 : len(x), 4] = known.places[x[:-1], 4]
        out[row, : max(0, len(x) - 1), 5] = known.places[x[1:], 5]
    tags = (found["marks"].to_numpy(np.int64)[:, None] >> np.arange(SEGMENT)) & 1 == 1
    weight, bare = found["n"].to_numpy(np.float64), ~tags.any(axis=1)
    weight[bare] *= (clean or 0) / max(1.0, weight[bare].sum())
    return out, tags, weight


def _forward_backward(emit: np.ndarray, trans: np.ndarray, valid: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (rows, steps) of tag 1 and expected transitions (2, 2), from emission scores of tag 1."""
    n, steps = emit.shape
    e = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], axis=2)
    m = np.exp(trans)
    a, b = np.empty((n, steps, 2)), np.empty((n, steps, 2))
    for t in range(steps):
        now = e[:, t] if t == 0 else (a[:, t - 1] @ m) * e[:, t]
        a[:, t] = np.where(valid[:, t, None], now / now.sum(axis=1, keepdims=True), a[:, max(0, t - 1)])
    b[:, -1] = 1
    for t in range(steps - 2, -1, -1):
        now = (e[:, t + 1] * b[:, t + 1]) @ m.T
        b[:, t] = np.where(valid[:, t + 1, None], now / now.sum(axis=1, keepdims=True), 1)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    pair = a[:, :-1, :, None] * m[None, None] * (e[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p[:, :, 1], (pair * (valid[:, 1:] * times[:, None])[:, :, None, None]).sum(axis=(0, 1))


def fit(x: np.ndarray, tags: np.ndarray, times: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transition scores, by gradient ascent with adaptive steps."""
    valid, there, at = x[:, :, 0] >= 0, x >= 0, np.maximum(x, 0)
    weight, places = valid * times[:, None], at[there]
    count = lambda p: np.bincount(places, weights=np.broadcast_to((p * weight)[:, :, None], x.shape)[there], minlength=2 * WEIGHTS)
    seen = count(tags)
    pairs = np.array([[(((tags[:, :-1] == i) & (tags[:, 1:] == j)) * weight[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], float)
    params, m, v = np.zeros(len(PENALTY)), 0.0, 0.0
    for r in range(1, rounds + 1):
        weights, trans = params[:-4], params[-4:].reshape(2, 2)
        p, expected = _forward_backward((weights[at] * there).sum(axis=2), trans, valid, times)
        grad = np.concatenate([seen - count(p), (pairs - expected).ravel()]) - PENALTY * params
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        params = params + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.98**r)) + 1e-6)
    return params[:-4], params[-4:].reshape(2, 2)


def marginals(texts: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Probability of tag 1 for each word of texts given as emissions: messages run over whole texts, those of like length side by side.

    Of two tags only the ratio of the messages counts, in either direction.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(texts)
    m = np.exp(trans)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(texts[order[stop]]) <= CELLS:
            stop += 1
        part = [texts[i] for i in order[at:stop]]
        size = np.array([len(x) for x in part])
        steps = int(size[-1])
        e, r, s = (np.ones((steps, len(part))) for _ in range(3))
        for row, x in enumerate(part):
            e[: len(x), row] = np.exp(np.clip(x, -30, 30))
        # The first text that is longer than t: shorter ones have ended.
        first = np.searchsorted(size, np.arange(steps + 1), side="right")
        for t in range(steps):
            k = first[t]
            x = r[t - 1, k:]
            r[t, k:] = e[t, k:] if t == 0 else e[t, k:] * (m[0, 1] + x * m[1, 1]) / (m[0, 0] + x * m[1, 0])
        for t in range(steps - 2, -1, -1):
            k = first[t + 1]
            x = e[t + 1, k:] * s[t + 1, k:]
            s[t, k:] = (m[1, 0] + x * m[1, 1]) / (m[0, 0] + x * m[0, 1])
        p = r * s / (1 + r * s)
        for row, i in enumerate(order[at:stop]):
            out[i] = p[: size[row], row].copy()
        at = stop
    return out


def spans_of(text: bytes, places: dict[int, float]) -> list[dict]:
    """Offsets, in code points, of the words at these places."""
    starts = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    point = lambda i: int(starts[i - 1]) if i else 0
    words = re.finditer(rb"[^ ]+", text.translate(_TABLE))
    return [{"start": point(w.start()), "end": point(w.end()), "p": places[i]} for i, w in enumerate(words) if i in places]


def toxicity_column(spark, weights: np.ndarray, trans: np.ndarray, text: Column) -> Column:
    """struct<most, many, spans>: the largest marginal of a text, the sum of those of 0.5 or more, and the spans of these."""
    shared = spark.sparkContext.broadcast((weights, trans))

    @F.pandas_udf("most double, many double, spans array<struct<start:int,end:int,p:double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        (weights, trans), known, done = shared.value, Words(), 0
        own, before, behind = np.zeros((3, 0))
        for series in batches:
            most, many, spans = np.zeros(len(series)), np.zeros(len(series)), [[] for _ in range(len(series))]
            at = 0
            while at < len(series):
                stop, size = at, 0
                while stop < len(series) and (stop == at or size < 2_000_000):
                    size += len(series.iloc[stop] or b"")
                    stop += 1
                if len(known.number) > 1_000_000:
                    known, done, (own, before, behind) = Words(), 0, np.zeros((3, 0))
                ids = [known(words_of(t)) for t in series.iloc[at:stop]]
                if done < len(known.number):
                    new = known.places[done : len(known.number)]
                    own, before, behind = (np.concatenate([x, y]) for x, y in ((own, weights[new[:, :4]].sum(axis=1)), (before, weights[new[:, 4]]), (behind, weights[new[:, 5]])))
                    done = len(known.number)
                emit = []
                for x in ids:
                    e = own[x]
                    e[1:] += before[x[:-1]]
                    e[:-1] += behind[x[1:]]
                    emit.append(e)
                for row, p in enumerate(marginals(emit, trans), at):
                    if len(p):
                        hit = np.flatnonzero(p >= 0.5)
                        most[row], many[row] = p.max(), p[hit].sum()
                        if len(hit):
                            spans[row] = spans_of(series.iloc[row], dict(zip(hit.tolist(), p[hit].tolist(), strict=True)))
                at = stop
            yield pd.DataFrame({"most": most, "many": many, "spans": spans})

    return score(text.cast("binary"))


def _calibrate(most: np.ndarray, many: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the log-odds of a text's largest marginal (cut at LEAST and 1 - LEAST) and on how many there are."""
    cut = np.clip(most, LEAST, 1 - LEAST)
    x = np.stack([np.ones(len(most)), np.log(cut / (1 - cut)), np.log1p(many)], axis=1)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(3)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 1e-1 * w)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, label_col: str = "toxic") -> DataFrame:
    """At most so many usable labelled documents, chosen by hash of the id: text (binary), y, part (0 to 4).  An id with both labels counts as 1."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & usable).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    ids = materialise(ids.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))), "crf-ids")
    # At most `rows` ids.
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y", "part")


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 20_000, stretches: int = 20_000) -> tuple | None:
    """Weights, transitions and calibration from at most ``sample`` labelled documents, a fifth of them for the calibration; None without toxic ones."""
    own = materialise(labelled_sample(docs, labels, usable, sample), "crf-sample")
    lexicon = learn_lexicon(own.where("part < 4"))
    if not lexicon:
        return None
    weights, trans = fit(*segments(own.where("part < 4"), lexicon, stretches))
    scored = own.select("y", "part", toxicity_column(docs.sparkSession, weights, trans, F.col("text")).alias("s")).select("y", "part", "s.most", "s.many").toPandas()
    # Too few documents of either label were left apart: all are taken.
    apart = scored[scored["part"] == 4]
    use = apart if min((apart["y"] == 1).sum(), (apart["y"] == 0).sum()) >= 10 else scored
    return weights, trans, _calibrate(use["most"].to_numpy(), use["many"].to_numpy(), use["y"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """docs with score, predicted (1 from the threshold on) and spans (start, end in code points, p) of offending words, which replace columns of these names.

    ``usable`` says of a doc_id whether its labels may be learned from.  Null and empty texts have no spans and the score of a
    text without offending words; of very long ones the messages run over the whole text.  Without toxic labels all scores are 0.  Rows that repeat
    get the same score.  An empty table gives an empty result.
    """
    model = train(docs, labels, usable, sample)
    if model is None:
        return docs.select(*others(docs, OWN), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast("array<struct<start:int,end:int,p:double>>").alias("spans"))
    weights, trans, w = model
    (name,) = unused(docs.columns, "scored")
    scored = docs.withColumn(name, toxicity_column(docs.sparkSession, weights, trans, F.col("text")))
    cut = F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), F.col(f"{name}.most")))
    score = 1 / (1 + F.exp(-(float(w[0]) + float(w[1]) * F.log(cut / (1 - cut)) + float(w[2]) * F.log1p(F.col(f"{name}.many")))))
    return scored.select(*others(docs, OWN), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col(f"{name}.spans").alias("spans"))
