"""The pipeline, and its stages one by one, against plain Python without Spark."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilspark.llm import kneser_ney, tiling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": ["the", "of", "tree", "house", "river", "run", "walks", "green", "stone", "light", "with", "every"], "de": ["der", "und", "baum", "haus", "fluss", "geht", "stein", "licht", "ein", "alle"]}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    item = " ".join(rng.choice(WORDS["en"]) + str(rng.randrange(9)) for _ in range(24))
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = []
    for i in range(420):
        lang = "de" if i % 6 == 0 else "en"
        text = prose(lang, rng.randrange(15, 60))
        if i % 41 == 0:
            text = " ".join(f"q{rng.randrange(999)}z" for _ in range(40))
        elif i % 37 == 0:
            text = prose(lang, 5) + " " + " ".join(item.split()[12:] + ["and"] + item.split()[:12]) + " " + prose(lang, 5)
        elif i % 10 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        rows.append((i, text, lang, f"s{min(4, rng.randrange(9))}"))
    rows += [(500, None, None, None), (501, "", "en", "s0"), (502, " \n\t ", "de", None), (None, prose("en", 20), "en", "s1"), (503, "stone light " * 3000, "en", "s2"), rows[7], rows[7], (9, prose("en", 30), "en", "s1")]
    docs = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
    labels = [(i, int(i % 9 != 0 and i % 41 != 0), 0) for i in range(0, 420)] + [(None, 1, 0), (500, 1, 0), (14, 0, 0), (15, None, 0)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, item), (2, None), (3, "only three words"), (4, prose("de", 20))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, labels, items


def discounts(counts):
    n1, n2, n3, n4 = (sum(v == i for v in counts.values()) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    clip = lambda x, most: min(most, max(0.1, x))
    return [clip(1 - 2 * y * n2 / max(1, n1), 0.95), clip(2 - 3 * y * n3 / max(1, n2), 1.95), clip(3 - 4 * y * n4 / max(1, n3), 2.95)]


def brute_model(texts):
    """A function that gives the probability of c after a, b: counts in dictionaries, interpolated from the lowest order up."""
    tri, bi, uni = Counter(), Counter(), Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    for (_, b, c), n in tri.items():
        bi[b, c] += n if b == "<s>" else 1
    for _, c in bi:
        uni[c,] += 1
    orders = []
    for counts, split in ((tri, lambda k: k[:2]), (bi, lambda k: k[:1]), (uni, lambda k: ())):
        d, total, weight = discounts(counts), Counter(), Counter()
        for k, n in counts.items():
            total[split(k)] += n
            weight[split(k)] += d[min(n, 3) - 1]
        orders.append((counts, d, total, weight, split))

    def p(key):
        counts, d, total, weight, split = orders[3 - len(key)]
        lower = p(key[1:]) if len(key) > 1 else 1 / (len(uni) + 1)
        if not total[split(key)]:
            return lower
        n = counts[key]
        return ((n - d[min(n, 3) - 1] if n else 0) + weight[split(key)] * lower) / total[split(key)]

    return p


def brute_quality(docs, labels):
    """surprise, threshold of each row."""
    votes = defaultdict(list)
    for i, q, _ in labels:
        if i is not None and q is not None:
            votes[i].append(q)
    fit = {i: signed(xxhash.xxh64_intdigest(b"trusted", xxhash.xxh64_intdigest(struct.pack("<q", i), 42))) % 5 < 3 for i, v in votes.items() if min(v) == 1}
    p = brute_model([t or "" for i, t, *_ in docs if fit.get(i)])

    def bits(text):
        w = ["<s>", "<s>", *(text or "").split(), "</s>"]
        return -sum(math.log2(p(k)) for k in zip(w, w[1:], w[2:], strict=False)), len(w) - 2

    coded = [bits(t) for _, t, *_ in docs]
    held = [(r[2], *x) for r, x in zip(docs, coded, strict=True) if fit.get(r[0]) is False]
    mean_of = lambda rows: sum(b for _, b, _ in rows) / sum(n for *_, n in rows)
    means = {g: mean_of([h for h in held if h[0] == g]) for g, n in Counter(h[0] for h in held).items() if n >= 50 and g is not None}
    everything = mean_of(held)
    smooth = lambda g, b, n: (b + 20 * means.get(g, everything)) / (n + 20)
    h = [(g, smooth(g, b, n)) for g, b, n in held]
    limits = {g: np.quantile([x for k, x in h if k == g], 0.995) for g in means}
    overall = np.quantile([x for _, x in h], 0.995)
    return [(smooth(r[2], *x), limits.get(r[2], overall)) for r, x in zip(docs, coded, strict=True)]


def brute_fingerprint(text):
    """256 bits over runs of five words; the first 64 are those of XXH64."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    whole = (1 << 64) - 1

    def lane(h, k):
        if not k:
            return h
        x = (h + k * 0x9E3779B97F4A7C15) & whole
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    h = Counter(xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4)))
    total, out = sum(h.values()), 0
    for k in range(4):
        own = {lane(x, k): n for x, n in h.items()}
        for b in range(63, -1, -1):
            out = out << 1 | (2 * sum(n for x, n in own.items() if x >> b & 1) > total)
    return out


def brute_near_duplicates(docs):
    prints = [brute_fingerprint(r[1]) for r in docs]
    distinct = sorted(set(prints))
    root = {x: x for x in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 44 and root[a] != root[b]:
                old, new = root[b], root[a]
                root = {x: new if r == old else r for x, r in root.items()}
    groups = defaultdict(list)
    for r, x in zip(docs, prints, strict=True):
        groups[root[x]].append(r)
    rank = lambda r: (r[0] is None, r[0] or 0, 42 if r[1] is None else signed(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    return [min(g, key=rank) for g in groups.values()]


def brute_coverage(text, item):
    plain = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = plain(item), plain(text)
    least, used_a, used_b = min(5, len(a)), set(), set()
    while a:
        found = []
        for i in range(len(a)):
            for d in range(len(b)):
                n = 0
                while i + n < len(a) and d + n < len(b) and a[i + n] == b[d + n] and i + n not in used_a and d + n not in used_b:
                    n += 1
                if n >= least:
                    found.append((-n, i, d))
        if not found:
            break
        n, i, d = min(found)
        used_a.update(range(i, i - n))
        used_b.update(range(d, d - n))
    return len(used_a) / len(a) if a else 0.0


def brute_mix(docs):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted({r[3] for r in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in docs if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        stopped = {s for s in free if weight[s] * level > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in stopped} | ({} if stopped else {s: weight[s] * level for s in free})
        left -= sum(target[s] for s in stopped)
        free = free - stopped if stopped else set()
    digits, out = lambda r: max(1, size(r).bit_length()), []
    for s in names:
        words = Counter()
        for r in docs:
            if r[3] == s:
                words[digits(r)] += size(r)
        # How often a document of each class is wanted: in proportion to its class, three times at most.
        open_, rest, wanted = set(words), target[s], {}
        while open_:
            scale = sum(c * words[c] for c in open_)
            level = rest / scale if scale else 3.0
            over = {c for c in open_ if level * c > 3} if scale else set(open_)
            wanted |= {c: 3.0 for c in over} | ({} if over else {c: level * c for c in open_})
            rest -= sum(3 * words[c] for c in over)
            open_ = open_ - over if over else set()
        if not total[s]:
            continue
        ranks = defaultdict(list)
        for r in docs:
            if r[3] == s and (p := wanted[digits(r)] - math.floor(wanted[digits(r)])) > 0:
                u = (int(hashlib.md5(("mix" + ("null" if r[0] is None else str(r[0]))).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = (u / (1 - u)) / (p / (1 - p))
                ranks[math.floor(q / (1 + q) * 2**52)].append(r)
        left, upto, more = sum((wanted[c] - math.floor(wanted[c])) * n for c, n in words.items()), 0, Counter()
        for v in sorted(ranks):
            own = sum(map(size, ranks[v]))
            upto += own
            if 2 * left >= 2 * upto - own:
                more.update(ranks[v])
        for r in set(r for r in docs if r[3] == s):
            n = sum(x == r for x in docs)
            out += [r] * (n * math.floor(wanted[digits(r)]) + more[r])
    return out


def brute_shards(docs, n):
    key = lambda t: (signed(xxhash.xxh64_intdigest(t, 42)), zlib.crc32(t), len(t) + 1)
    rows = sorted((key((r[1] or "").encode()), r[0] is not None, r[0] or 0) for r in docs)
    sizes = Counter()
    for k, *_ in rows:
        sizes[k] += k[2]
    ends = [0, *np.cumsum([sizes[k] for k in sorted(sizes)]).tolist()]
    total = ends[-1]

    def fits(capacity, shards, base=0):
        for _ in range(shards):
            base = max(e for e in ends if e <= base + capacity)
        return base == total

    capacity = next(c for c in range(-(-total // n), total + 1) if fits(c, n))
    cuts, base = [], 0
    for left in range(n - 1, 0, -1):
        share = min(total, base + -(-(total - base) // (left + 1)))
        near = sorted({max(e for e in ends if e <= share), min((e for e in ends if e > share), default=total)}, key=lambda e: (abs(e - share), e))
        base = next((e for e in near if base <= e <= base + capacity and fits(capacity, left, e)), max(e for e in ends if e <= base + capacity))
        cuts.append(base)
    out, seen, upto = [], Counter(), 0
    for k, known, i in rows:
        upto += k[2]
        shard = sum(end_of > c for c in cuts) if (end_of := ends[sorted(sizes).index(k) + 1]) else 0
        out.append((i if known else None, k[2], k[1], shard, seen[shard]))
        seen[shard] += 1
    return out


def text_rows(rows):
    return sorted(map(repr, rows))


def test_quality_against_dictionaries(spark, tables):
    path, docs, labels, _ = tables
    got = kneser_ney.quality(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    want = defaultdict(list)
    for r, x in zip(docs, brute_quality(docs, labels), strict=True):
        want[r[0], r[1]].append(x)
    assert len(got) == len(docs)
    for r in got:
        surprise, threshold = want[r["doc_id"], r["text"]][0]
        assert abs(r["surprise"] - surprise) < 1e-4 and abs(r["threshold"] - threshold) < 1e-4
        assert r["kept"] == (surprise <= threshold) or abs(surprise - threshold) < 1e-4
    assert 0 < sum(not r["kept"] for r in got) < 30


def test_coverage_against_all_matches(spark, tables):
    path, docs, _, items = tables
    short = [r for r in docs if r[1] is None or len(r[1]) < 2000]
    pairs = tiling.contaminated(spark.createDataFrame(short, SCHEMA), spark.read.parquet(f"{path}/benchmark.parquet")).collect()
    want = sorted((str(r[0]), i, round(c, 9)) for r in short for i, t in items if (c := brute_coverage(r[1], t)) >= 0.8)
    assert want and sorted((str(r["doc_id"]), r["item_id"], round(r["coverage"], 9)) for r in pairs) == want


def test_stages_and_run(spark, tables):
    path, docs, labels, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    state = [r for r, (surprise, threshold) in zip(docs, brute_quality(docs, labels), strict=True) if surprise <= threshold]
    brute = {
        "quality": lambda rows: state,
        "near_duplicates": brute_near_duplicates,
        "decontamination": lambda rows: [r for r in rows if max(brute_coverage(r[1] if r[1] is None or len(r[1]) < 20_000 else r[1][:2000], t) for _, t in items) < 0.8],
        "mixing": brute_mix,
        "sharding": lambda rows: brute_shards(rows, 8),
    }
    rows, sizes = docs, [len(docs)]
    for name, stage in corpus_pipeline.STAGES:
        rows = brute[name](rows)
        frame = stage(spark, frame, path)
        assert name == "sharding" or frame.columns == COLUMNS
        got = [tuple(r) for r in frame.collect()]
        assert text_rows(got) == text_rows(rows), name
        sizes.append(len(rows))
        frame = spark.createDataFrame(got, frame.schema)
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]
    assert text_rows(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == text_rows(rows)


def test_empty_documents(spark, tables, tmp_path):
    path = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where(F.lit(name != "documents")).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
