import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import crf, ctw, kneser_ney, sharding, simhash, tiling, warc
from veilspark.llm.common import held_out
from veilspark.llm.decision_list import quality_rules
from veilspark.llm.pareto import pareto_mix
from veilspark.llm.sanitise import base_spans, disclosure, find_private, sanitise_text, span_text

SCHEMA = "doc_id long, text string, lang string, source string, _row string, SIZE string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["the", "of", "tree", "house", "river", "run", "walks", "green", "stone", "light"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + (" idiot" if i % 7 == 0 else ""), "en", f"s{i % 3}", "x", "y") for i in range(80)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "s0", None, "z"), (102, " \n\t ", "de", None, "a", "b"), (None, "mail a.b@c.org now", "en", "s1", None, None), (103, "word " * 30_000, "en", "s2", None, None)]
    rows += [rows[3]] * 3 + [(i, rows[5][1], "en", "s0", None, None) for i in range(200, 210)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None), (100, 1, 0)], LABELS)


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 8).collect()
    assert len(rows) == docs.count()
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by_text = {}
    for r in rows:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())
    assert sharding.shard_documents(empty(spark, docs)).count() == 0


@pytest.mark.parametrize("sizes", [[5, 1, 1, 1, 9, 2, 2], [1] * 40, [100, 1, 1], [3], [7, 7, 7, 50, 7, 7, 7, 1, 1, 1, 1, 1]])
def test_smallest_capacity(spark, sizes):
    ends = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame(list(zip(ends, sizes, strict=True)), "g_end long, g_size long")
    capacity, cuts = sharding.minimax_cuts(groups, 3, buckets=2)

    def shards(c):
        n, held = 1, 0
        for x in sizes:
            if x > c:
                return 99
            n, held = (n, held + x) if held + x <= c else (n + 1, x)
        return n

    assert capacity == next(c for c in range(1, sum(sizes) + 1) if shards(c) <= 3)
    edges = [0, *cuts, sum(sizes)]
    assert all(c in [0, *ends] for c in cuts) and max(b - a for a, b in zip(edges, edges[1:], strict=False)) <= capacity


def test_mixing(spark, docs):
    sized = docs.drop("SIZE").withColumn("size", F.size(F.split(F.coalesce("text", F.lit("")), " ")))
    rows = pareto_mix(sized).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, pareto_mix(sized).collect()))
    assert pareto_mix(empty(spark, sized)).count() == 0


def test_mixing_prefers_long_texts(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 3}", rng.choice([3, 40, 500]), "x", "y") for i in range(900)] + [(i, "s1", 7, None, None) for i in range(50)] + [(None, None, None, None, None)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long, _plan string, _source string")
    got = pareto_mix(sized).collect()
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1000 and all(r["taken"] <= 3 * r["size"] for r in own)
        mean = [np.mean([r["copies"] for r in own if r["size"] == n]) for n in (3, 40, 500)]
        assert mean[0] <= mean[1] <= mean[2] and (own[0]["target"] == 3 * own[0]["source_size"] or mean[0] < mean[2])
        # Within the documents of one size the lowest ranks are taken.
        for n in (3, 40, 500):
            ranked = sorted((r["pareto_rank"], r["copies"]) for r in own if r["size"] == n and r["pareto_rank"] is not None)
            assert [c for _, c in ranked] == sorted((c for _, c in ranked), reverse=True)


def test_simhash_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(30)} | {0, 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    for tile in (4096, 8):
        edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "id long, f0 long"), 3, 1, tile)
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        label = {x: x for x in signed}
        changed = True
        while changed:
            changed = False
            for i, a in enumerate(signed):
                for b in signed[i + 1 :]:
                    if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and label[a] != label[b]:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        assert {x: roots.get(x, x) for x in signed} == label


def test_near_duplicates(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (100, 101, 102)} == {100}
    assert all(r["component_id"] == 5 for r in rows if r["doc_id"] is not None and 200 <= r["doc_id"] < 210)
    assert simhash.near_duplicates(empty(spark, docs)).count() == 0
    assert simhash.fingerprint(simhash.words_of(b"A b")).tolist() == simhash.fingerprint([b"a", b"b"]).tolist()


def test_wide_fingerprints(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(300)] for _ in range(60)]
    for i, words in enumerate(base):
        rows.append((i, " ".join(words), "a", 1))
        near = list(words)
        for _ in range(4):  # 4 edits of 300 words: a similarity of about 0.87
            near[rng.randrange(300)] = "edited"
        rows.append((1000 + i, " ".join(near), "b", None))
    d = spark.createDataFrame(rows, "doc_id long, text string, _row string, _best int")
    for tile in (4096, 16):
        prints = simhash.fingerprints(d, size=5, lanes=4).withColumnRenamed("doc_id", "id")
        pairs = {(r["a"], r["b"]) for r in simhash.links(prints, 44, 4, tile).collect()}
        assert all(b - a == 1000 for a, b in pairs) and len(pairs) >= 57
    kept = simhash.one_of_each_group(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} >= set(range(60)) and kept.count() <= 63


def test_tiling(spark, docs):
    item = [f"w{i}" for i in range(20)]
    texts = [(1, "x " + " ".join(item) + " y"), (2, " ".join(item[10:] + ["z"] + item[:10])), (3, " ".join(item[:10])), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.contaminated(d, bench).collect()) == [(1, 7, 1.0), (2, 7, 1.0)]
    assert sorted(r["doc_id"] for r in tiling.clean_documents(d.withColumn("_row", F.lit(1)), bench).collect()) == [3, 4, 5]
    assert tiling.contaminated(docs, empty(spark, bench)).count() == 0 and tiling.contaminated(empty(spark, d), bench).count() == 0


def test_tiles_of_repeats(spark):
    rng, known = random.Random(1), {}
    for _ in range(200):
        a, b = ([bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(3, n))] for n in (30, 40))
        used_a, used_b, want = set(), set(), []
        while True:
            found = []
            for i in range(len(a)):
                for d in range(len(b)):
                    n = 0
                    while i + n < len(a) and d + n < len(b) and a[i + n] == b[d + n] and i + n not in used_a and d + n not in used_b:
                        n += 1
                    if n >= 3:
                        found.append((-n, i, d))
            if not found:
                break
            n, i, d = min(found)
            used_a.update(range(i, i - n))
            used_b.update(range(d, d - n))
            want.append((i, d, -n))
        assert tiling.tiles(tiling.word_ids(a, known), tiling.word_ids(b, known), np.arange(len(b)), 3) == want
    repeats = "ha " * 40_000
    bench = spark.createDataFrame([(1, "ha " * 4000), (2, "one")], "item_id long, text string")
    d = spark.createDataFrame([(1, repeats, "x"), (1, repeats, "x"), (None, "one two", "y"), (3, None, None)], "doc_id long, text string, _doc string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in tiling.contaminated(d, bench).collect()) == [("1", 1), ("1", 1), ("None", 2)]


def test_common_seeds_lose_no_pair(spark, monkeypatch):
    """Items that share a preamble, documents that bring most of one, pieces of many, or the preamble alone: as by all pairs."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(12)]
    items = [common + [rng.choice(words) for _ in range(rng.randint(4, 60))] for _ in range(40)] + [common, common[:5], ["one", "two"]]
    docs = []
    for _ in range(120):
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = "changed"
        cut = rng.randrange(len(own))
        docs.append(own[cut:] + ["between"] + own[:cut] + rng.choice(items)[: rng.randint(0, 30)])
    docs.append(common)
    want = set()
    for d, own in enumerate(docs):
        for i, item in enumerate(items):
            known = {}
            x, y = tiling.word_ids([w.encode() for w in item], known), tiling.word_ids([w.encode() for w in own], known)
            if sum(t[2] for t in tiling.tiles(x, y, np.arange(len(y)), min(5, len(x)))) / len(x) >= 0.8:
                want.add((d, i))
    table = lambda rows, name: spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], f"{name} long, text string")
    for many in (0, 5, 1000):
        monkeypatch.setattr(tiling, "COMMON", many)
        got = tiling.contaminated(table(docs, "doc_id"), table(items, "item_id")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_long_tiles_in_time():
    """A text of 20,000 words against one with each sixth word changed."""
    a = np.random.default_rng(1).integers(1, 2**60, 20_000).astype(np.uint64)
    b = a.copy()
    b[5::6] += np.uint64(1)
    begin = time.time()
    assert tiling.tiles(a, b, np.arange(len(b)), 5) == [(i, i, 5) for i in range(0, 19_998, 6)] and time.time() - begin < 1


def test_warc_salvage(spark, tmp_path):
    page = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a b", page), (2, None, page), (3, "u", None), (4, "u", "é"), (None, "u", page)], "page_id long, url string, html string")
    plan = warc.dedup_plan(pages).coalesce(1)
    for compress in (True, False):
        path = f"{tmp_path}/{compress}"
        warc.write_warc(plan, path, compress)
        rows = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
        assert all(r["kind"] == "record" for r in rows.values()) and len(rows) == 5
        assert rows["urn:page:1"]["record_type"] == "revisit" and rows["urn:page:1"]["refers_to"] == "urn:page:2" and rows["urn:page:1"]["payload_bytes"] == 2003
        assert bytes(rows["urn:page:4"]["payload"]).decode() == "é" and rows["urn:page:3"]["payload_bytes"] == 0
    records = [warc.record_bytes("response", f"r{i}", "u", b"body %d WARC/1.0 no record" % i, hashlib.sha1(b"body %d WARC/1.0 no record" % i).hexdigest(), None) for i in range(4)]
    for pack in (lambda r: r, warc.gzip_member):
        parts = [pack(r) for r in records]
        parts[1] = parts[1][:40] + b"\x00\x01" + parts[1][42:]
        found = list(warc.salvage(b"junk" + b"".join(parts)))
        assert [x.get("record_id") for x in found if x["kind"] == "record"] == ["r0", "r2", "r3"]
        gaps = [(x["offset"], x["length"]) for x in found if x["kind"] == "gap"]
        assert gaps == [(0, 4), (4 + len(parts[0]), len(parts[1]))]
    assert warc.dedup_plan(empty(spark, pages)).count() == 0
    # A member of three records, the second damaged; the whole broken off; a member that inflates too far.
    inside = records[0] + records[1][:60] + b"#" + records[1][61:] + records[2]
    got = list(warc.salvage(warc.gzip_member(inside)))
    assert [x.get("record_id") for x in got if x["kind"] == "record"] == ["r0", "r2"] and [(x["inner_offset"], x["inner_length"]) for x in got if x["kind"] == "gap"] == [(len(records[0]), len(records[1]))]
    assert [x["gaps_before"] for x in got if x["kind"] == "record"] == [0, 1]
    noise = warc.record_bytes("response", "n", "u", random.Random(1).randbytes(60_000), hashlib.sha1(random.Random(1).randbytes(60_000)).hexdigest(), None)
    cut = warc.gzip_member(records[0] + noise)[:-20_000] + warc.gzip_member(records[3])
    got = list(warc.salvage(cut))
    assert [x.get("record_id") for x in got if x["kind"] == "record"] == ["r0", "r3"] and [x["reason"] for x in got if x["kind"] == "gap"]
    # A record that is too long is lost alone; those before and behind it in its member stay.
    got = list(warc.salvage(warc.gzip_member(records[0] + noise + records[1] + records[2]), most_record=20_000))
    assert [x.get("record_id") for x in got if x["kind"] == "record"] == ["r0", "r1", "r2"] and [(x["inner_offset"], x["inner_length"]) for x in got if x["kind"] == "gap"] == [(len(records[0]), len(noise))]


@pytest.mark.parametrize("held", [1 << 24, 1000])
def test_members_of_any_size(monkeypatch, held):
    """A whole file as one member, read record by record: with a damaged record, a claimed length that isn't there, junk, and a break at its end."""
    monkeypatch.setattr(warc, "HELD", held)
    rng = random.Random(9)
    body = lambda i: rng.randbytes(rng.choice([0, 10, 3000, 400_000])) + b"WARC/1.0 %d" % i
    records = [warc.record_bytes("response", f"r{i}", "u", b := body(i), hashlib.sha1(b).hexdigest(), None) for i in range(60)]
    broken = {7, 8, 30, 59}
    parts = [r[:-9] + bytes([r[-9] ^ 1]) + r[-8:] if i in broken else r for i, r in enumerate(records)]
    parts[20] = parts[20].replace(b"Content-Length: ", b"Content-Length: 9999999")
    whole = b"".join(parts) + b"junk" * 5
    got = list(warc.salvage(b"xx" + warc.gzip_member(whole) + records[0]))
    assert [x["record_id"] for x in got if x["kind"] == "record"] == [f"r{i}" for i in range(60) if i not in broken | {20}] + ["r0"]
    upto = np.cumsum([0, *map(len, parts)])
    assert [(x["inner_offset"], x["inner_length"]) for x in got if x["kind"] == "gap" and x.get("inner_offset") is not None] == [(upto[7], upto[9] - upto[7]), (upto[20], upto[21] - upto[20]), (upto[30], upto[31] - upto[30]), (upto[59], len(whole) - upto[59])]
    cut = list(warc.salvage(warc.gzip_member(b"".join(records))[:-5000] + records[0]))
    kept = [x["record_id"] for x in cut if x["kind"] == "record"]
    assert kept[:-1] == [f"r{i}" for i in range(len(kept) - 1)] and len(kept) > 50 and kept[-1] == "r0" and sum(x["kind"] == "gap" for x in cut) == 1


def test_failures_are_linear():
    begin = time.time()
    got = list(warc.salvage(b"WARC/1.1 no record\n" * 200_000 + b"x" * 1_000_000))
    assert len(got) == 1 and time.time() - begin < 10


def test_warc_tables(spark, tmp_path):
    long = "<p>" + "y" * 3_000_000
    rows = [(1, "u", long, "a"), (1, "u", long, "b"), (2, "u", long, None), (3, "u", None, None), (3, "u", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for p, n in ((pages, 5), (empty(spark, pages), 0)):
        warc.write_warc(warc.dedup_plan(p), f"{tmp_path}/{n}", file_bytes=100)
        got = warc.read_warc(spark, f"{tmp_path}/{n}", payloads=False).collect()
        assert sorted((r["record_id"], r["record_type"], r["payload_bytes"]) for r in got) == sorted((f"urn:page:{i}", "revisit" if i == 1 else "response", 0 if t is None else len(t)) for i, _, t, _ in rows[:n])


def _tree_bits(cells, context, byte):
    """Eight binary choices of a byte after its context, in the weighted tree of cells: plain recursion over all nodes."""

    def counts(suffix, node):
        return [sum(n for (c, b), n in cells.items() if c[len(c) - len(suffix) :] == suffix and (256 + b) >> (8 - node.bit_length() + 1) == node and (b >> (8 - node.bit_length()) & 1) == bit) for bit in (0, 1)]

    def log_kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(suffix, node):
        n0, n1 = counts(suffix, node)
        own = log_kt(n0, n1)
        if len(suffix) == ctw.DEPTH:
            return own, 1.0
        children = {c[len(c) - len(suffix) - 1 :] for c, _ in cells if c[len(c) - len(suffix) :] == suffix}
        below = sum(weighted(c, node)[0] for c in children)
        total = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
        return total, math.exp(own - math.log(2) - total)

    out = 0.0
    for j in range(8):
        node, bit, share, rest, end = (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1, 0.0, 1.0, 0.5
        for d in range(ctw.DEPTH + 1):
            n0, n1 = counts(context[len(context) - d :], node)
            if d and n0 + n1 == 0:
                break
            kt, beta = (n1 + 0.5) / (n0 + n1 + 1), weighted(context[len(context) - d :], node)[1]
            end = share + rest * kt
            share, rest = share + rest * beta * kt, rest * (1 - beta)
        out += math.log10(end if bit else 1 - end)
    return out


def test_tree_against_recursion(spark):
    words = [("en", b"aba", 5), ("en", b"ab", 3), ("en", b"b", 1), ("de", b"aba", 2), ("de", b"caa", 0), ("", "é".encode(), 1)]
    table = spark.createDataFrame(words, "lang string, w binary, n long").withColumn("k", F.monotonically_increasing_id())
    cells = Counter()
    coded = {}
    for g, w, n in words:
        row = ctw.before_word(g) + w + ctw.MARK
        coded[g, w] = [(row[i - ctw.DEPTH : i], row[i]) for i in range(ctw.DEPTH, len(row))]
        for c in coded[g, w]:
            cells[c] += n
    read = ctw.weigh(ctw.count_cells(table))
    for most in (1 << 20, 0):
        got = {(r["lang"], bytes(r["w"])): r["lp"] for r in table.join(ctw.score_words(table, read, most), "k").collect()}
        for g, w, _ in words:
            want = sum(_tree_bits(cells, c, b) for c, b in coded[g, w])
            assert abs(got[g, w] - want) < 1e-8 * abs(want)


def test_scores_stand_alone(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "tree", "of", "stone"]) for _ in range(rng.randrange(400))) + "\n\n  x" * (i % 3), "en" if i % 2 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, parts = ({r["doc_id"]: r["score"] for r in ctw.score_texts(x, F.col("doc_id") % 7 == 2, frequent=n, most_sent=m).collect()} for x, n, m in ((d.coalesce(1), 1 << 19, 1 << 22), (d.repartition(5, "doc_id"), 2, 0)))
    assert all(abs(whole[i] - parts[i]) <= 1e-9 * abs(whole[i]) for i in whole)


def test_score_against_recursion(spark):
    """The whole score of each text: its language by byte pairs, its words in the tree, its white space, and shares that add up to 1."""
    texts = {"en": ["the tree of the river", "the  house\nof the tree", "a river"], "de": ["der baum am fluss", "das haus und der baum", "\tder fluss "], "fr": ["la maison", "une riviere la bas"]}
    rows = [(10 * i + j, t, g) for i, (g, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    held = [(100, "the baum of la maison", "de"), (101, "", "xx"), (102, None, None), (103, "fluss fluss unknownword", "en")]
    frame = spark.createDataFrame(rows + held, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in ctw.score_texts(frame, F.col("doc_id") >= 100).collect()}
    pairs = {g: Counter(p for t in own for p in zip(b"\xff" + t.encode(), t.encode() + b"\xff", strict=True)) for g, own in texts.items()}
    order = sorted(texts, key=lambda g: (-len(texts[g]), g))

    def language(text):
        data = text.lower().encode()
        score = {g: sum(round(1000 * math.log2((pairs[g][p] + 1) / (sum(pairs[g].values()) + 65536))) for p in zip(b"\xff" + data, data + b"\xff", strict=True)) + round(1000 * math.log2((len(texts[g]) + 0.5) / (len(rows) + 1.5))) for g in order}
        return max(order, key=lambda g: score[g])

    cells, spaces, share = Counter(), np.zeros(64), Counter()

    def coded(word, g):
        row = ctw.before_word(g) + word + ctw.MARK
        return [(row[i - ctw.DEPTH : i], row[i]) for i in range(ctw.DEPTH, len(row))]

    for _, t, _ in rows:
        share[language(t)] += 1
        for w in t.lower().encode().split():
            for c in coded(w, language(t)):
                cells[c] += 1
        spaces += np.bincount(ctw._gaps([t.lower().encode()])[0], minlength=64)
    gaps = ctw.gap_model(spaces)
    for i, t, _ in rows + held:
        data = (t or "").lower().encode()
        g = language(t or "")
        want = sum(_tree_bits(cells, *c) for w in data.split() for c in coded(w, g)) + gaps[ctw._gaps([data])[0]].sum() + math.log10((share[g] + 0.5) / (len(rows) + 1.5))
        assert abs(got[i] - want) < 1e-7 * abs(want), (i, got[i], want)


def test_context_tree(spark, docs):
    rows = ctw.score_texts(docs, held_out(F.col("doc_id"), 7, 2)).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (100, 101, 102)} == {1}
    train = [(r["text"] or "").lower().split() for r in docs.where(~held_out(F.col("doc_id"), 7, 2)).collect()]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()) + len(train), len(c) + 1
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        base = sum(np.log10((c[w] + 1) / (total + distinct + 1)) for w in text[r["doc_id"]].lower().split()) + np.log10((len(train) + 1) / (total + distinct + 1))
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["train_tokens"] == total
    assert ctw.score_texts(empty(spark, docs), held_out(F.col("doc_id"), 7, 2)).count() == 0


def test_kneser_ney(spark, docs, labels):
    rows = kneser_ney.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert kneser_ney.quality(docs, empty(spark, labels)).where("kept").count() == docs.count()
    assert kneser_ney.quality(empty(spark, docs), labels).count() == 0
    model, _ = kneser_ney.train(docs.where("doc_id < 40").select(F.col("text").cast("binary").alias("text")))
    a, b = (kneser_ney.surprise(model, [t])[0][0] for t in (b"the tree of the river", b"zzz qqq xxx yyy vvv"))
    assert a < b
    clash = docs.withColumnsRenamed({"_row": "_scored", "SIZE": "Bits"})
    assert kneser_ney.kept_documents(clash, labels).columns == clash.columns


def test_thresholds_cover_all_trusted(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "tree", "river", "stone"]) for _ in range(rng.randrange(5, 60))), "de" if i % 4 else "en") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    got = kneser_ney.quality(d, good, sample=60).collect()
    fit = {r["doc_id"] for r in kneser_ney.fit_sample(kneser_ney.trusted(good), 60).collect()}
    assert len(fit) == 60
    for lang in ("de", "en"):
        own = [r for r in got if r["lang"] == lang]
        want = np.quantile([r["surprise"] for r in own if r["doc_id"] not in fit], 0.995)
        assert {round(r["threshold"], 6) for r in own} == {round(want, 6)}


def test_exact_quantiles(spark):
    rng = random.Random(6)
    rows = [("a", rng.gauss(5, 2)) for _ in range(999)] + [("b", 3.25)] * 300 + [(None, float(i)) for i in range(7)] + [("c", 1.5)]
    for q in (0.5, 0.995, 1.0):
        got = {r["lang"]: r["t"] for r in kneser_ney.exact_quantiles(spark.createDataFrame(rows, "lang string, h double"), q).collect()}
        assert got.keys() == {"a", "b", "c", None} and all(abs(t - np.quantile([h for x, h in rows if x == g], q)) < 1e-9 for g, t in got.items())


def test_toxicity(spark, docs, labels):
    rows = {r["doc_id"]: r for r in crf.toxicity(docs, labels, ~held_out(F.col("doc_id"), 3, 1)).collect()}
    assert all(rows[i]["predicted"] == int(i % 7 == 0) for i in range(80))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[7][s["start"] : s["end"]] == "idiot" for s in rows[7]["spans"]) and rows[7]["spans"]
    assert crf.toxicity(docs.withColumn("_scored", F.lit(1)), empty(spark, labels), F.lit(True)).where("score > 0").count() == 0
    assert crf.toxicity(empty(spark, docs), labels, F.lit(True)).count() == 0


def test_toxicity_score_against_recursion(spark, docs, labels):
    """Every score and span from the model's weights by a plain recursion over words."""
    usable = ~held_out(F.col("doc_id"), 3, 1)
    weights, trans, w = crf.train(docs.select("doc_id", "text"), labels, usable)
    for r in crf.toxicity(docs, labels, usable).collect():
        known = crf.Words()
        words = known(crf.words_of((r["text"] or "").encode()))
        places = known.places
        emit = [weights[places[x, :4]].sum() + (weights[places[words[t - 1], 4]] if t else 0) + (weights[places[words[t + 1], 5]] if t + 1 < len(words) else 0) for t, x in enumerate(words)]
        n, a, b = len(emit), [], [(0.0, 0.0)]
        for t, e in enumerate(emit):
            a.append((0.0, e) if t == 0 else tuple(x + np.logaddexp(a[-1][0] + trans[0][k], a[-1][1] + trans[1][k]) for k, x in enumerate((0.0, e))))
        for e in reversed(emit[1:]):
            b.insert(0, tuple(np.logaddexp(trans[k][0] + b[0][0], trans[k][1] + e + b[0][1]) for k in (0, 1)))
        p = [1 / (1 + np.exp(x[0] + y[0] - x[1] - y[1])) for x, y in zip(a, b, strict=False)]
        most, many = max(p, default=0.0), sum(x for x in p if x >= 0.5)
        cut = min(1 - crf.LEAST, max(crf.LEAST, most))
        want = 1 / (1 + np.exp(-(w[0] + w[1] * np.log(cut / (1 - cut)) + w[2] * np.log1p(many))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(want >= 0.7) and len(r["spans"]) == sum(x >= 0.5 for x in p[:n])


def test_thinned_stretches_keep_their_weight(spark):
    """Clean stretches that are passed over are made up for by those that are learned from."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choice("abcdefghij") * 3 for _ in range(32 * 20)), 0) for _ in range(100)] + [("idiot you " * 8, 1)] * 3
    sample = spark.createDataFrame(rows, "text string, y int").select(F.col("text").cast("binary").alias("text"), "y")
    whole = 100 * 20
    for most in (10_000, 150):
        _, tags, weight = crf.segments(sample, {b"idiot"}, most)
        assert abs(weight[~tags.any(axis=1)].sum() - whole) < 0.25 * whole and weight[tags.any(axis=1)].sum() == 3 and len(weight) <= most


def test_marginals_of_long_chains():
    rng = np.random.default_rng(0)
    trans, texts = rng.normal(size=(2, 2)), [rng.normal(size=n) for n in (1, 30, 0, 1500, 513)]
    for emit, p in zip(texts, crf.marginals(texts, trans), strict=True):
        a, b, n = np.zeros((len(emit), 2)), np.zeros((len(emit), 2)), len(emit)
        for t in range(n):
            a[t] = np.array([0, emit[t]]) + (0 if t == 0 else np.logaddexp(a[t - 1][0] + trans[0], a[t - 1][1] + trans[1]))
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp(trans[:, 0] + b[t + 1][0], trans[:, 1] + emit[t + 1] + b[t + 1][1])
        want = 1 / (1 + np.exp((a + b)[:, 0] - (a + b)[:, 1]))
        assert len(p) == n and np.allclose(p, want, atol=1e-9)


def test_quality_rules(spark, docs, labels):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality_rules(docs, labels).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]])
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, covered = Counter(runs), set()
        for i, x in enumerate(runs):
            if n[x] > 1:
                covered.update(range(i, i + 8))
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["kept"] is False or not r["base_failed"]
    assert quality_rules(empty(spark, docs), labels).count() == 0 and quality_rules(docs, empty(spark, labels)).count() == docs.count()


def test_sanitise(spark, docs):
    text = "Mail x@y.zz_w@q.r or 10.0.0.300, 1.2.3.4.5.6.7.8; card 4111 1111 1111 1111 é +1 (555) 123-4567."
    near = [(i, f"agent zorro x{i}@mail.org spoke of many plain things and went home") for i in range(12)] + [(50 + i, "plain things and went home of many spoke") for i in range(60)]
    d = spark.createDataFrame([(1, text), (2, None), (3, "")] + [(10 + i, t) for i, t in near], "doc_id long, text string")
    found = find_private(d)
    rows = {r["doc_id"]: r["t"] for r in found.select("doc_id", span_text(F.col("spans"), 3).alias("t")).collect()}
    named = [f"{k}:{text.index(v)}:{text.index(v) + len(v)}" for k, v in (("email", "x@y.zz"), ("email", "_w@q.r"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"))]
    assert rows[1] == ",".join(named)
    assert rows[2] == rows[3] == ""
    clean = d.join(found, "doc_id").select("doc_id", sanitise_text(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).where("doc_id = 15").first()["t"]
    assert "[EMAIL]" in clean and "zorro" not in clean and "plain" in clean
    assert find_private(empty(spark, d)).count() == 0


def test_disclosure_against_counting(spark):
    rng = random.Random(4)
    names, rows = ["zorro", "batman", "dana"], []
    for i in range(120):
        n = rng.randrange(5)
        words = [rng.choice(["plain", "things", "home", "went"]) for _ in range(12)]
        if n < 3:
            words += [names[n]] * (rng.random() < 0.8) + [f"{n}.{n}.1.1"] + ["extra"] * (rng.random() < 0.2)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [rows[0]] * 30  # copies of one text reveal nothing of themselves
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = d.select(F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_t"), base_spans(F.col("text")).alias("spans"))
    got = {(r["value"], r["term"]): (r["docs_with"], r["docs_of"], r["docs_entity"], round(r["disclosure"], 9)) for r in disclosure(found, 5).collect()}
    entity = lambda t: {w for w in t.split() if w[0].isdigit()} | ({None} if any(w[0].isdigit() for w in t.split()) else set())
    want = {}
    for v in {e for _, t in rows for e in entity(t)}:
        for term in {w for _, t in rows for w in t.split() if not w[0].isdigit()}:
            both = [t for _, t in rows if v in entity(t) and term in t.split()]
            of, ent = sum(term in t.split() for _, t in rows), sum(v in entity(t) for _, t in rows)
            if len(set(both)) >= 5 and (x := math.log2(len(both) / of / (ent / len(rows))) / -math.log2(ent / len(rows))) >= 0:
                want[v, term] = (len(both), of, ent, round(x, 9))
    assert want and got == want


def test_sanitise_whole_texts(spark):
    rows = [(i, "Zorro\n" + "plain things and went home " * 4 + f"x{i}@mail.org") for i in range(12)] + [(50 + i, "plain things and went home") for i in range(60)] + [(200, "home of Zorro and zorro")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4] for r in find_private(d).collect()}
    assert all(terms[i] == [(0, 5)] for i in range(12)) and terms[200] == [(8, 13), (18, 23)] and not any(terms[50 + i] for i in range(60))
