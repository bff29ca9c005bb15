import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from veilspark.llm import trie

TURNS = "conv_id long, turn long, role string, text string, node string, SHARD int"


def brute(turns):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        leaves, saved = 0 if children[k] else 1, (len(members[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0)
        for b in children[k]:
            x, y = below(b)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    rows = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k))))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.mark.parametrize(("shards", "chunk", "depth"), [(1, 1 << 16, 64), (7, 5, 64), (40, 40, 2)])
def test_against_brute_force(spark, monkeypatch, shards, chunk, depth):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "SKELETON_DEPTH", depth)
    rng = random.Random(shards)
    turns = []
    for c in [*range(-30, 200), 10**12]:
        texts = rng.choice([["a b", "c"], ["a b", "d d d", "e"], ["x"], [""], ["a b", "c", "f g h i"]]) if rng.random() < 0.8 else [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]
        # Every third conversation is the same one.
        texts = ["hot turn", "and another", "hot turn"] if c % 3 == 0 else texts
        turns += [(c, i if rng.random() < 0.95 else None, rng.choice(["user", "user", None, ""]), t or None, "x", 1) for i, t in enumerate(texts)]
    turns += [(None, 1, "user", "nobody", None, None), (5, 2, "user", "again", None, None), (5, 2, "user", "again", None, None), (8, 3, "user", "word " * 20_000, None, None)]
    found = trie.conversation_trie(spark.createDataFrame(turns, TURNS), shards=shards)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(turns)


def test_nothing_and_one(spark):
    assert trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = [(21, 0, "user", "a", None, None)]
    assert sorted(map(tuple, trie.conversation_trie(spark.createDataFrame(one, TURNS)).collect()), key=str) == brute(one)


def test_long_conversation(spark):
    turns = [(c, i, "user", f"t {i}", None, None) for c in (1, 2) for i in range(1500)]
    rows = trie.conversation_trie(spark.createDataFrame(turns, TURNS), shards=3).collect()
    # Conversation 1 loses its first turns, as conversation 0 isn't there.
    assert sum(r["depth"] == 0 for r in rows) == 1
    assert max(r["depth"] for r in rows) == 1500 - min(zlib.crc32(b"%d" % c) % 4 for c in (1, 2))
