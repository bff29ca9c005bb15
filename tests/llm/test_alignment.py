import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import alignment

DOCS = "doc_id long, text string, key string, M string, pairs string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_BPE}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECE_BPE}")


def brute(tokenizers, rows):
    """Whole texts, one after the other, with all pairs of overlapping byte ranges."""
    a, b = tokenizers
    to_byte = alignment.byte_level()
    assert len(to_byte) == len(set(to_byte.values())) == 256
    work = []
    for doc_id, text, *_ in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        tokens = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(t) != b" " + text.encode() for t in tokens):
            work.append((doc_id, [], [], [], ""))
            continue
        spans = []
        for own, t in zip(ids, tokens, strict=True):
            at, s = 0, []
            for i, x in zip(own, t, strict=True):
                s.append((at, at + len(x), i))
                at += len(x)
            spans.append(s)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(text) < 3000 else None
        if links is None:
            at, links = 0, []
            for x in spans[0]:
                while spans[1][at][1] <= x[0]:
                    at += 1
                k = at
                while k < len(spans[1]) and spans[1][k][0] < x[1]:
                    links.append((x[2], spans[1][k][2]))
                    k += 1
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(x[2]) for x in s if low <= x[0] and x[1] <= end) for s in spans) if len(text) < 3000 else "")
            low = end
        work.append((doc_id, ids[0], ids[1], links, ends, ";".join(groups) if len(text) < 3000 else None))
    counts = Counter(x for w in work for x in w[3])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for w in work:
        best = sum(counts[x] == most[x[1]] for x in w[3])
        digest = "" if not w[3] else w[5] and hashlib.sha256(w[5].encode()).hexdigest()
        out.append((w[0], len(w[1]), len(w[2]), len(w[4]), len(w[3]), best, sum(counts[x] for x in w[3]), digest))
    return out


TEXTS = [
    "The quick brown fox", "  two  spaces  ", " ", "\n", "a\n b\n\n  c ", "tabs\t\tand  no-break", "don't 'tis I'll", "12345 67,890.12", "<|endoftext|> and <s> </s> <0x41>", "▁under ▁▁ x", "naïve été ça",
    "你好 世界", "\U0001f600 emoji\U0001f468‍\U0001f469", "zero​width   line", "x" * 700, "\x00\x01 \x7f", "ﬁ Ａ́", "end.", " start", "é ́ combining", "a 　 b", "\x1c \x85 c", "tail ", "ab" * 50 + " " * 30 + "c",
]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_against_whole_texts(spark, tokenizers, frequent):
    rng = random.Random(5)
    words = ["the", "of", "Straße", "thndanon", "ing,", "re-run", "▁", "", "\n", "3.14", "it's", " ", "à", "X" * 9]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "k", None, None) for i in range(60)]
    rows += [(100 + i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(200, None, None, None, None), (201, "", None, None, None), (None, "null id", None, None, None)]
    rows += [(300 + i, "a copied text of some words", None, None, None) for i in range(25)] + [rows[0]] * 2
    found = alignment.align_documents(spark.createDataFrame(rows, DOCS), frequent=frequent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(tokenizers, rows), key=str)


def test_long_texts_and_forgetting(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    monkeypatch.setattr(alignment, "SLICE", 500)
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n)), None, None, None) for i, n in enumerate([8000, 3, 50, 50, 1, 2000])]
    found = {r[0]: tuple(r) for r in alignment.align_documents(spark.createDataFrame(rows, DOCS)).collect()}
    for want in brute(tokenizers, rows):
        assert found[want[0]][:7] == want[:7] and want[7] in (None, found[want[0]][7])


def test_whole_documents_of_a_table(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, alignment.align_documents(docs).collect())) == sorted(brute(tokenizers, rows))


def test_nothing(spark):
    assert alignment.align_documents(spark.createDataFrame([], DOCS)).count() == 0
