import random

import numpy as np
import pytest

from veilspark.llm import collisions

VECTORS = "vec_id long, embedding array<float>, label int, own string, V string"


def brute(rows, least=0.9):
    """Links of every row by all pairs, and the smallest id reached."""
    fine = [i for i, (_, v, *_) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n in {len(rows[i][1]) for i in fine}:
        at = [i for i in fine if len(rows[i][1]) == n]
        x = np.array([rows[i][1] for i in at], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least), strict=True):
            if a != b:
                links[at[a]].add(at[b])
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [y for x in todo for y in links[x] if y not in seen and not seen.add(y)]
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        low = min(ids, default=None)
        out.append((vec_id, len(links[i]), low, vec_id == low))
    return sorted(out, key=str)


def table(seed, groups, alone, noise, n=64):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(n) for _ in range(alone)]
    for size in groups:
        centre = rng.standard_normal(n)
        rows += [centre + noise * rng.standard_normal(n) for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in rows]


@pytest.mark.parametrize(("crowded", "block"), [(512, 2048), (12, 10), (4, 7)])
def test_against_all_pairs(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(collisions, "CROWDED", crowded)
    monkeypatch.setattr(collisions, "BLOCK", block)
    vectors = table(crowded, [60, 20, 5, 2, 2, 2], 300, 0.12)
    order = list(range(len(vectors)))
    random.Random(1).shuffle(order)
    rows = [(i, vectors[k], 1, "x", None) for i, k in enumerate(order)]
    rows += [(1000 + i, rows[0][1], 1, None, None) for i in range(40)]  # copies
    rows += [(2000, [2 * x for x in rows[5][1]], 0, None, None), (2001, [1e38, 0.0, 1e38], 0, None, None), (2002, [1e-38, 0.0, 1e-38], 0, None, None), (2003, [0.0] * 64, 0, None, None)]
    rows += [(2004, None, 0, None, None), (2005, [], 0, None, None), (2006, [1.0, None], 0, None, None), (2007, [1.0, float("nan")], 0, None, None), (2008, [float("inf")] * 64, 0, None, None), (None, rows[7][1], 0, None, None)]
    found = collisions.near_vectors(spark.createDataFrame(rows, VECTORS))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(((r[0], r[1], r[2], bool(r[3])) for r in found.collect()), key=str)
    assert got == brute(rows)


def test_recall_at_the_limit(spark):
    """Pairs at the limit, where they are missed most easily."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        x, y = rng.standard_normal(64), rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = 0.9005
        z = c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)
        rows += [(2 * i, x.tolist(), 0, None, None), (2 * i + 1, z.tolist(), 0, None, None)]
    found = collisions.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    links = sum(r["n_links"] for r in found)
    assert links <= sum(r[1] for r in brute(rows))
    assert links / 2 >= 0.98 * 1500
    assert all(r["component_id"] // 2 == r["vec_id"] // 2 for r in found)


def test_nothing(spark):
    assert collisions.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    one = collisions.near_vectors(spark.createDataFrame([(None, [1.0], 1, None, None)], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(None, 0, None, True)]


def test_tables_follow_the_recall():
    for n in (10, 10_000, 10**9):
        bits, tables, window = collisions.calibrate(n, 0.9, 0.99)
        rng = np.random.default_rng(n % 97)
        p = (1 - np.arccos(0.9) / np.pi) ** bits * 0.8664
        assert (rng.binomial(tables, p, 100_000) >= collisions.COUNT).mean() > 0.985 and window < 0.7
