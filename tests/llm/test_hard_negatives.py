"""Hard negatives against all scores."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.llm import hard_negatives as hard
from tagflow.llm.oracle import ORACLES
from tagflow.llm.queries import op12_hard_negatives

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, is_anchor, positives=5, negatives=5, scale=256):
    """Answers from every score; rows are (id, vector, label)."""
    fine = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, v, y in fine:
        if a is None or not is_anchor(a):
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in fine]
        for p, pid, _ in sorted([s for s in scored if s[2] == y and s[1] != a], key=order)[:positives]:
            fit = sorted([s for s in scored if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p], key=order)[:negatives]
            out += [(a, pid, k + 1, n[1], p, n[0]) for k, n in enumerate(fit)]
    return sorted(out, key=repr)


def mined(df, is_anchor, **more):
    return sorted((tuple(r) for r in hard.mine(df, is_anchor, **more).collect()), key=repr)


def vectors(n, width, labels, seed=1, lumps=0, ties=False):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width)) * 0.2
    if lumps:
        x += draw.normal(size=(lumps, width))[draw.integers(0, lumps, n)]
    if ties:
        x = np.round(x * 4) / 4
    return [(int(i), [float(np.float32(z)) for z in v], int(y)) for i, v, y in zip(range(n), x, draw.integers(0, labels, n))]


@pytest.mark.parametrize("lumps,ties,labels", [(0, False, 3), (6, False, 2), (0, True, 3), (4, True, 5)])
def test_all_scores(spark, lumps, ties, labels):
    rows = vectors(400, 8, labels, lumps=lumps, ties=ties)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert mined(df, lambda i: i % 20 == 0, block_rows=64, anchor_rows=7, sample=100, codewords=4) == brute(rows, lambda i: i % 20 == 0)


def test_blocks_packs_and_codebooks_dont_matter(spark):
    rows = vectors(300, 6, 4, seed=2)
    df = spark.createDataFrame(rows, COLUMNS)
    want = brute(rows, lambda i: i % 10 == 0)
    for more in ({"block_rows": 10_000}, {"block_rows": 17, "codewords": 1}, {"block_rows": 50, "anchor_rows": 1, "sample": 3}):
        assert mined(df, lambda i: i % 10 == 0, **more) == want


def test_bounds_hold_and_the_heap_falls():
    draw = np.random.default_rng(3)
    v = np.floor(draw.normal(size=(200, 10)) * 50)
    books = [v[:8, :5].copy(), v[:8, 5:].copy()]
    code = [hard.nearest(p, b).astype(np.int32) for p, b in zip((v[:, :5], v[:, 5:]), books)]
    row = {"n": 200, "ids": np.arange(200).tobytes(), "known": np.ones(200, bool).tobytes(), "label": np.zeros(200, np.int64).tobytes(),
           "c0": code[0].tobytes(), "c1": code[1].tobytes(), "v": v.tobytes()}
    block, q = hard.Block(row, books), np.floor(draw.normal(size=(20, 10)) * 50)
    halves = block.half_bounds(q)
    for k in range(20):
        seen, before = [], math.inf
        for top, lo, hi in block.visits([h[0][k] for h in halves], [h[1][k] for h in halves]):
            assert top <= before and (block.v[lo:hi] @ q[k] <= top).all()
            before = top
            seen += range(lo, hi)
        assert sorted(seen) == list(range(200))


def test_lumpy_vectors_stop_early():
    """With vectors in clear groups most cells are never visited."""
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(16, 16)) * 100
    v = np.floor(centre[draw.integers(0, 16, 4000)] + draw.normal(size=(4000, 16)))
    books = [np.unique(centre[:, :8], axis=0), np.unique(centre[:, 8:], axis=0)]
    code = [hard.nearest(p, b).astype(np.int32) for p, b in zip((v[:, :8], v[:, 8:]), books)]
    row = {"n": 4000, "ids": np.arange(4000).tobytes(), "known": np.ones(4000, bool).tobytes(), "label": np.zeros(4000, np.int64).tobytes(),
           "c0": code[0].tobytes(), "c1": code[1].tobytes(), "v": v.tobytes()}
    block, scored = hard.Block(row, books), []
    real = block.scores
    block.scores = lambda q, rows, exact: (scored.append(len(rows)), real(q, rows, exact))[1]
    halves = block.half_bounds(v[:1])
    best = hard.Best(5)
    hard.find_positives(block, v[0], -1, 0, ([h[0][0] for h in halves], [h[1][0] for h in halves]), best)
    assert sum(scored) < 2000 and [-r[0] for r in best.rows] == sorted((block.v @ v[0]).astype(int), reverse=True)[:5]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 2, seed=6, ties=True) + [(100, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [1.0, nan, 0.0, 0.0], 1), (400, [inf, 0.0, 0.0, 0.0], 0),
                                                    (500, [0.5, 0.5, 0.5, 0.5], None), (None, [0.5, 0.25, 0.0, 0.0], 0), (600, [1.0, 0.5], 0), (700, [], 1), (5, [0.25] * 4, 1)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], COLUMNS + ", anchor int, block string")
    padded = [(i, v + [0.0] * (4 - len(v)) if v is not None else None, y) for i, v, y in rows]
    assert mined(df, lambda i: i % 5 == 0, block_rows=16) == brute(padded, lambda i: i % 5 == 0)
    assert mined(df.limit(0), lambda i: i % 5 == 0) == []
    assert mined(df.where("vec_id = 5 and label = 1"), lambda i: i % 5 == 0) == []


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(2 ** 21 + i), float(2 ** 20 - i)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df, lambda i: i % 10 == 0, block_rows=8) == brute(rows, lambda i: i % 10 == 0)


def test_query_matches_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    want = con.sql(ORACLES["op12_hard_negatives"])
    got = op12_hard_negatives(spark, "/root/testdata/sf0.1").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
