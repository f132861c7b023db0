"""CRF as Spark jobs: partition-count invariance, both weight paths, a falling training loss, the kept best model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.operators import crf
from tagflow.operators import training as tr
from tagflow.plans import catalog as cat
from tagflow.session import scratch
from tagflow.sources.encoded import load_model

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def encoded(spark):
    tokens, fd = cat.encoded_tokens(spark, SF_SMALL)
    path = scratch(spark, "test-tokens")
    tokens.write.parquet(path)
    return spark.read.parquet(path), crf.synthetic_weights(fd)


def lls(tokens, w, guard):
    score = crf.scorer(w, guard_bytes=guard)
    assert (score.matrix is None) == (guard == 0)
    return {r.doc_id: r.loglik for r in crf.loglik(crf.sequences(tokens, w, score), score, crf.synthetic_chain()).collect()}


def test_partitions_and_weight_paths_agree(encoded):
    tokens, w = encoded
    a = lls(tokens.repartition(1), w, 1 << 30)
    for other in (lls(tokens.repartition(8), w, 1 << 30), lls(tokens, w, 0)):
        assert a.keys() == other.keys() and all(abs(a[k] - other[k]) < 1e-6 for k in a)
    some = tokens.where("doc_id < 40")
    p = [crf.predict(some.repartition(n), w, crf.synthetic_chain(), guard) for n, guard in ((1, 1 << 30), (8, 1 << 30), (3, 0))]
    rows = [sorted(map(tuple, x.collect())) for x in p]
    assert rows[0] == rows[1] == rows[2]


def test_path_score_is_the_score_of_the_path(encoded):
    tokens, w = encoded
    score = crf.scorer(w)
    c = crf.synthetic_chain()
    em = {}
    for r in crf.emissions(tokens.where("doc_id < 5"), w).collect():
        em.setdefault(r.doc_id, {})[r.pos] = r.em
    for r in crf.decode(crf.sequences(tokens.where("doc_id < 5"), w, score, labels=None), score, c).collect():
        p = r.path
        s = c.start[p[0]] + c.end[p[-1]] + sum(em[r.doc_id][i][t] for i, t in enumerate(p)) + sum(c.trans[a, b] for a, b in zip(p, p[1:]))
        assert abs(s - r.score) < 1e-6


@pytest.mark.parametrize("guard", [1 << 30, 0])
def test_training_loss_falls_and_the_best_model_is_kept(spark, encoded, guard):
    tokens = encoded[0].where("doc_id < 60")
    best = scratch(spark, "test-best")
    fit = tr.crf_fit(tokens.where("split = 'train'"), tokens.where("split = 'dev'"), epochs=3, lr=0.05, guard_bytes=guard, best_path=best, batch_size=8)
    h = {r.epoch: r.loss for r in fit.history.collect()}
    assert h[2] < h[0] and np.isfinite(fit.params.trans).all() and fit.best_epoch in h
    weights, chain = load_model(spark, best)
    assert weights.count() > 0 and len(chain["trans"]) == 900


def test_one_partition_is_plain_sgd(spark, encoded):
    """One partition and one batch: a single gradient step by either path."""
    tokens = encoded[0].where("doc_id < 30 and split = 'train'").coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        a = tr.crf_fit(tokens, epochs=1, lr=0.1, batch_size=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    b = tr.crf_fit(tokens, epochs=1, lr=0.1, guard_bytes=0)
    assert np.allclose(a.params.trans, b.params.trans) and np.allclose(a.params.start, b.params.start)
    wa = {r.feature_id: r.w for r in a.weights.collect()}
    for r in b.weights.collect():
        assert np.allclose(wa[r.feature_id], r.w)


def test_patience_stops(spark, encoded):
    tokens = encoded[0].where("doc_id < 30")
    fit = tr.crf_fit(tokens.where("split = 'train'"), tokens.where("split = 'dev'"), epochs=6, lr=0.0, patience=2)
    assert fit.stopped and fit.best_epoch == 0 and fit.history.count() == 3


def test_wide_and_long_encoding_agree(spark):
    from tagflow.operators import vocab as vo
    wide = spark.createDataFrame([(1, 0, "a", "b", 7), (1, 1, "b", "zz", 8), (2, 0, "a", "a", 9)], "doc_id long, pos int, x string, y string, tag_id int")
    fd = vo.feature_dict(spark.createDataFrame([("a",), ("b",), ("c",)], "feature string"))
    one = vo.feature_encode_wide(wide, fd, ["x", "y"], ["doc_id", "pos"])
    two = vo.feature_encode_wide(wide, fd, ["x", "y"], ["doc_id", "pos"], guard_bytes=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == [(1, 0, 7, [2, 3]), (1, 1, 8, [3, 1]), (2, 0, 9, [2, 2])]
    assert F.col("x") is not None


@pytest.mark.parametrize("chunk_rows", [1, 3, 1 << 18])
def test_chunks_encode_every_token(spark, chunk_rows):
    """Nulls, features outside the dictionary, chunks of any size; features are shuffled once for a chunk, not for each token."""
    from tagflow.operators import vocab as vo
    rows = [(i // 10, i % 10, None if i == 7 else "abc"[i % 3], "zz" if i % 4 == 0 else "b", i) for i in range(40)]
    wide = spark.createDataFrame(rows, "doc_id long, pos int, x string, y string, tag_id int").repartition(3)
    fd = vo.feature_dict(spark.createDataFrame([("a",), ("b",), ("c",)], "feature string"))
    ids = {"a": 2, "b": 3, "c": 4}
    got = vo.encode_by_chunks(wide, fd, ["x", "y"], chunk_rows)
    assert sorted(map(tuple, got.collect())) == [(d, p, t, [ids.get(x, 1), ids.get(y, 1)]) for d, p, x, y, t in rows]
    chunks = vo.coded_chunks(wide, ["x", "y"], 1 << 18).where("_feature is not null")
    assert chunks.count() <= 3 * 5


def test_blocks_of_sequences_get_the_rows_of_their_features(spark, encoded):
    """Any number of blocks gives the emissions of the broadcast matrix; features without a row score zero."""
    import pandas as pd
    tokens, w = encoded[0].where("doc_id < 20"), encoded[1].where("feature_id % 3 <> 0")
    score = crf.scorer(w, guard_bytes=0)
    assert score.packed and score.matrix is None
    seqs = crf.sequences(tokens, w, score, labels=None)

    def run(frames, rows):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "s": [float(rows(x).sum()) for x in pdf["xs"]]})

    got = [{r.doc_id: r.s for r in crf.with_rows(seqs, w, 30, run, "doc_id long, s double", block_ids=n).collect()} for n in (500, 1 << 30)]
    want = {}
    for r in crf.emissions(tokens, w).collect():
        want[r.doc_id] = want.get(r.doc_id, 0.0) + sum(r.em)
    for one in got:
        assert one.keys() == want.keys() and all(abs(one[k] - want[k]) < 1e-6 for k in want)
    far = {(r.doc_id, r.pos): r.em for r in crf.emissions(tokens, w, guard_bytes=0).collect()}
    assert far == {(r.doc_id, r.pos): r.em for r in crf.emissions(tokens, w).collect()}
