"""Token tables coded by chunks: every token and id comes back, and sequences are made without collecting tokens."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagflow.operators import coded as cd
from tagflow.operators import crf
from tagflow.operators import vocab as vo
from tagflow.plans import catalog as cat

TAGS = 5
IDS = {"a": 2, "b": 3, "c": 4}


def table(spark, docs=7):
    """Tokens of documents with odd texts: missing features, a gap in the positions, unseen features in dev."""
    rows = []
    for d in range(docs):
        for p in range(1 + 5 * d):
            word = None if (d + p) % 11 == 5 else "abc"[(d + p) % 3]
            rows.append((d, p + (3 if d == 4 and p > 8 else 0), "dev" if d % 5 == 0 else "train", (d * p) % TAGS, word, "zz" if d % 5 == 0 and p % 2 else "b"))
    return rows, spark.createDataFrame(rows, "doc_id long, pos int, split string, tag_id int, x string, y string")


def coded(wide, chunk_rows):
    c = cd.code(wide, ["x", "y"], ["split"], ["tag_id"], fit=F.col("split") == "train", chunk_rows=chunk_rows)
    return vo.feature_encode_coded(c, vo.feature_dict(vo.feature_set(cd.features(c))))


@pytest.mark.parametrize("chunk_rows,spread", [(1, False), (20, False), (1 << 20, False), (8, True)])
def test_every_token_comes_back(spark, chunk_rows, spread):
    rows, wide = table(spark)
    got = coded(wide.repartition(5) if spread else wide.repartition(2, "doc_id").sortWithinPartitions("doc_id", F.desc("pos")), chunk_rows)
    want = [(d, p, s, t, [IDS.get(x, 1), IDS.get(y, 1)]) for d, p, s, t, x, y in rows]
    assert sorted(map(tuple, cd.token_rows(got).select("doc_id", "pos", "split", "tag_id", "fids").collect())) == sorted(want)
    docs = {r.doc_id: (r.split, r.tag_id, r.fids) for r in cd.documents(got).collect()}
    for d in range(7):
        own = sorted(w for w in want if w[0] == d)
        assert docs[d] == (own[0][2], [w[3] for w in own], [i for w in own for i in w[4]])
    assert not got.whole()  # document 4 has a gap


@pytest.mark.parametrize("guard", [1 << 30, 0])
@pytest.mark.parametrize("spread", [False, True])
def test_coded_scores_are_those_of_tokens(spark, guard, spread):
    rows, wide = table(spark)
    wide = wide.where("doc_id <> 4")
    got = coded(wide.repartition(5) if spread else wide.repartition(2, "doc_id").sortWithinPartitions("doc_id", F.desc("pos")), 20)
    draw = np.random.default_rng(1)
    weights = spark.createDataFrame([(i, draw.normal(size=TAGS).tolist()) for i in (1, 2, 4)], "feature_id long, w array<double>").cache()
    params = crf.ChainParams(TAGS, draw.normal(size=(TAGS, TAGS)), draw.normal(size=TAGS), draw.normal(size=TAGS))
    long = cd.token_rows(got)
    score = crf.scorer(weights, TAGS, guard)
    seqs, plain = crf.sequences(got, weights, score), crf.sequences(long, weights, crf.scorer(weights, TAGS))
    assert isinstance(seqs, cd.Sequences) == got.whole()
    ll = [{r.doc_id: r.loglik for r in crf.loglik(s, k, params).collect()} for s, k in ((seqs, score), (plain, crf.scorer(weights, TAGS)))]
    assert ll[0].keys() == ll[1].keys() and all(abs(ll[0][d] - ll[1][d]) < 1e-9 for d in ll[0])
    paths = [sorted((r.doc_id, r.path) for r in crf.decode(s, k, params).collect()) for s, k in ((seqs, score), (plain, crf.scorer(weights, TAGS)))]
    assert paths[0] == paths[1]
    em = [{(r.doc_id, r.pos): r.em for r in crf.emissions(t, weights, TAGS, guard).collect()} for t in (got, long)]
    assert em[0].keys() == em[1].keys() and all(np.allclose(em[0][k], em[1][k], rtol=0, atol=1e-12) for k in em[0])
    sums = [{}, {}]
    for out, s, k in ((sums[0], seqs, score), (sums[1], plain, crf.scorer(weights, TAGS))):
        for r in crf.weight_gradients(crf.gradient_sums(s, k, params), 1.0, TAGS).collect():
            out[r.feature_id] = r.g
    assert sums[0].keys() == sums[1].keys() and all(np.allclose(sums[0][k], sums[1][k], atol=1e-9) for k in sums[0])


@pytest.mark.parametrize("name", ["crf_decode", "crf_loglik"])
def test_sequences_are_not_collected_from_tokens(spark, name):
    """A collected list of a document's tokens is a wide row for each token, in the exchange, in memory and in spills."""
    plan = cat.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "tok#" not in plan


def test_paths_of_many_lengths_take_the_first_of_equals():
    """Scores from few values tie often; the best path is that of the plain recursion."""
    draw = np.random.default_rng(4)
    trans, start, end = draw.integers(0, 2, (TAGS, TAGS)) / 2.0, draw.integers(0, 2, TAGS) / 2.0, draw.integers(0, 2, TAGS) / 2.0
    ems = [draw.integers(0, 2, (n, TAGS)) / 2.0 for n in (1, 30, 2, 2, 7, 300, 1)]
    for em, got in zip(ems, crf.batched_viterbi(ems, trans, start, end)):
        s, back = start + em[0], []
        for e in em[1:]:
            both = s[:, None] + trans
            back.append(both.argmax(axis=0))
            s = both.max(axis=0) + e
        path = [int((s + end).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert list(got) == path[::-1]


def test_sequences_are_not_shuffled_for_their_batch(spark):
    """The batch maximum comes from lengths; a window over a batch's sequences would sort and spill them."""
    plan = cat.QUERIES["batch_pad"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("slots", [None, 2])
def test_padded_to_the_batch_maximum(spark, slots):
    from tagflow.operators.batches import batch_pad
    feats = [[[1, 2], [3, 4], [5, 6]], [[7, 8]], [[9, 9], [9, 9]]]
    rows = [(d, [5] * len(f), f if slots is None else [x for r in f for x in r]) for d, f in enumerate(feats)]
    seqs = spark.createDataFrame(rows, "doc_id long, labels array<int>, feature_ids " + ("array<array<int>>" if slots is None else "array<int>"))
    batches = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 2, 1)], "doc_id long, idx long, batch_id int")
    got = {r.doc_id: r for r in batch_pad(seqs, batches, slots=slots).collect()}
    flat = lambda f: f if slots else [x for r in f for x in r]
    assert [got[d].padded_len for d in range(3)] == [3, 3, 2] and got[1].labels == [5, 29, 29] and got[1].mask == [True, False, False]
    assert flat(got[1].feature_ids) == [7, 8, 0, 0, 0, 0] and flat(got[0].feature_ids) == [1, 2, 3, 4, 5, 6] and got[2].mask == [True, True]


@pytest.mark.parametrize("block", [3, 256])
def test_blocks_of_coded_documents_are_linked_in_their_chunk(spark, block, monkeypatch):
    from tagflow.operators import crf_blocks as cb
    rows, wide = table(spark, 9)
    got = coded(wide.where("doc_id <> 4").repartition(2, "doc_id").sortWithinPartitions("doc_id", F.desc("pos")), 60)
    draw = np.random.default_rng(1)
    weights = spark.createDataFrame([(i, draw.normal(size=TAGS).tolist()) for i in (1, 2, 4)], "feature_id long, w array<double>").cache()
    params = crf.ChainParams(TAGS, draw.normal(size=(TAGS, TAGS)), draw.normal(size=TAGS), draw.normal(size=TAGS))
    long = cd.token_rows(got)
    want = [{r.doc_id: r.loglik for r in cb.loglik(long, weights, params, block).collect()}, sorted(map(tuple, cb.predict(long, weights, params, block).collect()))]
    monkeypatch.setattr(cb, "cut", None)  # no table of blocks, no exchange of their matrices
    ll = {r.doc_id: r.loglik for r in cb.loglik(got, weights, params, block, 0).collect()}
    assert ll.keys() == want[0].keys() and all(abs(ll[d] - want[0][d]) < 1e-9 for d in ll)
    assert sorted(map(tuple, cb.predict(got, weights, params, block, 0).collect())) == want[1]


@pytest.mark.parametrize("trans", ["random", "apart"])
def test_summed_matrices_of_many_blocks_are_those_of_each(trans):
    from tagflow.operators import crf_blocks as cb
    draw = np.random.default_rng(7)
    moves = draw.normal(size=(TAGS, TAGS)) if trans == "random" else np.where(np.eye(TAGS) > 0, 0.0, -30.0)
    start, ems = draw.normal(size=TAGS), [draw.normal(size=(n, TAGS)) for n in (1, 2, 40, 90, 40, 300, 7)]
    first = np.array([True, False, False, True, True, False, False])
    for got, em, f in zip(cb.summed_matrices(ems, moves, start, first), ems, first):
        want = (start + em[0])[None] if f else moves + em[0]
        for e in em[1:]:
            want = cb._lse(want[:, :, None] + moves[None], 1) + e
        assert got.shape == want.shape and np.allclose(got, want, rtol=0, atol=1e-9)


def test_probabilities_meet_their_tags_without_a_join(spark):
    """30 numbers for each token are neither joined with the token table nor made by lambdas."""
    plan = cat.QUERIES["softmax_sparse"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "doc_id#" in plan and not [x for x in plan.splitlines() if "Join" in x and "pos#" in x]


@pytest.mark.parametrize("guard", [1 << 30, 0])
def test_full_batch_training_reads_coded_tokens_where_they_are(spark, guard, monkeypatch):
    from tagflow.operators import training as tr
    rows, wide = table(spark, 9)
    got = coded(wide.where("doc_id <> 4").repartition(2, "doc_id").sortWithinPartitions("doc_id", F.desc("pos")), 60)
    long = cd.token_rows(got)
    more = {"epochs": 2, "lr": 0.3, "batch_size": 1 << 20, "n_tags": TAGS, "guard_bytes": guard, "chain": False}
    want = tr.crf_fit(long.where("split = 'train'"), long.where("split = 'dev'"), **more)
    monkeypatch.setattr(tr, "write_batches", None)  # no copy of the batch, no list of its features
    fit = tr.crf_fit(got.where("split = 'train'"), got.where("split = 'dev'"), **more)
    both = [[(r.epoch, r.loss, r.n_batches, r.val_loss) for r in f.history.orderBy("epoch").collect()] for f in (fit, want)]
    assert np.allclose(both[0], both[1], rtol=0, atol=1e-9)
    a, b = [{(r.doc_id, r.pos): (r.tag_id, r.probs) for r in tr.probabilities(t, f.weights, TAGS, guard, keep=("tag_id",)).collect()} for t, f in ((got, fit), (long, want))]
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], atol=1e-12) for k in a)
