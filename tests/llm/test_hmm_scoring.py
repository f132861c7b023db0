"""The hidden Markov model against sums over all state sequences, and its counts against plain ones."""
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tagflow.llm import hmm_scoring as hmm
from tagflow.llm.common import written

SMALL = "/root/testdata/sf0.001"


def model(states, classes, seed=1):
    draw = np.random.default_rng(seed)
    return hmm.Hmm(draw.dirichlet(np.ones(states)), draw.dirichlet(np.ones(states), states), draw.dirichlet(np.ones(classes), states))


def enumerated(text, m):
    """(likelihood, expected starts, moves, emissions) of one text over all its state sequences."""
    s, k = m.emit.shape
    total, begun, moves, emitted = 0.0, np.zeros(s), np.zeros((s, s)), np.zeros((s, k))
    for path in itertools.product(range(s), repeat=len(text)):
        p = m.start[path[0]] * m.emit[path[0], text[0]]
        for a, b, x in zip(path, path[1:], text[1:]):
            p *= m.move[a, b] * m.emit[b, x]
        total += p
        begun[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for a, x in zip(path, text):
            emitted[a, x] += p
    return total, begun / total, moves / total, emitted / total


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_blocks_give_the_sum_over_all_paths(block):
    m, draw = model(3, 5), np.random.default_rng(2)
    texts = [draw.integers(0, 5, n) for n in (1, 2, 5, 7, 6, 3, 1)]
    want = [enumerated(t, m) for t in texts]
    b = hmm.Blocks(texts, block)
    logs, _ = hmm.forward(b, m, hmm.entries(b, m, hmm.transfers(b, m)), False)
    assert np.allclose(logs, [math.log10(w[0]) for w in want], atol=1e-12)
    got = hmm.expected(texts, m, block)
    assert math.isclose(got[0], sum(math.log10(w[0]) for w in want))
    for i in (1, 2, 3):
        assert np.allclose(got[i], sum(w[i] for w in want), atol=1e-12)


def test_a_long_text_is_scored_as_in_one_block():
    m, text = model(4, 50), np.random.default_rng(3).integers(0, 50, 5000)
    b, c = hmm.Blocks([text], 5000), hmm.Blocks([text, text[:7]], 64)
    one = hmm.forward(b, m, hmm.entries(b, m, hmm.transfers(b, m)), False)[0][0]
    assert math.isclose(one, hmm.forward(c, m, hmm.entries(c, m, hmm.transfers(c, m)), False)[0][0], rel_tol=1e-12)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def plain_counts(rows):
    """(counts of training tokens, held-out flags) with the end under the empty word."""
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    return Counter(w for (_, t), h in zip(rows, out) if not h for w in [*words(t), ""]), out


def check(spark, docs, rows, common=None):
    """Every column of ``score`` against plain Python, given the trained model."""
    counts, out = plain_counts(rows)
    n, v = sum(counts.values()), len(counts)
    table = written(hmm.word_counts(docs), "test-counts")
    assert {r.word: r.c for r in table.collect()} == counts
    known = hmm.vocabulary(table)
    assert (known.tokens, known.words) == (n, v) and all(counts[w] * hmm.COMMON >= n or w == "" for w in known.common)
    coded = hmm.encoded(docs, known)
    m, history = hmm.train(coded, known)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(history, history[1:]))
    place = {w: k for k, w in enumerate(known.common)}
    tail = lambda w: hmm.xxh64_intdigest(w[-2:].encode(), hmm.SEED) % hmm.TAILS
    sums = Counter()
    kinds = Counter()
    for w, c in counts.items():
        if w not in place:
            sums[tail(w)] += c
            kinds[tail(w)] += 1
    got = sorted(map(tuple, hmm.score(docs).collect()), key=repr)
    want = []
    for (i, t), h in zip(rows, out):
        own = [*words(t), ""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        a, log = m.start, 0.0
        for k, w in enumerate(own):
            c = place.get(w, len(known.common) + tail(w))
            a = (a if k == 0 else a @ m.move) * m.emit[:, c]
            log += math.log10(a.sum()) + (0 if w in place else math.log10((counts[w] + 0.5) / (sums[tail(w)] + 0.5 * (kinds[tail(w)] + 1))))
            a = a / a.sum()
        want.append((i, h, len(own), sum(counts[w] > 0 for w in own), n, base, log))
    want.sort(key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6, abs_tol=1e-6)
    return got


def test_scores_are_the_models(spark, documents, rows):
    got = check(spark, documents, list(rows.items()))
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held) + 0.1 * sum(g[2] for g in held)  # better than the base on texts it hasn't seen


def test_edge_cases(spark, edges, nothing):
    check(spark, edges, [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()])
    assert hmm.score(nothing).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, "some words") for i in held], "doc_id long, text string")
    for r in hmm.score(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score < 0


def test_probabilities_of_a_state_add_up_to_one(spark, documents):
    table = written(hmm.word_counts(documents), "test-counts")
    known = hmm.vocabulary(table)
    m = hmm.first_model(known)
    assert np.allclose(m.emit.sum(1), 1) and np.allclose(m.move.sum(1), 1) and m.emit.shape[1] == known.classes
    inside = np.zeros(hmm.TAILS)  # mass that a tail class gives to its known words and to one unknown one
    for r in table.collect():
        if r.word not in known.common:
            k = hmm.xxh64_intdigest(r.word[-2:].encode(), hmm.SEED) % hmm.TAILS
            inside[k] += (r.c + 0.5) / (known.tail_tokens[k] + 0.5 * (known.tail_words[k] + 1))
    assert np.allclose(inside + 0.5 / (known.tail_tokens + 0.5 * (known.tail_words + 1)), 1)
