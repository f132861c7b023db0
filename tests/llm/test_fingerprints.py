import hashlib

import numpy as np
import pytest

from tagflow.llm import fingerprints as f


def test_equal_to_one_text_at_a_time(documents, rows):
    got = {r.doc_id: r for r in f.with_neighbours(documents).collect()}
    ids = sorted(rows)
    assert sorted(got) == ids
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        new = f.edited(rows[i], rows[nxt])
        a, b, c = (f.sketches([t]) for t in (rows[i], new, rows[nxt]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(rows[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f.fingerprint(a[0]), f.fingerprint(b[0]))
        assert r.near_edited == pytest.approx(f.likeness(a, b)[0]) and r.near_next == pytest.approx(f.likeness(a, c)[0])


def test_result_does_not_depend_on_partitions(spark, documents):
    one = sorted(map(tuple, f.with_neighbours(documents).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, f.with_neighbours(documents.repartition(5)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_phrases_of_equal_substrings_have_equal_names(rows):
    text = max(rows.values(), key=len)
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    moved = np.frombuffer(("some other words " + text).encode("utf-32-le"), np.uint32)
    for _ in range(4):
        x, _doc = f.parse(x, np.zeros(len(x), np.int32))
        moved, _doc = f.parse(moved, np.zeros(len(moved), np.int32))
        assert (x[12:-2] == moved[-len(x) + 12:-2]).all()


def test_likeness_follows_the_shared_share(rows):
    texts = [t for t in rows.values() if len(t) > 2000][:40]
    near = f.likeness(f.sketches(texts), f.sketches([f.edited(t, "completely other text, again and again. " * 2000) for t in texts]))
    assert 0.45 < near.mean() < 0.75  # three quarters are shared: 0.6 of the union
    assert f.likeness(f.sketches(texts[:-1]), f.sketches(texts[1:])).mean() < 0.1


def test_edges(edges, nothing):
    got = f.with_neighbours(edges).collect()
    assert len(got) == edges.count() and f.with_neighbours(nothing).count() == 0
    order = [(r.doc_id, r.n_chars) for r in got]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[4]) == 2 and by[4][0].fingerprint == by[4][1].fingerprint
    assert by[5][0].fingerprint == by[6][0].fingerprint and by[5][0].near_next == 1.0
    assert by[3][0].fingerprint == by[1][0].fingerprint == "0" * 256
    assert (None, 0) in order
    assert f.fingerprints(edges).count() == edges.count()


def test_one_row_is_its_own_neighbour(spark):
    [r] = f.with_neighbours(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


M = (1 << 64) - 1
A, B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def plain_mix(x):
    x = (x ^ x >> 31) * B & M
    x ^= x >> 29
    return x * A & M


def plain_toss(left, own):
    """Twice the lowest place in which two labels differ, plus own's bit there."""
    if left == own:
        return own & 1
    place = 0
    while not (left ^ own) >> place & 1:
        place += 1
    return 2 * place + (own >> place & 1)


def plain_level(symbols):
    """Names of one level's phrases, symbol by symbol in whole numbers."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]
    for _ in range(4):
        labels = [labels[0] & 1] + [plain_toss(a, b) for a, b in zip(labels, labels[1:])]
    assert all(0 <= x < 6 for x in labels) and all(a != b for a, b in zip(labels[1:], labels[2:]))
    phrases = []
    for i, run in enumerate(runs):
        if i == 0 or (i < len(runs) - 1 and labels[i - 1] < labels[i] > labels[i + 1]):
            phrases.append([])
        phrases[-1].append(run)
    return [plain_mix((sum(plain_mix((s + (n - 1) * B) & M) * pow(A, k + 1, 1 << 64) for k, (s, n) in enumerate(p)) + len(p)) & M) for p in phrases]


def plain_sketch(text):
    slots, symbols, level = [None] * f.SLOTS, [ord(c) for c in text], 0
    while symbols:
        if level >= f.FIRST_LEVEL or len(symbols) == 1:
            for s in symbols:
                h = plain_mix((s + A) & M)
                value = h >> 16 & 0xFFFFFFFF
                if slots[h >> 58] is None or value < slots[h >> 58]:
                    slots[h >> 58] = value
        if len(symbols) == 1:
            break
        symbols, level = plain_level(symbols), level + 1
    return [0 if v is None else (v & 0xFFFF) or 1 for v in slots]


def test_fingerprints_equal_plain_coin_tossing(rows):
    texts = [t for t in rows.values() if len(t) < 4000][:60] + ["", "a", "aa", "ab", "aba", "a" * 500, "ab" * 300, "😀é" * 40, "日本語" * 20 + "x", "\x00\x01\x00", "line\n" * 30]
    got = f.sketches(texts)
    for t, g in zip(texts, got):
        assert g.tolist() == plain_sketch(t), t[:40]
        assert f.sketches([t])[0].tolist() == g.tolist()
