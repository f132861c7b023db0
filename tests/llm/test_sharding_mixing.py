import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tagflow.llm import mixing, sharding


def test_shards_are_even_and_hold_the_mixture(documents, rows):
    got = sharding.shard(documents, 7).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len(rows[r.doc_id].encode()) + 16 and r.text_crc32 == crc32(rows[r.doc_id].encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sorted(by) == list(range(7))
    total = Counter(r.source for r in got)
    for s in by:
        own = Counter(r.source for r in got if r.shard == s)
        assert all(abs(own[x] - total[x] / 7) < 1.5 for x in total)


def test_shards_equal_a_plain_sort(documents, rows):
    import hashlib
    src = {r.doc_id: r.source for r in documents.collect()}
    key = {i: hashlib.md5(f"11:{i}".encode()).hexdigest() for i in rows}
    within = defaultdict(list)
    for i in sorted(rows, key=lambda i: key[i]):
        within[src[i]].append(i)
    order = sorted(((k + 0.5) / len(v), s, key[i], i) for s, v in within.items() for k, i in enumerate(v))
    want = {x[-1]: g * 40 // len(order) for g, x in enumerate(order)}
    assert {r.doc_id: r.shard for r in sharding.shard(documents, 40).collect()} == want


def test_shard_reruns_agree_on_other_partitions(documents):
    one = sorted(map(str, sharding.shard(documents, 9).collect()))
    assert sorted(map(str, sharding.shard(documents.repartition(13), 9).collect())) == one


def test_shard_edges(edges, nothing):
    got = sharding.shard(edges, 5).collect()
    assert len(got) == edges.count() and sharding.shard(nothing, 5).count() == 0
    assert max(Counter(r.shard for r in got).values()) <= 3
    with pytest.raises(ValueError):
        sharding.shard(edges, 0)


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    names = sorted((s is None, s or "") for s in sizes)
    size = {(s is None, s or ""): n for s, n in sizes.items()}
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, fixed = budget * sum(size.values()), {}, set()
    while True:  # the contract's rounds: cap what is above, share the rest again
        free = [s for s in names if s not in fixed]
        left = total - sum(epochs * size[s] for s in fixed)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * size[s]}
        target = {s: epochs * size[s] for s in fixed} | share
        if not over:
            return target
        fixed |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("block", [1024, 50])
def test_mix_meets_its_targets(documents, rows, block):
    docs, pieces = mixing.mix(documents, block=block)
    docs, pieces = docs.collect(), pieces.collect()
    src = {r.doc_id: r.source for r in documents.collect()}
    sizes = Counter()
    for i, t in rows.items():
        sizes[src[i]] += words(t)
    want = brute_targets(sizes)
    assert len(docs) == len(rows)
    taken, by_slot = defaultdict(int), defaultdict(int)
    per_doc = Counter()
    for p in pieces:
        taken[(p._none, p._src)] += p.length
        per_doc[p.doc_id] += p.length
        by_slot[p.slot] += p.length
    for d in docs:
        assert d.size == words(rows[d.doc_id]) and d.target == pytest.approx(want[(d._none, d._src)])
        assert per_doc[d.doc_id] <= 2 * d.size
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert max(by_slot.values()) <= block
    # every beginning of the mix follows the weights
    order = sorted(by_slot)[:max(20, len(by_slot) // 3)]
    share = Counter()
    for p in pieces:
        if p.slot in set(order):
            share[(p._none, p._src)] += p.length
    big = max(want, key=want.get)
    assert abs(share[big] / sum(share.values()) - want[big] / sum(want.values())) < 0.1


@pytest.mark.parametrize("block", [1024, 20])
def test_no_beginning_of_the_mix_strays_from_the_targets(documents, block):
    """At every slot each source has its share of what was taken so far, within the discrepancy of the points; every slot holds one source's block."""
    docs, pieces = mixing.mix(documents, block=block)
    target = {(d._none, d._src): d.target for d in docs.collect()}
    total, slots = sum(target.values()), defaultdict(Counter)
    for p in pieces.collect():
        slots[p.slot][p._none, p._src] += p.length
    assert all(len(x) == 1 for x in slots.values())
    taken, n = Counter(), 0
    for slot in sorted(slots):
        taken.update(slots[slot])
        n += 1
        so_far = sum(taken.values())
        assert all(abs(taken[s] - target[s] / total * so_far) <= block * (math.log2(n) + 3) for s in target)


def test_mixed_documents_come_in_the_order_of_the_schedule(spark, documents):
    mixed = mixing.mixed_documents(documents)
    firsts = {}
    for p in mixing.mix(documents)[1].collect():
        firsts[p.doc_id, p.epoch] = min(firsts.get((p.doc_id, p.epoch), (p.slot, p.start)), (p.slot, p.start))
    left = defaultdict(list)
    for (i, _), place in sorted(firsts.items(), key=lambda x: x[1]):
        left[i].append(place)
    order = [left[r.doc_id].pop(0) for r in mixed.collect()]
    assert order == sorted(order) and not any(left.values())


def test_rows_equal_in_id_and_text_keep_their_other_columns(spark):
    rows = [(1, "a b c " * 50, "en", "s", k) for k in range(5)] + [(i, "d e f " * 50, "de", "t", i) for i in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(map(tuple, mixing.mixed_documents(df.repartition(k)).collect())) for k in (1, 4)]
    assert got[0] == got[1]


def test_mix_reruns_agree_and_run_no_python(documents):
    one = sorted(map(str, mixing.mix(documents)[1].collect()))
    docs, pieces = mixing.mix(documents.repartition(11))
    assert sorted(map(str, pieces.collect())) == one
    assert "Python" not in pieces._jdf.queryExecution().toString() + docs._jdf.queryExecution().toString()


def test_mix_edges(edges, nothing):
    docs, pieces = mixing.mix(edges)
    assert docs.count() == edges.count() and mixing.mix(nothing)[1].count() == 0 and mixing.mix(nothing)[0].count() == 0
    assert docs.where("_none").select("target").distinct().collect()[0].target == 0
    mixed = mixing.mixed_documents(edges)
    assert mixed.columns == edges.columns
    got = Counter(r.source for r in mixed.collect())
    assert got and mixing.mixed_documents(nothing).count() == 0
    total = sum(words(r.text) for r in mixed.collect())
    assert total == sum(r.length for r in pieces.collect())
    assert mixed.where(F.length("text") != F.col("n_chars")).where("doc_id = 8").count() <= 2
