import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagflow.llm import quality_rules as q


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def test_counts_are_exact(documents, rows):
    for r in documents.select("doc_id", q.counts(F.col("text")).alias("c")).collect():
        want = brute_counts(rows[r.doc_id])
        assert {k: r.c[k] for k in want} == want


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a b a b a b a", " a\n\na \n a\t", None, "a b c d a b c e b c d"])
def test_counts_of_small_texts(spark, text):
    [r] = spark.createDataFrame([(text,)], "t string").select(q.counts(F.col("t")).alias("c")).collect()
    want = brute_counts(text)
    assert {k: r.c[k] for k in want} == want


def brute_fit(patterns, rules):
    prior, acc = q.PRIOR, [q.FIRST] * len(rules)
    for _ in range(q.ROUNDS):
        good = {v: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc))))) for v in patterns}
        n = sum(patterns.values())
        prior = (sum(patterns[v] * good[v] for v in patterns) + q.PSEUDO * q.PRIOR) / (n + q.PSEUDO)
        new = []
        for j in range(len(rules)):
            right = sum(patterns[v] * (good[v] if v[j] == 1 else 1 - good[v]) for v in patterns if v[j])
            new.append(min(max((right + q.PSEUDO * q.FIRST) / (sum(patterns[v] for v in patterns if v[j]) + q.PSEUDO), q.LOW), q.HIGH))
        acc = new
    return {"prior": prior, **dict(zip(rules, acc))}


def test_expectation_maximisation_equals_a_plain_one(documents):
    rules = list(q.RULES)
    votes = q.score(documents)
    patterns = Counter(tuple(r) for r in votes.select(*rules).collect())
    want = brute_fit(patterns, rules)
    assert q.fit(votes, rules) == pytest.approx(want, rel=1e-9)
    for r in votes.collect():
        logit = math.log(want["prior"] / (1 - want["prior"])) + sum(r[x] * math.log(want[x] / (1 - want[x])) for x in rules)
        assert r.quality == pytest.approx(1 / (1 + math.exp(-logit)))
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_agrees_with_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = q.score(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").select("doc_id", F.col("kept").cast("int").alias("k"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right, n = got.join(labels, "doc_id").agg(F.sum((F.col("k") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.98 * n


def test_no_python_runs_on_the_executors(documents):
    plan = q.score(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_edges(edges, nothing):
    got = {(r.doc_id, r.n_words): r for r in q.score(edges).collect()}
    assert q.score(edges).count() == edges.count() and q.score(nothing).count() == 0
    assert got[(3, 0)].base_failed and not got[(3, 0)].kept and got[(9, 1)].base_failed
    kept = q.filter_quality(edges)
    assert kept.columns == edges.columns and q.filter_quality(nothing).count() == 0
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.score(edges).where("kept").collect()}
