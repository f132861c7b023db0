"""The classifier's counts, buckets, weak labels and scorer against plain Python."""
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tagflow.llm import quality_classifier as qc
from tagflow.llm import quality_rules as rules
from tagflow.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_upper": sum(unicodedata.category(c) == "Lu" for c in text),
            "n_function": sum(w in rules.FUNCTION_WORDS for w in words), "n_shouts": sum(w.endswith("!") for w in words), "n_long": sum(len(w) > 25 for w in words)}


def plain_buckets(text):
    out = Counter()
    for w in WORD.findall(text or ""):
        out[qc.bucket(w)] += 1
        if not all(unicodedata.category(c) == "Ll" for c in w):
            shape = re.sub("A+", "A", "".join("A" if unicodedata.category(c) == "Lu" else c for c in w))
            runs, last = [], None
            for c, kind in zip(w, ["A" if unicodedata.category(c) == "Lu" else "a" if unicodedata.category(c) == "Ll" else None for c in w]):
                if kind is None or kind != last:
                    runs.append(kind or c)
                last = kind
            assert shape is not None
            out[qc.bucket("\u0001" + "".join(runs))] += 1
    return out


def texts():
    draw = random.Random(7)
    words = ["the", "The", "NASA", "und", "été", "Ünter-2", "x!", "a&b", "!!!", "x" * 30, "iPhone6S", "日本", "of", "no break"]
    out = [None, "", " \t\n", "one", "a b a b a b", "line\nline\n\n \nline 2\nline", " lead and trail "]
    for _ in range(120):
        out.append("".join(draw.choice(words) + draw.choice([" ", " ", "\n", "  ", "\r\n", "\t"]) for _ in range(draw.randint(0, 60))))
    return out


def test_counts_and_buckets_of_whole_texts():
    batch = texts()
    for part in (pa.array(batch), pa.array(["x", *batch]).slice(1)):
        counts, buckets, numbers = qc.counts_of(part)
        for i, t in enumerate(batch):
            assert {c: int(counts[c][i]) for c in qc.COUNTED} == plain_counts(t), t
            assert dict(zip(buckets[i].tolist(), numbers[i].tolist())) == plain_buckets(t), t


def test_counts_are_those_of_the_native_rules(spark, documents):
    mine = qc.counted(documents, "doc_id", "text").select("doc_id", *qc.COUNTED)
    theirs = documents.select("doc_id", rules.counts(F.col("text")).alias("c")).select("doc_id", "c.*").select("doc_id", *qc.COUNTED)
    assert sorted(mine.collect()) == sorted(theirs.collect())


def plain_em(patterns, n_rules):
    prior, acc = rules.PRIOR, [rules.FIRST] * n_rules
    good = lambda v: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(x * math.log(a / (1 - a)) for x, a in zip(v, acc)))))
    for _ in range(rules.ROUNDS):
        soft = {v: good(v) for v in patterns}
        total = sum(patterns.values())
        new = (sum(n * soft[v] for v, n in patterns.items()) + rules.PSEUDO * rules.PRIOR) / (total + rules.PSEUDO)
        rates = []
        for j in range(n_rules):
            right = sum(n * (soft[v] if v[j] == 1 else 1 - soft[v] if v[j] == -1 else 0) for v, n in patterns.items())
            cast = sum(n for v, n in patterns.items() if v[j])
            rates.append(min(max((right + rules.PSEUDO * rules.FIRST) / (cast + rules.PSEUDO), rules.LOW), rules.HIGH))
        prior, acc = new, rates
    return prior, acc, {v: good(v) for v in patterns}


def test_weak_labels_scorer_and_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = written(qc.counted(docs, "doc_id", "text"), "test-counts").select("*", *[rules.vote(r).alias(r) for r in qc.LABELLERS])
    model = rules.fit(table, qc.LABELLERS)
    votes = {r[0]: tuple(r[1:]) for r in table.select("doc_id", *qc.LABELLERS).collect()}
    prior, acc, soft = plain_em(Counter(votes.values()), len(qc.LABELLERS))
    assert math.isclose(model["prior"], prior, rel_tol=1e-9) and np.allclose([model[r] for r in qc.LABELLERS], acc)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    p = {d: 0.0 if not WORD.search(text[d] or "") else soft[votes[d]] for d in text}  # fewer documents than TRAIN_ROWS: all are fitted
    weights, intercept = qc.fitted(table, F.when(F.col("n_words") == 0, 0.0).otherwise(rules.posterior(model, qc.LABELLERS)))
    features = {d: plain_buckets(text[d]) for d in text}
    margin = {d: intercept + sum(weights[b] * n for b, n in features[d].items()) for d in text}
    score = {d: 1 / (1 + math.exp(-max(min(m, 700), -700))) for d, m in margin.items()}
    got = {r.doc_id: r for r in qc.classify(docs).collect()}
    for d in text:
        want = 0.0 if not WORD.search(text[d] or "") else score[d]
        assert abs(got[d].score - want) < 2e-6 and (got[d].kept == (want >= 0.5) or abs(want - 0.5) < 1e-6)
    # first-order optimality of the weighted ridge regression (ridge on standardised features), against the gradient at the start
    n, x1, x2 = len(text), np.zeros(qc.FEATURES), np.zeros(qc.FEATURES)
    start, end = np.zeros(qc.FEATURES), np.zeros(qc.FEATURES)
    mean = np.mean(list(p.values()))
    for d, f in features.items():
        at, v = np.array(list(f), int), np.array(list(f.values()), float)
        x1[at] += v
        x2[at] += v * v
        start[at] += (mean - p[d]) * v / n
        end[at] += (score[d] - p[d]) * v / n
    std = np.sqrt(np.maximum(x2 / n - (x1 / n) ** 2, 0))
    ok = std > 0
    slope = lambda g, w: np.abs(g[ok] / std[ok] + qc.RIDGE * w[ok] * std[ok]).max()
    assert slope(end, weights) < 0.1 * slope(start, np.zeros(qc.FEATURES))
