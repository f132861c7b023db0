"""Alignment semantics on hand cases and random documents vs a sequential model."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tagflow.operators import align
from tagflow.schema import label_to_id

# a Python model of the normalise -> tokenise -> truncate -> first-occurrence -> last-wins loop
_MARKS = ".,)([]{}'‟-"
_TOK = re.compile(r"\w+|[^\w\s]+")


def py_tokens(s):
    for m in _MARKS:
        s = s.replace(m, m + " ")
    return _TOK.findall(re.sub(" +", " ", s))


def py_align(text, spans, max_len):
    toks = py_tokens(text)[:max_len]
    lab = label_to_id()
    tags = [0] * len(toks)
    for span_text, label in spans:
        et = py_tokens(span_text)
        if not et:
            continue
        for s in range(len(toks)):
            if toks[s:s + len(et)] == et:
                tags[s] = lab["B-" + label]
                for p in range(s + 1, s + len(et)):
                    tags[p] = lab["I-" + label]
                break
    return list(zip(toks, tags))


def run(spark, docs, max_len):
    rows = [(i, t, [(None, None, st, lb) for st, lb in sp]) for i, (t, sp) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int,text:string,label:string>>")
    out = align.align(df, max_len).orderBy("doc_id", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.tok, r.tag_id))
    return got


HAND = [
    ("the court said the court", [("the court", "COURT")]),                     # repeated mention -> first
    ("a b c d e", [("b c d", "JUDGE"), ("c d e", "DATE")]),                    # overlap, later wins
    ("a b c d e", [("c d e", "DATE"), ("b c d", "JUDGE")]),                    # overlap, other order
    ("one two three four", [("three four", "ORG")]),                            # crosses a cut of 3
    ("x y", [("   ", "GPE"), ("y", "GPE")]),                                    # whitespace-only span skipped
    ("no spans here", []),
    ("", []),
    ("NA nan null", [("nan", "WITNESS")]),
    ('He said "(x), fine.', [('"(x)', "LAWYER")]),                               # marks glued in front
    ("solo", [("solo", "OTHER_PERSON")]),
]


@pytest.mark.parametrize("max_len", [3, 64])
def test_hand_cases_match_sequential_model(spark, max_len):
    got = run(spark, HAND, max_len)
    for i, (text, spans) in enumerate(HAND):
        assert got.get(i, []) == py_align(text, spans, max_len), (i, text)


def test_random_documents_match_sequential_model(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "(", ")", ".", "d-e", "f,g", "h'i"]
    labels = ["COURT", "DATE", "ORG"]
    docs = []
    for _ in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        spans = []
        for _ in range(rnd.randint(0, 4)):
            if words:
                s = rnd.randrange(len(words))
                spans.append((" ".join(words[s:s + rnd.randint(1, 3)]), rnd.choice(labels)))
        docs.append((" ".join(words), spans))
    for max_len in (5, 1000):
        got = run(spark, docs, max_len)
        for i, (text, spans) in enumerate(docs):
            assert got.get(i, []) == py_align(text, spans, max_len), (i, text, spans)


def test_tokeniser_matches_python_re(spark):
    rnd = random.Random(1)
    alphabet = "ab Z9_.,()[]{}'‟-\"!?;:é\n\tü€ "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    from tagflow.functions.text import word_tokens
    got = dict(df.select("doc_id", word_tokens("text").alias("t")).rdd.map(lambda r: (r[0], r[1])).collect())
    for i, t in enumerate(texts):
        assert got[i] == py_tokens(t), repr(t)


def test_long_documents_are_not_cut(spark):
    text = " ".join(f"w{i}" for i in range(6000)) + " the end"
    got = run(spark, [(text, [("the end", "COURT")])], None)
    assert got[0] == py_align(text, [("the end", "COURT")], None) and len(got[0]) == 6002


def test_null_ids_fail_instead_of_losing_the_document(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    with pytest.raises(Exception, match="must not be null"):
        align.tokens(align.by_doc(df)).collect()


def test_partitions_grow_with_the_text(spark):
    """A task holds a bounded share of the text, whatever the corpus (a fixed or merged number of partitions would hold ever more)."""
    cores = spark.sparkContext.defaultParallelism
    for n in (40, 400):
        docs = spark.createDataFrame([(i, "x" * 1000) for i in range(n * cores)], "doc_id long, text string")
        parts = align.by_doc(docs, per_task=20_000)
        assert parts.rdd.getNumPartitions() == n * cores // 20 and parts.count() == n * cores
    assert align.by_doc(docs.where("doc_id < 0")).count() == 0
