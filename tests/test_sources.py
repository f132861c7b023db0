"""Sources and sinks through real files (JSON annotations, CoNLL text, label lists, Parquet)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tagflow.operators import spans as sp
from tagflow.sources import annotations as ann
from tagflow.sources import conll as co
from tagflow.sources import encoded as en


def test_read_annotations_multiline_array(spark):
    recs = [
        {"id": 1, "data": {"text": "Court of X"}, "annotations": [
            {"result": [{"value": {"start": 0, "end": 5, "text": "Court", "labels": ["COURT", "ORG"]}}]},
            {"result": [{"value": {"start": 9, "end": 10, "text": "X", "labels": ["GPE"]}}]}]},
        {"id": 2, "data": {"text": "nothing"}, "annotations": []},
        {"id": 3, "data": {"text": "bad"}, "annotations": [{"result": [{"value": {"start": 0, "end": 3, "text": "bad", "labels": []}}]}]},
    ]
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(recs, f)
    docs = ann.read_annotations(spark, d, split="train", section="judgement", multi_line=True)
    rows = {r.source_id: r for r in docs.collect()}
    assert [rows[k].doc_id for k in "123"] == [0, 1, 2]
    assert [(s.text, s.label) for s in rows["1"].spans] == [("Court", "COURT"), ("X", "GPE")]
    assert rows["2"].spans == [] and rows["1"].split == "train"
    assert [r.doc_id for r in sp.invalid_label_docs(docs).collect()] == [2]
    out = os.path.join(d, "spans")
    ann.write_spans(docs, out)
    assert ann.read_spans(spark, out).count() == 3


def test_read_conll_last_sentence_without_blank_line(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "x.txt"), "w") as f:
        f.write("a\tO\nb\tB-COURT\n\nc\tO\n\n\nd\tI-COURT")
    rows = co.read_conll(spark, d).orderBy("sent_id", "pos").collect()
    assert [(r.sent_id, r.pos, r.token, r.tag) for r in rows] == [
        (0, 0, "a", "O"), (0, 1, "b", "B-COURT"), (1, 0, "c", "O"), (2, 0, "d", "I-COURT")]


def test_read_labels(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "l.txt"), "w") as f:
        f.write("O\n\nB-X\nI-X\n")
    got = {r.label: r.label_id for r in co.read_labels(spark, d).collect()}
    assert got == {"<PAD>": 0, "O": 1, "B-X": 2, "I-X": 3}


def test_legacy_wide_csv_keeps_first_row_and_na_tokens(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "w.csv"), "w") as f:
        f.write("a,NA,nan\nnull,b,\n")
    rows = en.read_legacy_wide(spark, d).orderBy("doc_id", "pos").collect()
    assert [r.value for r in rows] == ["a", "NA", "nan", "null", "b"]


def test_legacy_span_csv_and_model_roundtrip(spark):
    import numpy as np
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "spans.csv"), "w") as f:
        f.write(',overall_text,start,end,text,label\n')
        f.write('0,"Mr. X met\nthe court","[0, 14]","[5, 23]","[\'Mr. X\', ""the court\'s""]","[\'JUDGE\', \'COURT\']"\n')
        f.write('1,empty,[],[],[],[]\n')
    docs = {r.doc_id: r for r in ann.read_legacy_spans(spark, d).collect()}
    assert [(s.start, s.end, s.text, s.label) for s in docs[0].spans] == [(0, 5, "Mr. X", "JUDGE"), (14, 23, "the court's", "COURT")]
    assert docs[0].text == "Mr. X met\nthe court" and docs[1].spans == []
    w = spark.createDataFrame([(2, [0.5, -1.0])], "feature_id int, w array<double>")
    en.save_model(w, {"trans": np.eye(2).ravel(), "start": [0.1, 0.2]}, os.path.join(d, "m"))
    w2, chain = en.load_model(spark, os.path.join(d, "m"))
    assert w2.collect()[0].w == [0.5, -1.0] and chain["start"] == [0.1, 0.2]


def _write(d, name, data):
    with open(os.path.join(d, name), "wb") as f:
        f.write(data.encode())


@pytest.mark.parametrize("ids", [None, "text", "number"])
def test_annotations_with_any_id_over_many_splits(spark, ids):
    d = tempfile.mkdtemp()
    own = {None: lambda i: {}, "text": lambda i: {"id": f"x{i}"}, "number": lambda i: {"id": i * 10}}[ids]
    for k in range(3):
        _write(d, f"{k}.json", "\n".join(json.dumps({**own(i), "data": {"text": f"text {i}"}, "annotations": []}) for i in range(k * 100, k * 100 + 100)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = ann.read_annotations(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.doc_id, r.text) for r in rows) == [(i, f"text {i}") for i in range(300)]
    assert {r.source_id for r in rows} == ({None} if ids is None else {str(own(i)["id"]) for i in range(300)})


def _conll(spark, d, **kw):
    return [(r.sent_id, r.pos, r.token, r.tag) for r in co.read_conll(spark, d, **kw).orderBy("sent_id", "pos").collect()]


@pytest.mark.parametrize("text", ["a\tO\r\nb\tB-X\r\n\r\nc\tO\r\n", "a\tO\nb\tB-X\n \nc\tO\n", "a\tO  \nb\tB-X\n\t\n\n\nc\tO", "\n\na\tO\nb\tB-X\n\u2003\nc\tO\n\n"])
def test_read_conll_separators(spark, text):
    d = tempfile.mkdtemp()
    _write(d, "x.txt", text)
    assert _conll(spark, d) == [(0, 0, "a", "O"), (0, 1, "b", "B-X"), (1, 0, "c", "O")]


def test_read_conll_over_files_and_splits(spark):
    d = tempfile.mkdtemp()
    want, n = [], 0
    for k in range(3):
        sents = [[(f"t{k}-{i}-{j}", "O") for j in range(1 + (i * 7) % 5)] for i in range(200)]
        _write(d, f"{k}.txt", "\n\n".join("\n".join("\t".join(x) for x in s) for s in sents))  # no blank line at the end
        for s in sents:
            want += [(n, j, *x) for j, x in enumerate(s)]
            n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert _conll(spark, d) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_read_conll_strict_reference_and_bad_lines(spark):
    d = tempfile.mkdtemp()
    _write(d, "x.txt", "a\tO\n\n\nb\tO\n\nc\tO")
    assert _conll(spark, d, strict_reference=True) == [(0, 0, "a", "O"), (2, 0, "b", "O")]
    _write(d, "x.txt", "a O\n")
    with pytest.raises(Exception, match="not token<TAB>tag"):
        _conll(spark, d)


def test_legacy_rows_are_joined_by_position_whatever_the_splits(spark):
    d = tempfile.mkdtemp()
    n = 3000
    _write(d, "data.csv", "".join(f"tok{i},x{i}\n" for i in range(n)))
    _write(d, "labels.csv", "".join(f"{i % 29},{(i + 1) % 29}\n" for i in range(n)))
    _write(d, "mask.csv", "1,1\n" * n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = en.read_legacy_triple(spark, f"{d}/data.csv", f"{d}/labels.csv", f"{d}/mask.csv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.doc_id, r.pos, r.value, r.label, r.mask) for r in rows) == sorted(
        x for i in range(n) for x in ((i, 0, f"tok{i}", i % 29, 1), (i, 1, f"x{i}", (i + 1) % 29, 1)))


@pytest.mark.parametrize("na,want", [("keep", [["a", "b"], ["c", "NA", "e", 'q"x,y'], [" "]]), ("default", [["a", "b"], ["c", "e", 'q"x,y'], [" "]]),
                                     ("none", [["a", "b"], ["c", "NA", "e", 'q"x,y', ""], [" "]])])
def test_ragged_rows_and_na_policies(spark, na, want):
    d = tempfile.mkdtemp()
    _write(d, "w.csv", 'a,b\r\nc,NA,e,"q""x,y",\n \n')
    got = {}
    for r in en.read_legacy_wide(spark, d, na=na).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.value)
    assert [got[k] for k in sorted(got)] == want


def _plain_conll(texts, strict):
    """Sentences of files in order, line by line."""
    out, n = [], 0
    for text in texts:
        sent = []
        for line in text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"):
            if line.rstrip():
                sent.append(tuple(line.rstrip().split("\t")))
            elif sent or strict:
                out += [(n, j, *x) for j, x in enumerate(sent)]
                n, sent = n + 1, []
        if sent and not strict:
            out += [(n, j, *x) for j, x in enumerate(sent)]
            n += 1
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_read_conll_numbers_lines_without_sorting_them(spark, strict):
    import random
    draw, d, texts = random.Random(5), tempfile.mkdtemp(), []
    for k in range(4):
        lines = [draw.choice(["", " ", "\t"]) if draw.random() < (0.3, 0.02, 0.6, 0.0)[k] else f"w{k}-{i}\tO" for i in range(300)]
        texts.append("\n".join(lines) + draw.choice(["", "\n", "\n\n"]))
        _write(d, f"{k}.txt", texts[-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("90", "400", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert _conll(spark, d, strict_reference=strict) == _plain_conll(texts, strict)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    plan = co.read_conll(spark, d, strict_reference=strict)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Sort", "hashpartitioning", "rangepartitioning"))


def test_arrow_strips_what_the_expression_strips(spark):
    own = spark.range(1, 0x3100).select("id", co.stripped(F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"))).alias("s")).where("s = 'a'")
    assert {chr(r.id) for r in own.collect()} == set(co._SPACES)
