"""One large JSON array read in many splits equals the whole-file reader."""
import json
import random

import pytest

from tagflow.sources import annotations as ann
from tagflow.sources import json_array as ja


def record(draw, i):
    nasty = ['a "quote" and \\ back', "{[}]", '}"{', "\\\\", '\\"', "line\nbreak", "tab\t", "é😀", "]", "}", "{", '"', "", " , ", "end\\"]
    text = "".join(draw.choice(nasty + ["plain words "]) for _ in range(draw.randint(0, 8)))
    spans = [{"value": {"start": k, "end": k + 1, "text": draw.choice(nasty), "labels": draw.sample(["ORG", "GPE", "}"], draw.randint(0, 2))}, "from": {"x": [1, {"y": []}]}} for k in range(draw.randint(0, 3))]
    out = {"data": {"text": text, "more": {"a": "}"}}, "annotations": [{"result": spans[:1]}, {"result": spans[1:]}] if draw.random() < 0.9 else []}
    return out | ({"id": i} if draw.random() < 0.5 else {})


def files(tmp_path, n, indent, sizes=(1,)):
    draw, made = random.Random(n), 0
    for k, share in enumerate(sizes):
        recs = [record(draw, made + i) for i in range(int(n * share))]
        made += len(recs)
        (tmp_path / f"{k}.json").write_text(json.dumps(recs, indent=indent, ensure_ascii=k % 2 == 0) + ("\n" if k % 2 else ""))
    return str(tmp_path)


@pytest.mark.parametrize("split,indent,sizes", [("200", None, (1,)), ("137", 2, (0.5, 0, 0.3, 0.2)), ("100m", None, (0.7, 0.3)), ("1000", 1, (1,))])
def test_splits_equal_the_whole_file(spark, tmp_path, split, indent, sizes):
    path = files(tmp_path, 300, indent, sizes)
    want = [(r.doc_id, r.source_id, r.text, [tuple(s) for s in r.spans]) for r in ann.read_annotations(spark, path, multi_line=True).orderBy("doc_id").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        docs = ja.read_annotation_arrays(spark, path, "train", "judgement")
        got = [(r.doc_id, r.source_id, r.text, [tuple(s) for s in r.spans]) for r in docs.orderBy("doc_id").collect()]
        if split == "200":
            assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == want and len(got) == sum(int(300 * s) for s in sizes)
    assert docs.columns == ["doc_id", "text", "spans", "source_id", "split", "section"]


@pytest.mark.parametrize("text,n", [("[]", 0), ("[ ]\n", 0), ("[{}]", 1), ('[{"data":{"text":"x"}}]', 1), ('﻿[{"data":{"text":"a}"}},\n\n{"data":{"text":"[b"}}]', 2)])
def test_small_arrays(spark, tmp_path, text, n):
    (tmp_path / "a.json").write_text(text)
    assert ja.array_records(spark, str(tmp_path)).count() == n


def test_arrays_grow_in_number_and_keep_their_order(spark):
    """Files are cut by size; from ten files on their names still sort in the order of documents."""
    import glob

    from conftest import SF_SMALL
    from tagflow.plans import fixtures as fx

    def read(**how):
        path = fx.annotation_arrays(spark, SF_SMALL, **how)
        docs = ja.read_annotation_arrays(spark, path).select("doc_id", "text")
        return len(glob.glob(f"{path.removeprefix('file:')}/part=*")), [r.text for r in docs.orderBy("doc_id").collect()]

    want = [r.text for r in fx.documents(spark, SF_SMALL).orderBy("doc_id").collect()]
    (few, a), (many, b) = read(), read(file_bytes=30_000)
    assert few == 4 and many > 11 and a == b == want
