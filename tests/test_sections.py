"""Documents of several files and sections stay apart."""
import json
import os

import pytest

from tagflow.operators import align
from tagflow.operators import spans as sp
from tagflow.sources import annotations as ann


def record(text, *spans):
    return {"data": {"text": text}, "annotations": [{"result": [{"value": {"start": 0, "end": 1, "text": t, "labels": [y]}} for t, y in spans]}]}


def write(path, name, data):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(data)
    return str(path)


def test_judgement_and_preamble_of_equal_number_dont_merge(spark, tmp_path):
    a = write(tmp_path / "a", "x.json", json.dumps(record("Alpha met Beta", ("Alpha", "JUDGE"))))
    b = write(tmp_path / "b", "x.json", json.dumps(record("Gamma saw Delta", ("Delta", "COURT"))))
    united = ann.read_sections(spark, {("train", "judgement"): a, ("train", "preamble"): b})
    assert [(r.doc_id, r.part_id, r.split, r.section, r.text) for r in united.orderBy("doc_id").collect()] == [
        (0, 0, "train", "judgement", "Alpha met Beta"), (1, 0, "train", "preamble", "Gamma saw Delta")]
    tags = [(r.doc_id, r.tok, r.tag) for r in align.align(united.select("doc_id", "text", "spans")).orderBy("doc_id", "pos").collect()]
    assert tags == [(0, "Alpha", "B-JUDGE"), (0, "met", "O"), (0, "Beta", "O"), (1, "Gamma", "O"), (1, "saw", "O"), (1, "Delta", "B-COURT")]


def test_numbers_run_over_four_sections_whatever_the_splits(spark, tmp_path):
    paths, want = {}, []
    for s, (split, section) in enumerate([("train", "judgement"), ("train", "preamble"), ("dev", "judgement"), ("dev", "preamble")]):
        n = [70, 0, 35, 90][s]
        for k in range(2):
            lines = [json.dumps(record(f"{split} {section} {k} {i}")) for i in range(n // 2 if k == 0 else n - n // 2)]
            paths[split, section] = write(tmp_path / f"{split}-{section}", f"{k}.json", "\n".join(lines))
            want += [(split, section, f"{split} {section} {k} {i}") for i in range(len(lines))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        got = ann.read_sections(spark, paths).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.split, r.section, r.text) for r in got] == want and [r.doc_id for r in got] == list(range(len(want)))


def test_repeated_and_null_ids_raise(spark):
    one = spark.createDataFrame([(0, "a"), (3, "b")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "c"), (9, "d")], "doc_id long, text string")
    with pytest.raises(ValueError, match="over all sections"):
        sp.section_union({"judgement": one, "preamble": two}, ids="keep")
    with pytest.raises(ValueError, match="over all sections"):
        sp.section_union({"judgement": one.union(one), "preamble": two})
    with pytest.raises(ValueError, match="over all sections"):
        sp.section_union({"judgement": spark.createDataFrame([(None, "a")], "doc_id long, text string")}, ids="keep")
    with pytest.raises(ValueError):
        sp.section_union({"judgement": one}, ids="guess")
    got = sp.section_union({"judgement": one, "preamble": two}).orderBy("doc_id").collect()
    assert [(r.text, r.part_id) for r in got] == [("a", 0), ("b", 3), ("c", 3), ("d", 9)] and len({r.doc_id for r in got}) == 4
    kept = sp.section_union({"judgement": one, "preamble": two.where("doc_id = 9")}, ids="keep")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 9]
    assert sp.section_union({"judgement": one.limit(0), "preamble": two.limit(0)}).count() == 0


def test_legacy_files_with_the_same_index_stay_apart(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "l", f"{k}.csv", ",overall_text,start,end,text,label\n" + "".join(
            f'{i},"text {k}\n{i}","[0]","[4]","[\'text {k} {i}\']","[\'ORG\']"\n' for i in range(4)))
    docs = ann.read_legacy_spans(spark, str(tmp_path / "l")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.source_id, r.text, r.spans[0].text) for r in docs] == [
        (4 * k + i, str(i), f"text {k}\n{i}", f"text {k} {i}") for k in range(3) for i in range(4)]
    parts = {f"s{k}": ann.read_legacy_spans(spark, str(tmp_path / "l" / f"{k}.csv")) for k in range(3)}
    assert [r.doc_id for r in sp.section_union(parts).orderBy("doc_id").collect()] == list(range(12))
