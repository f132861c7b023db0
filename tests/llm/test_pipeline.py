import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as p
from tagflow.llm import pii, quality_rules, simhash
from tagflow.llm.common import written

SF = "/root/testdata/sf0.001"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in p.STAGES:
        docs = written(f(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_stages_are_registered():
    assert len(p.STAGES) == 5 and entry.queries()["pipeline"] is p.run
    ops = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in ops) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_each_stage_does_its_work(spark, documents, stages):
    rules, dedup, private, mixed, packed = stages
    assert all(s.columns == documents.columns for s in stages[:4])
    kept = {r.doc_id for r in quality_rules.score(documents).where("kept").collect()}
    assert {r.doc_id for r in rules.collect()} == kept
    assert {r.doc_id for r in dedup.collect()} == {r.component_id for r in simhash.near_duplicates(rules).collect()}
    assert {r.doc_id for r in private.collect()} == {r.doc_id for r in dedup.collect()}
    assert all(not r.base for r in pii.detect(private).collect())
    size, text = Counter(), {r.doc_id: r for r in private.collect()}
    for r in text.values():
        size[r.source] += words(r.text)
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += words(r.text)
        assert text[r.doc_id].text.startswith(r.text) and r.n_chars == len(r.text)
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=len(size))
    assert all(taken[s] <= 2 * size[s] for s in size)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    fill = Counter()
    for r in packed.collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, edges, nothing, k):
    stage = p.STAGES[k][1]
    assert stage(spark, nothing, SF).count() == 0
    out = stage(spark, edges, SF)
    assert k == 4 or out.columns == edges.columns
    out.collect()
