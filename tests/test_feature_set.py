"""Feature set and dictionary: what passes through sorts and windows, and how often keys are made."""
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tagflow.operators import align
from tagflow.operators import features as fe
from tagflow.operators import vocab as vo
from tagflow.plans import catalog as cat
from tagflow.session import tune


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_the_feature_set_hold_training_tokens_only(spark):
    """Once through a document, without its finished features and without the other split."""
    plan = _optimized(cat.QUERIES["feature_set"](spark, SF_SMALL))
    above, below = plan.split("+- Window [")
    assert re.search(r"Filter .*% 5\) = 0", below) and "% 5" not in above
    assert "unboundedfollowing" not in plan and plan.count("Window [") == 1 and plan.count("Sort [") <= 1
    assert "concat(" not in below


def test_reference_borders_by_the_window_from_the_end(spark):
    toks = spark.createDataFrame([(1, 0, "a", "X"), (1, 1, "b", "Y"), (1, 2, "c", "Z"), (2, 0, "d", "W"), (3, 0, "e", None), (3, 1, "f", "V"), (4, 0, "g", "U"), (4, 1, "h", None)],
                                 "doc_id long, pos int, tok string, pos_tag string")
    got = {(r[0], r[1]): r[2:] for r in fe.context_features(toks).select("doc_id", "pos", *[t.name for t in fe.default_templates()]).collect()}
    assert got[1, 0] == ("word=a", "prev_word=<unk>", "next_word=b", "pos=X", "prev_pos=pos=Z", "next_pos=Y")
    assert got[1, 1] == ("word=b", "prev_word=a", "next_word=c", "pos=Y", "prev_pos=X", "next_pos=Z")
    assert got[1, 2] == ("word=c", "prev_word=b", "next_word=<unk>", "pos=Z", "prev_pos=Y", "next_pos=pos=Z")
    assert got[2, 0] == ("word=d", "prev_word=<unk>", "next_word=<unk>", "pos=W", "prev_pos=pos=W", "next_pos=pos=W")
    assert got[3, 0][3:] == (None, "prev_pos=pos=V", "next_pos=V") and got[3, 1][4] == "prev_pos=pos=V"  # a null tag before is no tag: the border's rule
    assert got[4, 0][4] is None and got[4, 1][3:] == (None, "prev_pos=U", None)


def test_shape_tags_by_first_byte_are_those_of_the_patterns(spark):
    toks = ["a", "z", "zebra", "{", "`", "A", "Z", "Zoo", "[", "@", "a1", "1a", "12", "12\n", "x\n", "\n", "", "_", "_a", "É", "é", "Ünder", "straße", "中文", "٣٤", "Ⅷ", "...", "'s", "-", "a-b", "A.", "😀",
            "ǅ", "Ж", "ж", " a", None]
    t = F.col("tok")
    want = (F.when(t.rlike(r"^\p{N}+$"), F.lit("NUM")).when(~t.rlike(r"[\p{L}\p{N}_]"), F.lit("PUNCT")).when(t.rlike(r"^\p{Lu}"), F.lit("CAP")).otherwise(F.lit("LOW")))
    df = spark.createDataFrame([(x,) for x in toks], "tok string")
    rows = df.select("tok", want.alias("want"), fe.shape_tag("tok").alias("got")).collect()
    assert [(r.tok, r.got) for r in rows] == [(r.tok, r.want) for r in rows]
    assert "CASE WHEN ((tok" in _optimized(df.select(fe.shape_tag("tok")))  # bytes are compared first


def test_dictionary_keys_are_made_once(spark, monkeypatch):
    """The sort reads its input twice, so it gets a table and not the distinct rows' plan."""
    seen, real = [], vo.dense_index
    monkeypatch.setattr(vo, "dense_index", lambda df, *a: seen.append(_optimized(df)) or real(df, *a))
    keys = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("<PAD>",), ("c",)], "feature string")
    got = {r.feature: r.feature_id for r in vo.feature_dict(vo.feature_set(keys)).collect()}
    assert got == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3, "c": 4}
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Relation" in seen[0]


@pytest.mark.parametrize("name", ["feature_set", "pad_truncate"])
def test_documents_of_a_task_stay_few_whatever_the_corpus(spark, monkeypatch, name):
    """With partitions of a fixed or merged number a task's sorts and sequences spill on a large corpus."""
    tune(spark)
    held = cat.fx.documents(spark, SF_SMALL).agg(F.sum(F.octet_length("text"))).first()[0]
    for parts in (64, 256):
        monkeypatch.setattr(align.by_doc, "__defaults__", ("doc_id", "text", -(-held // parts)))
        plan = cat.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
        assert dealt and all(parts - 3 <= int(n) <= parts for n in dealt), plan
