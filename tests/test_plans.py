"""Plan-shape checks: one document exchange in the flagship, no broadcast of tokens,
no single-partition windows in the feature path, pushdown into the scan."""

from tagflow.plans import catalog as cat

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_shuffles_documents_once(spark):
    import re
    df = cat.QUERIES["bio_tags"](spark, SF_SMALL)
    df.collect()  # runs df's own query execution, so the final adaptive plan is available
    p = _plan(df).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in p
    assert p.count("ReusedExchange") >= 2, p
    assert len(set(re.findall(r"REPARTITION_BY_COL, \[plan_id=(\d+)\]", p))) == 1, p
    assert "ENSURE_REQUIREMENTS" not in p, p
    assert "BroadcastExchange" not in p, p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_feature_windows_are_partitioned_by_document(spark):
    df = cat.QUERIES["ctx_pos_features"](spark, SF_SMALL)
    txt = df._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in txt
    assert "SinglePartition" not in txt
