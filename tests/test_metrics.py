"""Metric operators: fixture figures (FIXTURES.md F-B) and border cases."""

import math

import pytest
from pyspark.sql import functions as F

from tagflow.operators import metrics as me
from tagflow.plans import catalog as cat
from tagflow.plans import fixtures as fx

from conftest import SF_MID


@pytest.fixture(scope="module")
def fb(spark):
    return fx.pseudo_predictions(cat.bio(spark, SF_MID)).cache()


def test_fixture_counts_and_f1(fb):
    r = me.prf_micro(fb).first()
    assert (r.tp, r.n_pred, r.n_true) == (5782, 72086, 7329)
    assert round(me.f1_weighted(fb).first().f1_weighted, 9) == 0.920453834
    assert round(me.f1_weighted(fb, labels=range(1, 28)).first().f1_weighted, 9) == 0.793311975


def test_nan_f1_and_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "true_id int, pred_id int")
    r = me.prf_micro(df).first()
    assert r.precision == 0.0 and r.recall == 0.0 and math.isnan(r.f1)
    assert me.f1_weighted(spark.createDataFrame([(29, 3)], "true_id int, pred_id int")).first().f1_weighted == 0.0


def test_weighted_f1_matches_hand_computation(spark):
    rows = [(1, 1), (1, 2), (2, 2), (0, 1), (29, 5)]
    df = spark.createDataFrame(rows, "true_id int, pred_id int")
    # labels seen: 0,1,2 (pad row removed); f1_1 = 2*1/(2+2)=.5 (support 2), f1_2 = 2*1/(2+1) (support 1), f1_0 = 0
    want = (0.5 * 2 + (2 / 3) * 1 + 0 * 1) / 4
    assert abs(me.f1_weighted(df).first().f1_weighted - want) < 1e-12
    acc = me.token_accuracy(df).first()
    assert (acc.n, acc.n_equal) == (4, 2)
    assert me.token_accuracy(df, pad_id=None).first().n == 5


def test_argmax_first_index_on_ties(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0],)], "p array<double>")
    assert [r[0] for r in df.select(me.argmax("p")).collect()] == [1, 0]


def test_hot_cold_lookup_equals_broadcast_lookup(spark):
    from tagflow.operators import vocab as vo
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), (F.col("id") % 97).cast("string"))).alias("tok"),
        "id")
    d = vo.word_vocab(df.where(F.col("id") < 4000)).withColumnRenamed("word", "tok")
    a = vo.encode(df, d, "tok", "tok", "word_id", 0)
    b = vo.encode(df, d, "tok", "tok", "word_id", 0, guard_bytes=0, hot_keys=10)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_early_stop_fixture(spark):
    from tagflow.operators.training import early_stop
    # F-H: 25 epochs, val_loss = |epoch-8|/16 + 1 -> best 8, stop 18 (patience 10)
    h = spark.createDataFrame([(e, abs(e - 8) / 16.0 + 1) for e in range(25)], "epoch int, val_loss double")
    r = early_stop(h).first()
    assert (r.best_epoch, r.stop_epoch) == (8, 18)
    never = spark.createDataFrame([(e, 10.0 - e) for e in range(30)], "epoch int, val_loss double")
    r = early_stop(never).first()
    assert (r.best_epoch, r.stop_epoch) == (29, None)
