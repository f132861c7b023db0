"""The dense - ReLU - dense - softmax head against finite differences and plain SGD."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagflow.operators import relu_head as rh

SCHEMA = "vec_id long, embedding array<double>, label int"


def data(n=120, d=5, k=3, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d))
    return x, (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)


def test_gradients_are_those_of_finite_differences():
    x, y = data(20)
    head = rh.ReluHead.start(5, 7, 3)
    head.b1 += 0.01
    loss, g = head.gradients(x, y)
    for name in ("w1", "b1", "w2", "b2"):
        w, slope = getattr(head, name), getattr(g, name)
        for at in np.ndindex(w.shape):
            old = w[at]
            w[at] = old + 1e-6
            up = head.gradients(x, y)[0]
            w[at] = old
            assert abs((up - loss) / 1e-6 - slope[at]) < 1e-3


@pytest.mark.parametrize("partitions", [1, 7])
def test_steps_are_those_of_plain_sgd(spark, partitions):
    x, y = data()
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], SCHEMA).repartition(partitions)
    got, history = rh.fit(rows, 3, hidden=8, epochs=3, lr=0.2, batch_size=50)
    batch = {r.vec_id: r.b for r in rows.select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(0)), F.lit(3)).alias("b")).collect()}
    head, want = rh.ReluHead.start(5, 8, 3), []
    for _ in range(3):
        total = 0.0
        for b in range(3):
            own = [i for i in range(len(y)) if batch[i] == b]
            loss, g = head.gradients(x[own], y[own])
            total += loss
            head = head.moved(g, 0.2 / len(own))
        want.append(total / len(y))
    assert np.allclose(history, want) and np.allclose(got.w1, head.w1) and np.allclose(got.b2, head.b2) and np.allclose(got.w2, head.w2)


def test_it_learns_what_a_line_cant(spark):
    x, y = data(400)
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))] + [(1000, None, 0)], SCHEMA)
    head, history = rh.fit(rows, 3, hidden=64, epochs=40, lr=0.5, batch_size=200)
    out = rh.score(rows, head)
    right = out.where("vec_id < 1000").agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.85 and history[-1] < history[0] / 2 and out.where("pred is null").count() == 1


def test_empty(spark):
    head, history = rh.fit(spark.createDataFrame([], SCHEMA), 3, epochs=1)
    assert head.w2.shape == (128, 3) and history == [0.0]


def test_a_step_runs_on_the_partitions_of_its_batch_only(spark):
    x, y = data(200)
    rows = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], SCHEMA).toDF("_id", "_v", "_y")
    kept = rh.keep_batches(rows.withColumn("_b", F.pmod("_id", F.lit(4))), 4, 3)
    head = rh.ReluHead.start(5, 8, 3)
    assert kept.getNumPartitions() == 12 and kept.isCheckpointed()
    for b in range(4):
        loss, n, g = rh.batch_gradient(kept, head, range(3 * b, 3 * b + 3))
        want, h = head.gradients(x[b::4], y[b::4])
        assert n == 50 and abs(loss - want) < 1e-9 and np.allclose(g.w1, h.w1) and np.allclose(g.b2, h.b2)
