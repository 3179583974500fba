"""The neural classifier: its gradient, its sums over tasks, and a saved model."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast.plans import neural
from holdfast.plans.neural import NeuralNet, Settings

SIZES = [4, 7]
SETTINGS = Settings(steps=60, hidden=(8, 5))


def data(n=300, seed=9):
    rng = np.random.default_rng(seed)
    numbers, codes = rng.normal(size=(n, 3)), np.stack([rng.integers(0, s, n) for s in SIZES], axis=1)
    odds = 2 * numbers[:, 0] + np.where(codes[:, 0] == 2, 3.0, -1.0)
    label = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    return numbers, codes, label, np.where(label == 1, 1.5, 0.75)


def frame(spark, numbers, codes, label, weight, held):
    rows = [(x.tolist(), c.tolist(), float(y), float(w), bool(h)) for x, c, y, w, h in zip(numbers, codes, label, weight, held)]
    return spark.createDataFrame(rows, "numbers array<double>, codes array<int>, label double, weight double, held_out boolean")


def test_gradient_equals_finite_differences():
    numbers, codes, label, weight = data(40)
    weights = neural.start_weights(3, SIZES, SETTINGS)
    weights = [w + 0.1 * np.random.default_rng(k).normal(size=w.shape) for k, w in enumerate(weights)]
    loss, gradient = neural.loss_and_gradient(weights, numbers, codes, label, weight)
    values, got = neural.flat(weights), neural.flat(gradient)
    for k in range(0, len(values), 3):
        up, down = values.copy(), values.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        near = [neural.loss_and_gradient(neural.shaped(v, weights), numbers, codes, label, weight)[0] for v in (up, down)]
        assert got[k] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-4)
    assert loss > 0


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_sums_over_tasks_equal_the_whole_batch(spark, parts):
    numbers, codes, label, weight = data()
    held = np.arange(300) % 10 == 0
    weights = neural.start_weights(3, SIZES, SETTINGS)
    sums = neural.summed(frame(spark, numbers, codes, label, weight, held).repartition(parts), weights)
    loss, gradient = neural.loss_and_gradient(weights, numbers[~held], codes[~held], label[~held], weight[~held])
    assert sums[0] == pytest.approx(loss) and sums[1] == pytest.approx(weight[~held].sum())
    assert sums[3] == pytest.approx(weight[held].sum()) and sums[2] > 0
    assert sums[4:] == pytest.approx(neural.flat(gradient), abs=1e-9)


def test_weighted_rows_count_as_copies_would():
    numbers, codes, label, _ = data(20)
    weights = neural.start_weights(3, SIZES, SETTINGS)
    one = neural.loss_and_gradient(weights, numbers, codes, label, np.full(20, 3.0))
    three = neural.loss_and_gradient(weights, np.tile(numbers, (3, 1)), np.tile(codes, (3, 1)), np.tile(label, 3), np.ones(60))
    assert one[0] == pytest.approx(three[0]) and neural.flat(one[1]) == pytest.approx(neural.flat(three[1]))


def test_training_learns_and_a_saved_model_scores_the_same(spark, tmp_path):
    numbers, codes, label, weight = data()
    df = frame(spark, numbers, codes, label, weight, np.arange(300) % 10 == 0)
    weights = neural.train(df, 3, SIZES, SETTINGS)
    p = 1 / (1 + np.exp(-neural.forward(weights, numbers, codes)[-1][:, 0]))
    assert ((p > 0.5) == (label == 1)).mean() > 0.8
    wide = df.select(
        *[F.col("numbers")[k].alias(f"x{k}") for k in range(3)], *[F.col("codes")[k].alias(f"c{k}") for k in range(2)]
    )
    model = PipelineModel([NeuralNet(["x0", "x1", "x2"], ["c0", "c1"], weights)])
    model.write().save(str(tmp_path / "m"))
    score = lambda m: [r["p"] for r in m.transform(wide).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert score(model) == pytest.approx(p.tolist()) and score(PipelineModel.load(str(tmp_path / "m"))) == score(model)


def test_no_rows_give_the_start(spark):
    df = frame(spark, *data(3), np.zeros(3, bool)).limit(0)
    got = neural.train(df, 3, SIZES, SETTINGS)
    assert neural.flat(got) == pytest.approx(neural.flat(neural.start_weights(3, SIZES, SETTINGS)))
