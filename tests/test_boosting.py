"""Boosted trees against a plain numpy version."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from holdfast.plans import boosting
from holdfast.plans.boosting import UNIT, Bins, Settings


def data(n=600, seed=4):
    rng = np.random.default_rng(seed)
    bins = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.integers(0, 5, n)], axis=1)
    odds = (bins[:, 0] > 6) * 1.5 - (bins[:, 2] == 3) * 2.0 + bins[:, 1] * 0.3
    label = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    weight = np.where(label == 1, 1.3, 0.8)
    return bins, label, weight, rng.random(n) < 0.1


IS_TEXT = np.array([False, False, True])
SETTINGS = Settings(rounds=12, patience=4, depth=3, rate=0.3, least_rows=10)


def plain(bins, label, weight, held, s):
    """One row at a time where it matters: every split tried on the rows themselves."""
    margin, trees, losses = np.zeros(len(label)), [], []

    def sums(rows):
        p = 1 / (1 + np.exp(-margin[rows]))
        g = np.rint(weight[rows] * (p - label[rows]) * UNIT).sum() / UNIT
        return g, np.rint(weight[rows] * p * (1 - p) * UNIT).sum() / UNIT

    def build(rows, depth):
        g, h = sums(rows)
        best = None
        if depth < s.depth:
            for k in range(bins.shape[1]):
                for cut in sorted(set(bins[rows, k])):
                    left = bins[rows, k] == cut if IS_TEXT[k] else bins[rows, k] <= cut
                    if min(left.sum(), (~left).sum()) < s.least_rows:
                        continue
                    (gl, hl), (gr, hr) = sums(rows[left]), sums(rows[~left])
                    gain = gl**2 / (hl + s.penalty) + gr**2 / (hr + s.penalty) - g**2 / (h + s.penalty)
                    if min(hl, hr) >= boosting.LEAST_CURVE and gain > 0 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, k, cut, rows[left], rows[~left])
        if best is None:
            return -s.rate * g / (h + s.penalty)
        return best[1], best[2], build(best[3], depth + 1), build(best[4], depth + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            k, cut, left, right = tree
            tree = left if (row[k] == cut if IS_TEXT[k] else row[k] <= cut) else right
        return tree

    fit = np.flatnonzero(~held)
    while len(trees) < s.rounds:
        signed = np.where(label[held] == 1, -margin[held], margin[held])
        losses.append((weight[held] * np.logaddexp(0, signed)).sum() / weight[held].sum())
        if boosting.stopped(losses, s.patience):
            break
        trees.append(build(fit, 0))
        margin = margin + np.array([value(trees[-1], row) for row in bins])
        if not isinstance(trees[-1], tuple):
            break
    return margin, len(trees), losses


def frame(spark, bins, label, weight, held):
    rows = [(b.tolist(), float(y), float(w), bool(o)) for b, y, w, o in zip(bins, label, weight, held)]
    return spark.createDataFrame(rows, "bins array<int>, label double, weight double, held_out boolean")


@pytest.mark.parametrize("every", [3, 100])
def test_trees_equal_the_plain_ones_however_rows_are_dealt(spark, monkeypatch, every):
    monkeypatch.setattr(boosting, "STAGE_EVERY", every)
    bins, label, weight, held = data()
    want, n_trees, losses = plain(bins, label, weight, held, SETTINGS)
    df = frame(spark, bins, label, weight, held).repartition(every % 5 + 1)
    trees, got_losses = boosting.grow(df, Bins({"a": [], "b": []}, ["c"]), 0.0, SETTINGS)
    assert len(trees) == n_trees
    assert sum(t.margins(bins, IS_TEXT) for t in trees) == pytest.approx(want, abs=1e-6)
    assert got_losses == pytest.approx(losses[: len(got_losses)], abs=1e-5)


def test_patience():
    assert not boosting.stopped([3, 2, 1], 2) and not boosting.stopped([1], 1)
    assert boosting.stopped([3, 1, 2, 2], 2) and not boosting.stopped([3, 1, 2, 0.5], 2)


def test_no_rows_and_one_class(spark):
    bins, label, weight, held = data(40)
    trees, losses = boosting.grow(frame(spark, bins, label, weight, held).limit(0), Bins({"a": [], "b": []}, ["c"]), 0.0, SETTINGS)
    assert len(trees) == 1 and losses == []
    alone = frame(spark, bins, np.ones(40), weight, np.zeros(40, bool))
    trees, losses = boosting.grow(alone, Bins({"a": [], "b": []}, ["c"]), 0.0, Settings(rounds=2))
    assert losses == [] and (sum(t.margins(bins, IS_TEXT) for t in trees) > 0).all()


def test_bins_and_a_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), None if i == 3 else i, i % 3) for i in range(50)], "x double, y int, c_code int")
    bins = boosting.fit_bins(df, ["x", "y"], ["c_code"])
    got = df.select("*", bins.column().alias("b")).collect()
    assert {(r["x"], r["b"][0]) for r in got} == {(float(k), k) for k in range(7)}
    assert all(r["b"][2] == r["c_code"] for r in got) and next(r for r in got if r["y"] is None)["b"][1] == 0
    tree = boosting.Tree()
    tree.value[1:] = []
    left, right = tree.split(0, 0, 3)
    tree.value[left], tree.value[right] = -1.0, 2.0
    model = PipelineModel([boosting.BoostedTrees(bins, 0.5, [tree, tree])])
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    p = lambda m: [tuple(r) for r in m.transform(df).select("x", vector_to_array("probability")[1].alias("p")).collect()]
    assert p(model) == p(again) and again.stages[0].getNumTrees == 2
    assert {(x, round(q, 9)) for x, q in p(model)} == {
        (float(k), round(1 / (1 + np.exp(-(0.5 + 2 * (-1.0 if k <= 3 else 2.0)))), 9)) for k in range(7)
    }


def test_a_level_sends_one_row_per_node_and_column(monkeypatch):
    """However many blocks a task reads (before: a row per bin and batch)."""
    bins, label, weight, held = data(400)
    rows = [
        boosting.pa.RecordBatch.from_pydict(
            {"bins": bins[i : i + 50].tolist(), "label": label[i : i + 50], "weight": weight[i : i + 50], "held_out": held[i : i + 50]}
        )
        for i in range(0, 400, 50)
    ]
    blocks = list(boosting._to_blocks(0.0)(iter(rows)))
    assert len(blocks) == 8
    run = lambda: list(boosting._histograms([], boosting.Tree(), [0], IS_TEXT, [11, 1, 4])(iter(blocks)))
    table = lambda: boosting.pa.Table.from_batches(run()).sort_by([("node", "ascending"), ("feature", "ascending"), ("part", "ascending")])
    found = table()
    assert found.column("node").to_pylist() == [boosting.LOSS, 0, 0, 0]
    best = boosting._best(SETTINGS, IS_TEXT)
    split = lambda t: boosting.pa.Table.from_batches(best(iter(t.to_batches(max_chunksize=1)))).to_pylist()
    want = split(found)
    # Lists in place of tables, and a text column in parts: the same best cut.
    monkeypatch.setattr(boosting, "DENSE", 0)
    assert split(table()) == want
    monkeypatch.setattr(boosting, "PART", 2)
    parts = [r for r in split(table()) if r["feature"] == 2]
    assert len(parts) == 3 and len({(r["g"], r["h"], r["n"]) for r in parts}) == 1
    assert max(r["gain"] or 0 for r in parts) == next(r["gain"] or 0 for r in want if r["feature"] == 2)


def test_an_uneven_tree_stops_at_its_depth(spark):
    """Its leaves on the lowest level have values (before: split once more, the children left at 0)."""
    x = np.repeat(np.arange(6), 100)
    label = np.concatenate([np.arange(100) < n for n in (100, 30, 10, 3, 1, 0)]).astype(float)
    bins = np.stack([x, np.zeros(600, int), np.zeros(600, int)], axis=1)
    s = Settings(rounds=1, depth=3, rate=0.3, least_rows=10, penalty=0.0)
    df = frame(spark, bins, label, np.ones(600), np.zeros(600, bool))
    trees, _ = boosting.grow(df, Bins({"a": [], "b": []}, ["c"]), 0.0, s)
    # One value is cut off a level; the last leaf holds the values 3, 4 and 5.
    assert trees[0].feature.count(0) == 3 and len(trees[0].feature) == 7
    assert len(set(trees[0].margins(bins, IS_TEXT))) == 4 and (trees[0].margins(bins, IS_TEXT) != 0).all()


@pytest.mark.parametrize("most_sums, move, cut", [(boosting.MOST_SUMS, 1, 2), (boosting.MOST_SUMS, 2, 100), (0, 1, 1)])
def test_trees_by_sums_or_by_shuffles_equal_the_plain_ones(spark, monkeypatch, most_sums, move, cut):
    """Also with a column that repeats another one, and with chunks of few rows."""
    for name, value in {"MOST_SUMS": most_sums, "MOVE_EVERY": move, "CUT_EVERY": cut, "CHUNK": 50}.items():
        monkeypatch.setattr(boosting, name, value)
    bins, label, weight, held = data(500, 5)
    want, n_trees, losses = plain(bins, label, weight, held, SETTINGS)
    twice = np.stack([bins[:, 0], bins[:, 0], bins[:, 1], bins[:, 2]], axis=1)
    df = frame(spark, twice, label, weight, held)
    trees, got_losses = boosting.grow(df, Bins({"a": [], "b": [], "c": []}, ["d"]), 0.0, SETTINGS)
    assert len(trees) == n_trees and not any(1 in t.feature for t in trees)
    assert sum(t.margins(twice, np.array([False, False, False, True])) for t in trees) == pytest.approx(want, abs=1e-6)
    assert got_losses == pytest.approx(losses[: len(got_losses)], abs=1e-5)


def test_a_level_is_one_job_of_one_stage(spark):
    """However many trees (before: two jobs with a shuffle between them)."""
    bins, label, weight, held = data(400)
    df = frame(spark, bins, label, weight, held)
    track, found = spark.sparkContext.statusTracker(), []
    for rounds in (1, 3):
        group = f"grow-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        boosting.grow(df, Bins({"a": [], "b": []}, ["c"]), 0.0, Settings(rounds=rounds, depth=3, least_rows=5))
        found.append([len(track.getJobInfo(j).stageIds) for j in track.getJobIdsForGroup(group)])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    one, three = found
    assert len(three) == len(one) + 2 * 3
    assert sorted(three) == sorted([*one, *[1] * 6])


def test_columns_of_few_bins_share_a_key():
    rng = np.random.default_rng(3)
    most = [1, 254, 4, 9, 2, 300]
    bins = np.stack([rng.integers(0, m + 1, 400) for m in most])
    text = np.array([False, False, False, False, True, True])
    keys = boosting._Keys.of(list(range(6)), most, text)
    assert [sorted(g) for g in keys.groups] == [[0, 2, 4], [3], [1], [5]]
    made = keys.of_bins(bins)
    assert all(int(m.max()) < keys.width(g) for m, g in zip(made, keys.groups))
    goes = keys.goes_left(made)
    some = np.array([3, 77, 399])
    for k in range(6):
        for cut in (0, 1, 2):
            want = bins[k] == cut if text[k] else bins[k] <= cut
            assert (goes(k, cut, None) == want).all() and (goes(k, cut, some) == want[some]).all()


def test_borders_are_the_exact_values_at_the_parts(spark):
    rng = np.random.default_rng(6)
    table = {"wide": rng.normal(size=3000), "few": rng.integers(0, 4, 3000) * 1.5, "same": np.full(3000, 2.0)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in table.values()))), list(table)).repartition(5)
    got = boosting.fit_bins(df, list(table), [])
    for name, values in table.items():
        ranked = np.sort(values)
        at = [-(-3000 * i // boosting.MOST_BINS) - 1 for i in range(1, boosting.MOST_BINS)]
        assert got.borders[name] == sorted({ranked[i] for i in at} - {ranked[0]})
    assert len(got.borders["wide"]) == 254 and got.borders["same"] == []
    assert boosting.fit_bins(df.limit(0), list(table), []).borders == {"wide": [], "few": [], "same": []}
