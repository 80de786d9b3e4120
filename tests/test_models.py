import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from eventloom.contracts import LABEL, REDTEAM_NOW
from eventloom.operators import export, forest, metrics, model, prepare
from eventloom.operators.split import time_cuts, time_split
from eventloom.sources.tables import stage


def _scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_binary_metrics(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.2), (0, 1, 0.8), (0, 0, 0.1), (1, 1, 0.7)]
    assert tuple(metrics.binary_metrics(_scored(spark, rows)).first()) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert tuple(metrics.binary_metrics(_scored(spark, [(0, 0, 0.1)])).first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.binary_metrics(_scored(spark, [])).first()) == (0.0, 0.0, 0.0)


def _brute(labels, scores):
    """Pairs won (ties half), and precision summed over recall steps."""
    p, n = labels == 1, labels == 0
    wins = (scores[p][:, None] > scores[n][None, :]).sum() + 0.5 * (scores[p][:, None] == scores[n][None, :]).sum()
    ap, before = 0.0, 0.0
    for s in sorted(set(scores), reverse=True):
        chosen = scores >= s
        recall = (chosen & p).sum() / p.sum()
        ap += (recall - before) * (chosen & p).sum() / chosen.sum()
        before = recall
    return wins / (p.sum() * n.sum()), ap


def test_ranking_metrics_with_ties_equal_brute_force(spark):
    random = np.random.default_rng(5)
    labels, scores = (random.random(700) < 0.2).astype(int), np.round(random.random(700) ** 3, 2)
    scores[:250] = 0.5  # a third of the rows share one score
    row = metrics.ranking_metrics(_scored(spark, [(int(a), 0, float(s)) for a, s in zip(labels, scores)])).first()
    assert (row.roc_auc, row.average_precision) == pytest.approx(_brute(labels, scores))


def test_ranking_metrics_need_both_classes(spark):
    assert tuple(metrics.ranking_metrics(_scored(spark, [(0, 0, 0.1), (0, 0, 0.2)])).first()) == (None, None)
    assert tuple(metrics.ranking_metrics(_scored(spark, [])).first()) == (None, None)


def test_classification_report(spark):
    rows = {r["class"]: r for r in metrics.classification_report(_scored(spark, [(1, 1, 0.0)] * 2 + [(0, 1, 0.0), (2, 0, 0.0)])).collect()}
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["1"].recall == 1.0 and rows["1"].support == 2
    assert (rows["2"].precision, rows["2"].f1, rows["2"].support) == (0.0, 0.0, 1)
    assert rows["accuracy"].f1 == 0.5 and rows["accuracy"].precision is None
    assert rows["macro avg"].recall == pytest.approx(1 / 3) and rows["weighted avg"].recall == pytest.approx(0.5)
    assert rows["weighted avg"].support == 4


def _windows(spark, windows):
    return spark.createDataFrame([(w,) for w in windows], "time_window bigint")


@pytest.mark.parametrize("n", [5, 6, 10, 33])
def test_cuts(spark, n):
    windows = [w * w for w in range(n)]
    cuts = time_cuts(_windows(spark, windows * 2 + [None]))
    assert (cuts.windows, cuts.train, cuts.valid) == (n, windows[int(n * 0.6)], windows[int(n * 0.8)])


def test_split_is_ordered_in_time(spark):
    parts = time_split(_windows(spark, [*range(5), None]))
    got = [(r.time_window, r.split) for r in parts.collect()]
    assert got == [(0, "train"), (1, "train"), (2, "train"), (3, "train"), (4, "valid"), (None, None)]


def test_too_few_windows(spark):
    with pytest.raises(ValueError, match="too few"):
        time_cuts(_windows(spark, range(4)))


def test_medians_take_the_midpoint_and_leave_out_empty_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (None, None, 5.0)], "a bigint, b double, c double")
    assert prepare.medians(df, ["a", "b", "c"]) == {"a": 1.5, "c": 3.0}
    assert [tuple(r) for r in prepare.impute_median(df, ["a", "b", "c"]).collect()] == [(1.0, 1.0), (2.0, 3.0), (1.5, 5.0)]


def test_medians_from_a_sketch_are_close(spark):
    df = spark.range(9999).selectExpr("id AS a", "cast(NULL AS double) AS b")
    found = prepare.medians(df, ["a", "b"], exact=False)
    assert list(found) == ["a"] and abs(found["a"] - 4999) < 20


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 4), (3.0, 4)], "a double, b int")
    assert [tuple(r) for r in prepare.standardise(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], f"{LABEL} int")
    assert {r.label: r.weight for r in prepare.class_weights(df).collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    weights = [r[0] for r in df.select(prepare.weight_column(df)).collect()]
    assert weights == pytest.approx([2.0, 4 / 6, 4 / 6, 4 / 6])


@pytest.fixture(scope="module")
def training(spark):
    random = np.random.default_rng(11)
    x = random.normal(size=(400, 2)) * [1.0, 50.0]
    y = (x[:, 0] + x[:, 1] / 50 + random.normal(size=400) > 1.2).astype(int)
    rows = [(float(a) if i % 9 else None, float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"a double, b double, {LABEL} int"), rows


def test_logistic_regression_minimises_the_weighted_penalised_loss(training):
    df, rows = training
    fitted = model.fit(df, prepare.fit_preparation(df, ["a", "b"]), model.logistic_regression(len(rows)))
    known = np.median([r[0] for r in rows if r[0] is not None])
    x = np.array([[known if r[0] is None else r[0], r[1]] for r in rows])
    y = np.array([r[2] for r in rows])
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    weight = len(y) / (2 * np.bincount(y))[y]
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):  # Newton steps on 0.5 |w|^2 + sum of weighted losses
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    estimate = fitted.stages[-1]
    assert [*estimate.coefficients, estimate.intercept] == pytest.approx(w.tolist(), abs=1e-3)


def test_stored_pipelines_know_their_inputs_and_score_incomplete_rows(spark, training, tmp_path):
    df, rows = training
    fitted = model.fit(df, prepare.fit_preparation(df, ["a", "b"]), model.random_forest(trees=5, depth=3))
    path = str(tmp_path / "forest")
    fitted.write().overwrite().save(path)
    loaded = model.PipelineModel.load(path)
    assert model.feature_names(loaded) == ["a", "b"]
    given = spark.createDataFrame([(0, 1.0), (1, None)], "id int, b double")
    scored = model.score(given, loaded, model.FOREST, ["id"]).orderBy("id").collect()
    assert scored[0].asDict().keys() == {"id", "prediction", model.PROBABILITY, "model_name"}
    filled = spark.createDataFrame([(0, 0.0, 1.0), (1, 0.0, float(np.median([r[1] for r in rows])))], "id int, a double, b double")
    same = model.score(filled, loaded, model.FOREST, ["id"]).orderBy("id").collect()
    assert [r[model.PROBABILITY] for r in scored] == [r[model.PROBABILITY] for r in same]
    assert all((r.prediction == 1) == (r[model.PROBABILITY] > 0.5) for r in scored)


def test_a_forest_keeps_the_nodes_of_rows_and_is_fitted_on_even_parts():
    assert model.random_forest(3, 4).getCacheNodeIds()
    assert [model._parts(12, rows) for rows in (0, 10, 12 * model.PART_ROWS, 12 * model.PART_ROWS + 1)] == [12, 12, 12, 24]


def test_leaking_inputs_are_refused(training):
    with pytest.raises(ValueError, match="red-team"):
        model.fit(training[0], prepare.Preparation({REDTEAM_NOW[0]: 0.0}, {}, {}), model.random_forest(1))


def test_best_model_wins_ties_by_order(spark):
    rows = [("a", 0, "valid", "f1", 0.5), ("b", 1, "valid", "f1", 0.5), ("c", 2, "test", "f1", 0.9), ("d", 3, "valid", "recall", 1.0)]
    df = spark.createDataFrame(rows, "model string, position int, split string, metric string, value double")
    assert model.select_best(df).first().model == "a"


def test_the_exported_sql_scores_like_the_pipeline(spark):
    random = np.random.default_rng(8)
    rows = [(float(a), None if i % 7 == 0 else float(b), int(a + b + random.normal() > 1)) for i, (a, b) in enumerate(random.normal(size=(400, 2)))]
    train = stage(spark.createDataFrame(rows, f"a double, b double, {LABEL} int"), "train")
    prepared = prepare.fit_preparation(train, ["a", "b"])
    fitted = model.fit(train, prepared, model.logistic_regression(train.count()))
    train.createOrReplaceTempView("some_rows")
    exported = {(r.a, r.b): r.probability for r in spark.sql(export.score_sql(fitted, "some_rows")).collect()}
    scored = model.score(train.drop(LABEL), fitted, "m", ["a", "b"]).collect()
    assert all(exported[r.a, r.b] == pytest.approx(r[model.PROBABILITY], abs=1e-12) for r in scored)
    found = {r.input: r.gradient for r in export.gradient(train, fitted).collect()}
    assert set(found) == {"a", "b", "(intercept)"} and max(map(abs, found.values())) < 1e-5
    loose = model.fit(train, prepared, model.logistic_regression(train.count(), tolerance=0.5).setMaxIter(1))
    assert max(abs(r.gradient) for r in export.gradient(train, loose).collect()) > 1e-3  # a fit that has not ended is seen
    with pytest.raises(TypeError):
        export.coefficients(model.fit(train, prepared, model.random_forest(2, 2)))


def test_no_node_with_few_rows_is_split_and_scores_are_those_of_a_plain_walk(spark, tmp_path):
    random = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a * b + random.normal() > 0)) for a, b in random.normal(size=(300, 2))]
    train = stage(spark.createDataFrame(rows, f"a double, b double, {LABEL} int"), "train")
    prepared = prepare.fit_preparation(train, ["a", "b"])
    fitted = model.fit(train, prepared, model.random_forest(5, 20))
    fitted.write().save(str(tmp_path / "forest"))
    nodes = {(r.tree, r.node): r for r in model.forest_nodes(spark, str(tmp_path / "forest")).collect()}
    assert all(r.rows >= model.SPLIT_ROWS for r in nodes.values() if r.left >= 0)
    small = F.expr("left >= 0 AND rows < 40")
    assert model.forest_nodes(spark, str(tmp_path / "forest")).filter(small).count() > 0
    model.undo_small_splits(spark, str(tmp_path / "forest"), 40)
    assert model.forest_nodes(spark, str(tmp_path / "forest")).filter(small).count() == 0
    fitted = PipelineModel.load(str(tmp_path / "forest"))
    nodes = {(r.tree, r.node): r for r in model.forest_nodes(spark, str(tmp_path / "forest")).collect()}
    for r in export.prepared_rows(train, fitted).join(model.predict(train, fitted, ["a", "b"]), ["a", "b"]).collect():
        point, votes = [r.prepared_a, r.prepared_b], []
        for tree in range(5):
            at = nodes[tree, 0]
            while at.left >= 0:
                at = nodes[tree, at.left if point[at.feature] <= at.threshold else at.right]
            votes.append(at.stats[1] / sum(at.stats))
        assert r.score == pytest.approx(np.mean(votes), abs=1e-12)


def _best_by_hand(x, y, cuts, weights, least):
    """Highest gain of any split of one node, by plain sums over rows."""
    def side(rows):
        w = np.array([weights[0] * (y[rows] == 0).sum(), weights[1] * (y[rows] == 1).sum()])
        return len(y[rows]), w.sum(), 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0

    _, whole, impurity = side(np.full(len(y), True))
    found = []
    for i, cut in enumerate(cuts):
        for b, c in enumerate(cut):
            (n, w, g), (m, v, h) = side(x[:, i] <= c), side(x[:, i] > c)
            if min(n, m) >= least:
                found.append((impurity - w / whole * g - v / whole * h, i, b))
    return max(found)


def test_a_grown_tree_takes_the_best_splits_and_counts_every_drawn_row():
    random = np.random.default_rng(4)
    x = random.normal(size=(500, 1))
    y = (x[:, 0] + random.normal(size=500) > 0.8).astype(np.int8)
    cuts = [np.quantile(x[:, 0], np.arange(1, 32) / 32)]
    bins = np.searchsorted(cuts[0], x).astype(np.uint8)
    rules = forest.Rules(trees=1, depth=30, bins=32, leaf_rows=2, split_rows=5, weights=(0.7, 3.0), seed=1)
    tree = forest.grow(bins, y, np.arange(500), 0, rules)
    drawn = np.random.default_rng([1, 0]).poisson(1.0, 500)
    inside, checked = {0: np.repeat(np.arange(500), drawn)}, 0
    for i in range(len(tree.left)):
        rows = inside[i]
        assert tree.counts[:, i].tolist() == [(y[rows] == 0).sum(), (y[rows] == 1).sum()]
        if tree.left[i] >= 0:
            gain, _, split = _best_by_hand(x[rows], y[rows], cuts, rules.weights, 2)
            assert tree.gain[i] == pytest.approx(gain) and gain > 0
            goes = bins[rows, 0] <= tree.split[i]
            inside[tree.left[i]], inside[tree.right[i]] = rows[goes], rows[~goes]
            checked += 1
    assert checked > 10
    done = forest._finished(tree, rules)
    inner = done.left >= 0
    assert (done.counts.sum(axis=0)[inner] >= 5).all() and 1 < inner.sum() <= checked
    pairs = [(done.left[i], done.right[i]) for i in np.flatnonzero(inner)]
    of = forest._classes(done, rules)
    few = done.counts.sum(axis=0) < 5  # leaves that were split before
    assert all(of[a] != of[b] for a, b in pairs if done.left[a] < 0 and done.left[b] < 0 and not few[a] and not few[b])
    assert sorted(n for p in pairs for n in p) == list(range(1, len(done.left)))  # every node but the root has one parent


def test_nodes_in_slices_give_the_same_tree(monkeypatch):
    random = np.random.default_rng(6)
    bins = random.integers(0, 32, (900, 5)).astype(np.uint8)
    y = (random.random(900) < 0.3).astype(np.int8)
    rules = forest.Rules(1, 30, 32, 2, 5, (1.0, 2.0), 7)
    whole = forest.grow(bins, y, np.arange(900), 3, rules)
    monkeypatch.setattr(forest, "NODES", 3)
    monkeypatch.setattr(forest, "SLICE", 11)
    sliced = forest.grow(bins, y, np.arange(900), 3, rules)
    assert whole.left.tolist() == sliced.left.tolist() and whole.split.tolist() == sliced.split.tolist()


def test_cuts_of_bins_are_the_engines():
    import pandas as pd

    def cuts(values, bins=4):
        return forest._cut_points(pd.DataFrame({"input": 0, "value": np.array(values, float), "weight": 1.0}), bins).cuts[0]

    assert cuts([5, 5, 5]) == [] and cuts([1, 2, 2, 4]) == [1.5, 3.0]
    assert cuts(range(8)) == [1.5, 3.5, 5.5]
    assert cuts([0] * 90 + list(range(1, 11))) == [0.5, 1.5, 2.5]  # a common value leaves cuts for the others


def test_points_keep_every_weight_and_nearly_every_rank():
    import pyarrow as pa

    values = np.random.default_rng(2).lognormal(size=(30_000, 2))
    batches = [pa.record_batch({"x": pa.array(list(values[i : i + 7000])), "weight": np.ones(len(values[i : i + 7000]))}) for i in range(0, 30_000, 7000)]
    parts = [p.to_pandas() for p in forest._points(iter(batches), 2)]
    for i, part in enumerate(parts):
        assert len(part) <= forest.POINTS + 1 and part.weight.sum() == pytest.approx(30_000)
        ranks = np.searchsorted(np.sort(values[:, i]), part.value, side="right")
        assert abs(part.weight.cumsum() - ranks).max() <= 30_000 / forest.POINTS * 2


def test_a_forest_hangs_on_its_rows_only_and_all_of_them_are_in_every_tree(spark, training, tmp_path):
    df, rows = training
    prepared = prepare.fit_preparation(df, ["a", "b"])
    tables = []
    for n, parts in enumerate((1, 3)):
        model.fit(df.repartition(parts), prepared, model.random_forest(4, 30), path=str(tmp_path / str(n)))
        nodes = model.forest_nodes(spark, str(tmp_path / str(n)))
        tables.append(sorted(tuple(map(str, r)) for r in nodes.collect()))
    assert tables[0] == tables[1]
    roots = [r.rows for r in nodes.filter("node = 0").collect()]
    assert len(roots) == 4 and all(abs(n - len(rows)) < 6 * len(rows) ** 0.5 for n in roots)


def test_more_rows_than_a_task_may_hold_go_to_the_engine(spark, training, monkeypatch):
    df, _ = training
    prepared = prepare.fit_preparation(df, ["a", "b"])
    rows = df.select("a", "b", F.col(LABEL).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    assert model._held_rules(rows, prepared, model.random_forest(3, 4)).trees == 3
    assert model._held_rules(rows.filter("label = 0"), prepared, model.random_forest(3, 4)) is None
    monkeypatch.setattr(forest, "HELD_BYTES", 700)
    assert model._held_rules(rows, prepared, model.random_forest(3, 4)) is None
    assert model.fit(df, prepared, model.random_forest(3, 4)).stages[-1].getNumTrees == 3


def test_inputs_that_are_no_numbers_are_refused(spark, training):
    df, _ = training
    prepared = prepare.fit_preparation(df, ["a", "b"])
    with pytest.raises(Exception, match="not a number"):
        model.fit(df.withColumn("b", F.lit(float("nan"))), prepared, model.random_forest(2, 2))
