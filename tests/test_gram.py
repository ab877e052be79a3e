"""Gram-matrix candidates against plain per-fold preparation and closed forms."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import estimators, gram, metrics
from ledgerline.operators.preprocess import FeatureSet, fit_preparation

SET = FeatureSet(["size"], ["age", "flag", "none"], ["kind", "code"])


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    out = []
    for c in range(90):
        for year in range(2012, 2016 + c % 3):
            size, age = rng.lognormvariate(3, 1), rng.uniform(0, 30)
            kind, code = rng.choice(["a", "b", None]), f"k{c % 9}"
            money = np.expm1(1.0 + 0.8 * np.log1p(size) - 0.02 * age + (kind == "a") + 0.1 * (c % 9) + rng.gauss(0, 0.3))
            out.append((
                "m1" if c % 3 else "m2", f"c{c}", year, "space" if c % 10 else "adjacent", size if rng.random() < 0.8 else None,
                age if rng.random() < 0.9 else float("nan"), float(c % 2), kind, code, float(money), 1.0 / (1 + c % 4),
            ))
    fields = "mission string, company_id string, target_year int, population_type string, size double, age double, flag double, kind string, code string, money double, w double"
    return spark.createDataFrame(out, fields).withColumn("none", F.lit(None).cast("double")).repartition(5).cache()


def training(cells_df, cells):
    return cells_df.filter(F.exists("cells", lambda c: c.isin(*cells)))


def plain_fit(train, features, model, params, weight):
    """Coefficients by iteration on the scaled training matrix of the plain preparation."""
    prepared = fit_preparation(train.withColumn("age", F.nanvl("age", F.lit(None))), features)
    out = train.withColumn("age", F.nanvl("age", F.lit(None)))
    for stage in prepared.stages(True):
        out = stage.transform(out)
    got = out.select("features", F.log1p("money").alias("y"), F.lit(1.0).alias("w") if weight is None else F.col(weight).alias("w")).collect()
    x, y, w = np.array([r["features"].toArray() for r in got]), np.array([r["y"] for r in got]), np.array([r["w"] for r in got])
    mean_x, mean_y = (w @ x / w.sum(), w @ y / w.sum()) if params.get("intercept", True) else (0 * x[0], 0.0)
    a, b = x - mean_x, y - mean_y
    if model == "Linear Regression":
        root = np.sqrt(w)
        beta = np.linalg.lstsq(a * root[:, None], b * root, rcond=1e-9)[0]
    elif model == "Ridge":
        beta = np.linalg.solve((a * w[:, None]).T @ a + params["alpha"] * np.eye(a.shape[1]), (a * w[:, None]).T @ b)
    else:
        ratio, total = params.get("ratio", 1.0), w.sum()
        l1, l2 = params["alpha"] * ratio, params["alpha"] * (1 - ratio)
        g, c, beta = (a * w[:, None]).T @ a / total, (a * w[:, None]).T @ b / total, np.zeros(a.shape[1])
        for _ in range(2000):
            for j in np.flatnonzero(np.diag(g) > 1e-12):
                pull = c[j] - g[j] @ beta + g[j, j] * beta[j]
                beta[j] = np.sign(pull) * max(abs(pull) - l1, 0) / (g[j, j] + l2)
    return lambda test: np.array([r["features"].toArray() for r in _stages(prepared, test)]) @ beta + mean_y - mean_x @ beta


def _stages(prepared, df):
    df = df.withColumn("age", F.nanvl("age", F.lit(None)))
    for stage in prepared.stages(True):
        df = stage.transform(df)
    return df.orderBy("company_id", "target_year").collect()


@pytest.mark.parametrize("features", [SET, FeatureSet(SET.log, SET.plain, SET.categories, None)])
def test_fits_equal_those_on_the_training_rows(rows, features):
    """Medians, scaling, rare categories and penalties of an inner training set, from sums over cells."""
    mine, outers = gram.grouped_cells(rows, "mission", k=3, repeats=2, inner=2)
    mine = mine.cache()
    basis = gram.basis_of(mine, features)
    ready = gram._ready(mine, basis, F.col("mission"), "money", "w", ["company_id", "target_year"])
    fits = gram.fit_all(ready, basis, outers, gram.LINEAR)
    assert len(outers) == 6 and all(len(f) == 6 * 19 for f in fits.refits.values()) and all(len(f) == 12 * 19 for f in fits.tuning.values())
    one = mine.filter("mission = 'm1'")
    outer, inner = outers[4], outers[4].inner[1]
    test = one.filter("company_id = 'c7' or company_id = 'c11'")
    batch = gram._ready(test.orderBy("company_id", "target_year"), basis, F.col("mission"), "money", "w", []).toArrow().combine_chunks().to_batches()[0]
    matrix = basis.matrix(batch)
    for cells, betas in ((outer.train, {(m, i): b for (o, m, i), b in fits.refits["m1"].items() if o == 4}),
                         (inner[0], {(m, i): b for (o, n, m, i), b in fits.tuning["m1"].items() if (o, n) == (4, 1)})):
        train = training(one, cells)
        for model, i in (("Linear Regression", 0), ("Linear Regression", 1), ("Ridge", 2), ("Lasso", 0), ("Elastic Net", 4)):
            want = plain_fit(train, features, model, gram.LINEAR[model][i], "w")(test)
            tolerance = 0.02 if i == 1 and model == "Linear Regression" else 1e-5  # a constant column is centred here
            assert matrix @ betas[model, i] == pytest.approx(want, abs=tolerance)


def test_ridge_equals_the_pipeline(rows):
    """The same fold through Spark's own regression."""
    mine, outers = gram.grouped_cells(rows, "mission", k=3, repeats=1, inner=1)
    mine = mine.withColumn("age", F.nanvl("age", F.lit(None))).cache()
    scored = gram.out_of_fold(mine, outers, {"Ridge": [{"alpha": 10.0}]}, SET, "money", "w", ["company_id", "target_year"], F.col("mission"))
    got = {(r["company_id"], r["target_year"]): r for r in scored.collect()}
    assert len(got) == mine.filter("population_type = 'space'").count()
    for r in got.values():
        assert json.loads(r["best_params"]) == {"alpha": 10.0} and r["n_train_companies"] > 10
    one = mine.filter("mission = 'm2'")
    train, test = training(one, outers[1].train), training(one, outers[1].test)
    model = estimators.fit_one(train, fit_preparation(train, SET), "Ridge", estimators.MODELS["Ridge"], {"alpha": 10.0}, "money", "w")
    for r in model.transform(test).collect():
        assert got[r["company_id"], r["target_year"]]["predicted"] == pytest.approx(r["predicted"], rel=5e-3)  # its penalty is scaled by an estimated deviation


def test_medians_of_all_training_sets(rows, monkeypatch):
    monkeypatch.setattr(gram, "GRID", 8)
    mine, outers = gram.grouped_cells(rows, "mission", k=4, repeats=2, inner=2)
    sets = list(dict.fromkeys(s for o in outers for s in o.sets()))
    basis = gram.basis_of(mine, SET)
    ready = gram._ready(mine, basis, F.col("mission"), "money", "w", []).cache()
    found = gram.set_medians(ready, SET.numeric, sets)
    local = ready.toPandas()
    for name, medians in found.items():
        for s in (0, 5, len(sets) - 1):
            own = local[(local["grp"] == name) & [bool(set(c) & set(sets[s])) for c in local["cells"]]]
            want = [own[f].median() for f in SET.numeric]
            assert medians[s] == pytest.approx(want, nan_ok=True)


def test_tuning_and_folds(rows, spark):
    """Each space row is held out once a repeat; the chosen setting has the lowest inner error."""
    mine, outers = gram.grouped_cells(rows, "mission", k=3, repeats=2, inner=2)
    mine = mine.cache()
    models = {"Ridge": [{"alpha": 1e7}, {"alpha": 0.1}], "Lasso": [{"alpha": 50.0}, {"alpha": 0.001}]}
    scored = gram.out_of_fold(mine, outers, models, SET, "money", "w", ["company_id", "target_year", "mission"], F.col("mission")).cache()
    held = scored.groupBy("Model", "company_id", "target_year").count()
    assert held.filter("count <> 2").count() == 0 and held.count() == 2 * mine.filter("population_type = 'space'").count()
    assert {json.loads(r[0])["alpha"] for r in scored.select("best_params").distinct().collect()} == {0.1, 0.001}
    companies = mine.filter("mission = 'm1'").select("company_id", "population_type").distinct().collect()
    want = sum(r["population_type"] != "space" for r in companies) + sum(r["population_type"] == "space" for r in companies) * 2 / 3
    sizes = [r[0] for r in scored.filter("mission = 'm1'").select("n_train_companies").distinct().collect()]
    assert all(abs(n - want) <= 1 for n in sizes)
    with pytest.raises(ValueError):
        gram.MOST_COLUMNS, before = 3, gram.MOST_COLUMNS
        try:
            gram.basis_of(mine, SET)
        finally:
            gram.MOST_COLUMNS = before


def test_yearly_cells(rows):
    mine, outers = gram.yearly_cells(rows, cutoffs=[2011, 2013, 2014, 2030], offsets=[1])
    assert [o.labels["cutoff_year"] for o in outers] == [2013, 2014]
    scored = gram.out_of_fold(mine, outers, gram.FORECAST_LINEAR, SET, "money", None, ["company_id", "target_year"], F.col("mission")).cache()
    assert scored.filter("target_year <= cutoff_year").count() == 0
    assert scored.count() == 4 * sum(mine.filter(F.col("target_year") > c).count() for c in (2013, 2014))
    error = scored.groupBy("Model").agg(F.avg(F.abs(F.log1p("actual") - F.log1p("predicted"))).alias("e")).collect()
    assert all(r["e"] < 0.6 for r in error)


def test_descent_solves_each_problem_alone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[:, 4] = 0
    y = x @ [1.0, -2.0, 0.0, 0.5, 0.0] + rng.normal(size=60)
    g, c = x.T @ x / 60, x.T @ y / 60
    l1, l2 = np.array([0.0, 0.3, 5.0]), np.array([0.0, 0.2, 0.0])
    found = gram.descend(np.stack([g] * 3), np.stack([c] * 3), l1, l2)
    assert found[0] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-6)
    slope = c - g @ found[1] - 0.2 * found[1]
    assert all(abs(s) <= 0.3 + 1e-6 for s in slope) and slope[found[1] != 0] == pytest.approx(0.3 * np.sign(found[1][found[1] != 0]), abs=1e-6)
    assert not found[2].any()


def test_moments_give_the_metrics_of_the_predictions(rows, monkeypatch):
    """Fold scores come from a few sums a task; no held-out prediction is stored for them."""
    mine, outers = gram.grouped_cells(rows, "mission", k=3, repeats=2, inner=2)
    mine = mine.cache()
    models = {"Ridge": [{"alpha": 10.0}, {"alpha": 0.1}], "Lasso": [{"alpha": 0.001}]}
    stored = {}
    monkeypatch.setattr(gram, "written", lambda df, name: stored.setdefault(name, df.cache()))
    bake = gram.bake_off(mine, outers, models, SET, "money", "w", ["company_id", "target_year", "mission"], F.col("mission"))
    keys = ["mission", "target_year", "repeat", "fold", "Model"]
    got = {tuple(r[k] for k in keys): r for r in metrics.metrics_of_moments(bake.moments(["mission", "target_year"]), keys).collect()}
    assert set(stored) == {"gram-rows", "moments"}
    scored = gram.out_of_fold(mine, outers, models, SET, "money", "w", ["company_id", "target_year", "mission"], F.col("mission")).cache()
    want = metrics.weighted_metrics(scored, keys, "actual", "predicted", "weight").collect()
    assert len(want) == len(got) > 50
    for r in want:
        own = got[tuple(r[k] for k in keys)]
        assert own["n_test_rows"] == r["n_test_rows"] and (own["MAE"], own["RMSE"], own["R2"]) == pytest.approx((r["MAE"], r["RMSE"], r["R2"]), rel=1e-9)
    one = bake.predictions({"m1": "Lasso"})
    assert one.count() == scored.filter("mission = 'm1' and Model = 'Lasso'").count() == one.filter("Model = 'Lasso'").count() > 0


def test_equal_labels_have_no_spread(spark):
    parts = [(0.3, 3), (0.7, 5), (1.1, 1)]
    table = [("a", n, n * w, 0.1, 0.0, 0.1, 0.1, 1.0, 1.0) for w, n in parts]
    found = metrics.metrics_of_moments(spark.createDataFrame(table, "g string, n long, w double, mean double, around double, low double, high double, off double, squares double"), ["g"])
    assert found.first()["R2"] == 0.0 and found.first()["n_test_rows"] == 9


def test_medians_count_equal_values_in_the_task(spark, monkeypatch):
    """A feature of two values leaves a task as two counts a cell, not as a row for every row and cell."""
    sent = []
    plain = type(spark.range(1)).groupBy

    def watched(df, *by):
        if by == ("grp", "feature", "range", "cell", "value"):
            sent.append(df.count())
        return plain(df, *by)

    monkeypatch.setattr(type(spark.range(1)), "groupBy", watched)
    flags = spark.range(4000).select(F.lit("g").alias("grp"), F.array((F.col("id") % 4).cast("int"), F.lit(9)).alias("cells"), (F.col("id") % 2).cast("double").alias("flag")).repartition(2)
    found = gram.set_medians(flags, ["flag"], [(0, 1), (0,), (1, 3), (9,)])
    assert found["g"][:, 0].tolist() == [0.5, 0.0, 1.0, 0.5]
    assert sent and sent[0] <= 2 * 5 * 2


@pytest.mark.parametrize("yearly", [False, True])
def test_final_fits_need_no_sums_of_their_own(rows, monkeypatch, yearly):
    """The refit on all rows comes from the folds' matrices and equals one made from its own."""
    models = {"Ridge": [{"alpha": 1e6}, {"alpha": 0.1}], "Lasso": [{"alpha": 5.0}, {"alpha": 0.001}]}
    keep = ["company_id", "target_year", "mission"]
    own, weight = ("target_year", None) if yearly else ("mission", "w")
    plain = gram.whole_yearly(rows) if yearly else gram.whole_grouped(rows, "mission")
    want = gram.fit_final(*plain, models, SET, "money", weight, F.col("mission"))
    cut, outers = gram.yearly_cells(rows, cutoffs=[2013, 2014]) if yearly else gram.grouped_cells(rows, own)
    whole = gram.whole_of_yearly(rows) if yearly else gram.whole_of_grouped()
    alone = gram.bake_off(cut, outers, models, SET, "money", weight, keep, F.col("mission"))
    calls = []
    sums = gram.summed_by_cell
    monkeypatch.setattr(gram, "summed_by_cell", lambda *a: calls.append(a) or sums(*a))
    bake = gram.bake_off(cut, outers, models, SET, "money", weight, keep, F.col("mission"), whole)
    assert len(calls) == 1  # value ranges and Gram matrices, of the folds and the final fits together
    assert bake.final.chosen == want.chosen and bake.fits.chosen == alone.fits.chosen
    for part in ("refits", "scaled"):
        for found, plain_fits in ((bake.final, want), (bake.fits, alone.fits)):
            for name, fits in getattr(plain_fits, part).items():
                assert set(getattr(found, part)[name]) == set(fits)
                for key, beta in fits.items():
                    assert getattr(found, part)[name][key] == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert {r["outer"] for r in bake.settings().collect()} == set(range(len(outers)))


def test_a_factor_on_added_rows_equals_rows_of_that_weight(rows):
    ridge = {"Ridge": gram.LINEAR["Ridge"]}
    cut, outers = gram.grouped_cells(rows, "mission", k=2, repeats=2, inner=2)
    factors = [0.25, 1.0]
    got = gram.bake_off(cut, gram.scaled_added(outers, "factor", factors, k=2, inner=2), ridge, SET, "money", "w", ["company_id"], F.col("mission"))
    assert got.rows.count() == rows.filter("money is not null").count()  # no row is repeated for a factor
    assert got.settings().schema["factor"].dataType.simpleString() == "double"
    for i, factor in enumerate(factors):
        own = cut.withColumn("w", F.when(F.col("population_type") == "space", F.col("w")).otherwise(F.col("w") * factor))
        want = gram.bake_off(own, outers, ridge, SET, "money", "w", ["company_id"], F.col("mission"))
        for name, models in want.fits.refits.items():
            for (o, m, s), beta in models.items():
                assert np.allclose(got.fits.refits[name][o + i * len(outers), m, s], beta, rtol=1e-8, atol=1e-10)
            for (o, m), s in want.fits.chosen[name].items():
                assert got.fits.chosen[name][o + i * len(outers), m] == s
