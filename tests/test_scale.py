"""Invariants, exactness under skew, leakage and plan shape."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import estimators, features, keys, preprocess, ranks, splits
from ledgerline.plans.flow import ForecastFlow
from ledgerline.sources import readers, writers
from ledgerline.sources.domain import Tables


@pytest.fixture(scope="module")
def flow(spark, data):
    t = Tables(spark, data)
    t.stored_filed()
    return ForecastFlow(writers.written(t.panel(), "panel"), writers.written(t.baseline(), "baseline"), t.static())


def skewed_values(n=3000, seed=7):
    """A third of the rows share one value."""
    rng = random.Random(seed)
    return [(("g1", "g2")[i % 2], 0.5 if rng.random() < 0.34 else rng.lognormvariate(0, 3)) for i in range(n)]


@pytest.mark.parametrize("share", [0.25, 0.5, 0.9])
def test_quantile_is_exact_under_skew(spark, monkeypatch, share):
    monkeypatch.setattr(ranks, "SKETCH", 100)
    rows = skewed_values()
    got = {r["g"]: r["q"] for r in ranks.quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share, "q").collect()}
    for g in ("g1", "g2"):
        ordered = sorted(v for k, v in rows if k == g)
        target = share * (len(ordered) - 1)
        low = int(target)
        high = min(low + 1, len(ordered) - 1)
        assert got[g] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (target - low), rel=1e-12)


def test_average_ranks_match_brute_force(spark):
    rows = skewed_values(1000)
    got = {(r["g"], r["v"]): r["k"] for r in ranks.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "k").collect()}
    for (g, v), rank in got.items():
        mine = [x for k, x in rows if k == g]
        below, equal = sum(x < v for x in mine), sum(x == v for x in mine)
        assert rank == below + (equal + 1) / 2


def test_hash_numbering_is_a_permutation(spark):
    df = spark.range(997).select(F.col("id").cast("string").alias("k"))
    got = sorted(r["position"] for r in ranks.numbered_by_hash(df, [], F.col("k")).collect())
    assert got == list(range(1, 998))


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    salted = keys.salted_join(left, right, ["k"], "i")
    assert sorted(map(tuple, salted.select("i", "v").collect()), key=str) == sorted(
        map(tuple, left.join(right, "k", "left").select("i", "v").collect()), key=str)


def test_fold_medians(spark):
    df = spark.createDataFrame([(float(i % 17), None if i % 5 else float(i)) for i in range(401)], "a double, b double")
    found = preprocess.fold_medians(df.withColumn("none", F.lit(None).cast("double")), ["a", "b", "none"])
    assert found == {"a": statistics.median(float(i % 17) for i in range(401)), "b": 200.0}


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 40, 999])
def test_several_quantiles_in_one_pass(spark, rows):
    values = [float((i * 7919) % 1009) ** 2 for i in range(rows)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}
    got = ranks.quantiles(df, [], "v", shares).first()
    ordered = sorted(values)
    for name, share in shares.items():
        at = share * (rows - 1)
        low, high = int(at), min(int(at) + 1, rows - 1)
        assert got[name] == pytest.approx(ordered[low] + (ordered[high] - ordered[low]) * (at - low))


def test_quantile_plan_needs_few_exchanges(spark, data):
    df = ranks.quantiles(Tables(spark, data).table("orders"), ["o_orderpriority"], "o_totalprice", {"a": 0.25, "b": 0.5, "c": 0.75})
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 4


def test_facts_beyond_the_broadcast_bound_are_joined_by_shuffle(spark, monkeypatch):
    rows, facts = spark.range(100).selectExpr("id % 7 as g", "id"), spark.range(7).selectExpr("id as g", "id * 2 as f")
    want = sorted(tuple(r) for r in ranks.attach(rows, facts, ["g"]).collect())
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", 3)
    assert sorted(tuple(r) for r in ranks.attach(rows, facts, ["g"]).collect()) == want


def test_preparation_with_very_many_categories(spark):
    features = preprocess.FeatureSet([], ["x"], ["code"])
    rows = [(float(i), f"c{i:05d}") for i in range(11_000)] + [(float(i), f"f{i % 3}") for i in range(60)] + [(0.0, None)]
    train = spark.createDataFrame(rows, "x double, code string")
    prepared = preprocess.fit_preparation(train, features)
    assert prepared.names == ["plain_numeric__x", *(f"categorical__code_f{i}" for i in range(3)), "categorical__code_infrequent"]
    new = spark.createDataFrame([(5530.0, "f1"), (None, "c00007"), (0.0, None), (0.0, "unseen")], "x double, code string")
    for stage in prepared.stages(False):
        new = stage.transform(new)
    vectors = [r["features"].toArray().tolist()[1:] for r in new.collect()]
    assert vectors == [[0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 1], [0, 0, 0, 0]]


def closed_form_rows(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        x = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((*x, 3.0 * x[0] - 1.2 * x[1] + rng.gauss(0, 0.5) + 4.0, rng.uniform(0.2, 2.0)))
    return rows


@pytest.mark.parametrize(("name", "params"), [
    ("Linear Regression", {"intercept": True}), ("Linear Regression", {"intercept": False}), ("Ridge", {"alpha": 10.0}),
    ("Lasso", {"alpha": 0.5}), ("Elastic Net", {"alpha": 1.0, "ratio": 0.5}), ("Elastic Net", {"alpha": 0.3, "ratio": 0.2}),
])
def test_linear_candidates_solve_their_own_penalty(spark, name, params):
    """Against coordinate descent on the weighted objective each candidate stands for."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    rows = closed_form_rows(spark)
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, fit_weight double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    scale = estimators.label_scale(df)
    model = estimators.MODELS[name].build(params, scale).fit(df)
    data = np.array(rows)
    x, y, w = data[:, :3], data[:, 3], data[:, 4]
    total = w.sum()
    if params.get("intercept", True):
        x, y = x - w @ x / total, y - w @ y / total
    alpha, ratio = params.get("alpha", 0.0), params.get("ratio", {"Lasso": 1.0}.get(name, 0.0))
    l1 = 0.0 if name == "Ridge" else alpha * ratio * total
    l2 = alpha if name == "Ridge" else alpha * (1 - ratio) * total
    beta = np.zeros(3)
    for _ in range(3000):
        for j in range(3):
            rest = (w * x[:, j]) @ (y - x @ beta + x[:, j] * beta[j])
            beta[j] = np.sign(rest) * max(abs(rest) - l1, 0) / ((w * x[:, j]) @ x[:, j] + l2)
    assert model.coefficients.toArray() == pytest.approx(beta, abs=2e-3)


@pytest.mark.parametrize(("name", "params"), [
    ("Random Forest", {"trees": 5, "depth": 4, "leaf": 1}), ("Extra Trees", {"trees": 5, "depth": 4, "leaf": 1}),
    ("Gradient Boosting", {"rounds": 5, "rate": 0.3, "depth": 2}), ("Categorical Boosting", {"rounds": 5, "rate": 0.3, "depth": 2}),
])
def test_tree_candidates_beat_the_mean(spark, name, params):
    features = preprocess.FeatureSet([], ["a", "b", "c"], ["kind"])
    df = spark.createDataFrame([(*r[:3], f"k{i % 4}", r[3] + 12 + 3 * (i % 4), r[4]) for i, r in enumerate(closed_form_rows(spark))],
                               "a double, b double, c double, kind string, money double, w double")
    prepared = preprocess.fit_preparation(df, features)
    model = estimators.fit_one(df, prepared, name, estimators.MODELS[name], params, "money", "w")
    scored = model.transform(df).agg(F.avg(F.abs(F.col("predicted") - F.col("money"))).alias("e"), F.stddev("money").alias("s")).first()
    assert scored["e"] < 0.7 * scored["s"]


def test_tuning_takes_the_setting_of_lowest_error(spark):
    features = preprocess.FeatureSet([], ["a", "b", "c"], [])
    df = spark.createDataFrame([(*r[:3], r[3] + 20, f"c{i}", i % 2) for i, r in enumerate(closed_form_rows(spark))],
                               "a double, b double, c double, money double, company_id string, half int")
    a, b = df.filter("half = 0"), df.filter("half = 1")
    pairs = [(a, b, preprocess.fit_preparation(a, features)), (b, a, preprocess.fit_preparation(b, features))]
    candidate = estimators.with_grid({"Ridge": {"alpha": [1e6, 0.1, 1e4]}})["Ridge"]
    assert estimators.tune("Ridge", candidate, pairs, "money", None) == {"alpha": 0.1}


def test_folds_keep_companies_apart(spark, flow):
    folds = splits.group_folds(flow.panel)
    assert folds.groupBy("company_id", "repeat").count().filter("count > 1").count() == 0
    sizes = [r["count"] for r in folds.filter("repeat = 0").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_added_population_is_never_tested(spark):
    df = spark.createDataFrame(
        [(f"s{i}", "space") for i in range(20)] + [(f"a{i}", "adjacent") for i in range(9)], "company_id string, population_type string")
    folded = splits.primary_folds(df, 5, 2)
    assert folded.filter("population_type = 'adjacent' and fold is not null").count() == 0
    assert folded.filter("population_type = 'space' and fold is null").count() == 0
    assert folded.count() == 2 * 29


def test_no_feature_sees_the_future(spark, flow):
    changed = flow.panel.withColumn(
        "turnover", F.when(F.col("accounting_year") >= 2020, F.col("turnover") * 7 + 1).otherwise(F.col("turnover")))
    early = "accounting_year < 2020"
    a = features.engineered_panel(flow.panel).filter(early)
    b = features.engineered_panel(changed).filter(early)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_forecast_invariants(spark, flow):
    p = flow.predicted
    assert p.filter("not (turnover_lower <= turnover and turnover <= turnover_upper) or turnover_lower < 0").count() == 0
    assert p.groupBy("company_id", "accounting_year").count().filter("count > 1").count() == 0
    observed = flow.trajectories.filter("data_type = 'observed'").select("company_id", "accounting_year", "turnover")
    assert observed.exceptAll(flow.panel.select("company_id", "accounting_year", "turnover")).count() == 0
    assert flow.summary.count() == flow.baseline.count()
    reached = p.filter("accounting_year = 2030").count()
    assert reached == flow.baseline.filter("baseline_turnover is not null").count()


def test_feature_plan_has_one_exchange(spark, data):
    rows = writers.written(Tables(spark, data).panel(), "plan")
    text = features.engineered_panel(features.next_year_target(rows))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [company_id") == 1


def test_scans_read_only_needed_columns(spark, data):
    df = Tables(spark, data).filings().select("company_id", "accounting_year", "turnover")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in text
    assert "l_quantity" not in text and "l_extendedprice" not in text


def test_recursion_needs_no_exchange_per_step(spark, flow):
    from ledgerline.operators.forecast import recursive_forecast

    counts = []
    for end in (2023, 2030):
        df = recursive_forecast(flow.panel, flow.baseline, flow.groups, flow.static, end)
        counts.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert counts[0] == counts[1]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "mapping.csv").write_text("Mission,Value Stream\nACE,Artificial Intelligence\n")
    assert [tuple(r) for r in readers.read_mapping(spark, str(tmp_path / "mapping.csv")).collect()] == [("ACE", "Artificial Intelligence")]
    (tmp_path / "weights.csv").write_text("# a note\nfeature,weight\na,0.5\n")
    rows = readers.read_commented_csv(spark, str(tmp_path / "weights.csv"), "feature string, weight double").collect()
    assert [tuple(r) for r in rows] == [("a", 0.5)]
    with pytest.raises(FileNotFoundError, match="nothing"):
        readers.require_inputs(spark, {"nothing": str(tmp_path / "absent.parquet")})
    path = str(tmp_path / "stage")
    old = spark.createDataFrame([("ACE", 1), ("Beyond Earth", 2)], "mission string, v int")
    writers.write_stage(old, path)
    writers.upsert_table(spark.createDataFrame([("ACE", 9)], "mission string, v int"), path)
    kept = spark.read.parquet(path)
    assert sorted((r["mission"], r["v"]) for r in kept.collect()) == [("ACE", 9), ("Beyond Earth", 2)]
    writers.export({"report": old.withColumnRenamed("v", "year")}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "report")).columns == ["Mission", "Turnover Year"]


def test_saved_model_scores_alike(spark, data):
    from __spark_entry__ import queries

    rows = queries()["s9_model_io"](spark, data)
    assert rows.filter("abs(difference) > 1e-6").count() == 0 and rows.count() > 0


def test_rank_correlation_is_exact_and_stores_no_row_per_value(spark, monkeypatch):
    """Cells of several values, of one hot value, of nulls and NaN; the rows go through two exchanges, unrepeated."""
    from ledgerline.operators import studies

    monkeypatch.setattr(ranks, "CELLS", 8)
    rng = random.Random(3)
    rows = []
    for i in range(900):
        y = 5.0 if rng.random() < 0.3 else rng.lognormvariate(0, 2)
        x = [None, float("nan"), -0.0, 0.0, y + rng.gauss(0, 3), rng.gauss(0, 1)][min(i % 11, 5)]
        rows.append((("g", None)[i % 2], f"c{i}", x, i % 3, None if i % 50 == 0 else y))
    df = spark.createDataFrame(rows, "g string, company_id string, x double, k int, y double")
    seen = []
    monkeypatch.setattr(ranks, "written", lambda facts, name: seen.append(facts.count()) or facts)
    got = {(r["g"], r["feature"]): r["rho"] for r in studies.spearman(df, ["g"], ["x", "k"], "y", "rho").collect()}

    def placed(values):
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    for g in ("g", None):
        for at, name in ((2, "x"), (3, "k")):
            pairs = [(r[at], r[4]) for r in rows if r[0] == g and r[4] is not None and r[at] is not None and r[at] == r[at]]
            mine = statistics.correlation(placed([a for a, _ in pairs]), placed([b for _, b in pairs]))
            assert got[g, name] == pytest.approx(mine, abs=1e-12)
    assert len(got) == 4 and max(seen) <= 2 * 2 * 2 * 8
