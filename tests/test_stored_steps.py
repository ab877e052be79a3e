"""Steps that several later ones read are stored once a query."""

from ledgerline.operators import estimators
from ledgerline.operators.preprocess import FeatureSet, fit_preparations
from ledgerline.plans.catalog_models import estimation_rows
from ledgerline.plans.catalog_panel import adjacent_training, flow, foreign
from ledgerline.sources.domain import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjacent_companies_are_stored_once(spark, data):
    t = Tables(spark, data)
    raw = foreign(t)
    assert "Join" not in plan(raw) and "Aggregate" not in plan(raw)
    assert foreign(t) is raw
    assert plan(adjacent_training(t)).count("supplier_export") == 0  # the export is read while `raw` is stored, not again


def test_labelled_rows_and_the_flow_are_built_once_a_query(spark, data):
    t = Tables(spark, data)
    assert estimation_rows(t) is estimation_rows(t)
    assert flow(t) is flow(t)


def test_tree_candidates_need_no_deviations_and_their_predictions_are_stored(spark):
    facts = [(f"c{i}", i % 4, float(i % 7), "ab"[i % 2], float(i)) for i in range(60)]
    rows = spark.createDataFrame(facts, "company_id string, fold int, size double, kind string, money double")
    wanted = FeatureSet(["size"], [], ["kind"])
    plain, scaled = (fit_preparations([rows], wanted, s)[0] for s in (False, True))
    assert plain.median == scaled.median and plain.names == scaled.names
    assert not plain.mean and not plain.std and scaled.std
    split = estimators.Split({"fold": 0}, rows.filter("fold > 0"), rows.filter("fold = 0"), lambda: [])
    trees = estimators.with_grid({"Extra Trees": {"trees": [2], "depth": [2], "leaf": [1]}})
    scored = estimators.out_of_fold(iter([split]), trees, wanted, "money", None, ["company_id"])
    assert "UDF" not in plan(scored) and scored.count() == 15  # no tree is scored again by a metric
