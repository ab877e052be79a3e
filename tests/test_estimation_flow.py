"""The flow from the wide master to the completed table and the forecast's inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.catalog_estimation import estimation_flow
from ledgerline.settings import CROSS_CUTTING
from ledgerline.sources.domain import Tables


@pytest.fixture(scope="module")
def estimated(spark, data):
    return estimation_flow(Tables(spark, data))


def test_gate_keeps_duplicates_out_of_training(estimated):
    facts = {r["company_id"]: r for r in estimated.segmented.select("company_id", "mission", "training_eligible", "is_true_duplicate").collect()}
    learned = {r[0] for r in estimated.training.select("company_id").distinct().collect()}
    assert learned
    for company in learned:
        row = facts[company]
        assert row["training_eligible"] or (row["mission"] == CROSS_CUTTING and not row["is_true_duplicate"])
    assert estimated.training.groupBy("company_id").agg(F.sum("sample_weight").alias("w")).filter("abs(w - 1) > 1e-9").count() == 0


def test_every_company_has_one_source(estimated):
    done = estimated.completed
    assert done.count() == estimated.master.count() == done.select("company_id").distinct().count()
    usable = {r["mission"]: r["usable"] for r in estimated.selected.collect()}
    labelled = {r[0] for r in estimated.panel.select("company_id").collect()}
    scored = {r["company_id"]: r for r in estimated.predictions.collect()}
    for r in done.join(estimated.segmented.select("company_id", "is_true_duplicate", "training_eligible"), "company_id").collect():
        source = r["turnover_source"]
        assert source is not None
        if source == "predicted":
            assert usable[r["mission"]] and not r["is_true_duplicate"] and r["company_id"] not in labelled
            assert r["turnover_value"] == scored[r["company_id"]]["predicted_total_turnover"] >= 0
        if source == "no_model_insufficient_data":
            assert not usable[r["mission"]] and r["training_eligible"]
        if source == "excluded_duplicate_company_record":
            assert r["is_true_duplicate"] and r["turnover_value"] is None


def test_duplicates_are_named_in_the_cascade(spark, data):
    """A true duplicate without turnover gets its own label, whichever models there are."""
    t = Tables(spark, data)
    flow = estimation_flow(t)
    open_rows = F.coalesce(F.col("balance") < 0, F.lit(False))
    for column, value in (("ch_no", "CH-twin"), ("trading_name", "Twin Ltd.")):
        flow.master = flow.master.withColumn(column, F.when(open_rows, value).otherwise(F.col(column)))
    marked = flow.completed.filter("turnover_source = 'excluded_duplicate_company_record'")
    core = t.company().filter("balance < 0 and sic_code_1 <> 21 and mission <> 'Cross-cutting'")
    assert marked.count() == core.count() > 1
    assert marked.filter("turnover_value is not null or reliability <> 'n/a' or mission is null").count() == 0
    assert flow.predictions.count() == 0


def test_forecast_starts_from_the_completed_table(estimated):
    history, start = estimated.inputs
    assert start.filter("turnover_source is null or baseline_turnover is null").count() == 0
    wanted = estimated.completed.filter("turnover_source in ('observed', 'predicted') and mission is not null")
    ids = {r[0] for r in start.select("company_id").collect()}
    assert ids == {r[0] for r in wanted.select("company_id").collect()}
    summary = estimated.forecast.summary
    assert {r[0] for r in summary.select("company_id").collect()} == ids
    assert history.groupBy("company_id", "accounting_year").count().filter("count > 1").count() == 0
    assert summary.filter("turnover_2030 < 0").count() == 0
