"""The forecast with fitted routes inside the fold, against the one with a job a year."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import forecast, gram, routed, stepwise
from ledgerline.operators.preprocess import FORECAST_SET
from ledgerline.plans.catalog_models import forecast_rows
from ledgerline.plans.catalog_panel import flow
from ledgerline.settings import STABLE_MODEL, TREND_MODEL
from ledgerline.sources.domain import Tables

KEYS = ["company_id", "accounting_year"]


class Scored:
    """A route in the form that stepwise_forecast takes."""

    def __init__(self, route, mission):
        self.route, self.mission = route, mission

    def transform(self, rows):
        label = self.route.label
        fits = gram.Fits(self.route.basis, [], {label: [{}]})
        fits.refits, fits.chosen = {self.mission: {(0, label, 0): self.route.beta}}, {self.mission: {(0, label): 0}}
        return gram.predict(rows, fits, {self.mission: label}, F.lit(self.mission), ["company_id"])


@pytest.fixture(scope="module")
def inputs(spark, data):
    t = Tables(spark, data)
    f = flow(t)
    basis = gram.basis_of(forecast_rows(t), FORECAST_SET)
    return f, basis


def route_of(basis, seed, name="Ridge"):
    """Coefficients that follow the last turnover, with a small seeded share of every other column."""
    beta = np.random.default_rng(seed).normal(0, 0.01, basis.size)
    beta[0], beta[1 + FORECAST_SET.numeric.index("turnover_t")] = 0.05, 1.0
    return routed.LinearRoute(name, basis, beta)


def rows_of(df):
    return {tuple(r[k] for k in KEYS): r for r in df.collect()}


def test_fold_equals_yearly_jobs(inputs):
    f, basis = inputs
    routes = {"ACE": route_of(basis, 1), "Beyond Earth": route_of(basis, 2, "Lasso")}
    tables = f.panel, f.baseline, f.groups, f.static
    got = rows_of(routed.routed_forecast(*tables, routes))
    want = rows_of(stepwise.stepwise_forecast(
        *tables, {m: Scored(r, m) for m, r in routes.items()}, {m: r.label for m, r in routes.items()}))
    assert got.keys() == want.keys()
    for key, row in got.items():
        for c in stepwise.OUTPUT:
            assert row[c] == (pytest.approx(want[key][c], rel=1e-9) if isinstance(row[c], float) else want[key][c]), (key, c)
    used = {(r["mission"], r["model_used"]) for r in got.values()}
    assert {("ACE", "Ridge"), ("Beyond Earth", "Lasso"), ("ACE", STABLE_MODEL), ("Resilient Earth", TREND_MODEL)} <= used
    assert not any(m == "ACE" and model == TREND_MODEL for m, model in used)


def test_other_missions_keep_their_formula(inputs):
    f, basis = inputs
    tables = f.panel, f.baseline, f.groups, f.static
    plain = rows_of(forecast.recursive_forecast(*tables).filter("mission <> 'ACE'"))
    got = rows_of(routed.routed_forecast(*tables, {"ACE": route_of(basis, 1)}).filter("mission <> 'ACE'"))
    assert got.keys() == plain.keys()
    for key, row in got.items():
        assert row["turnover"] == pytest.approx(plain[key]["turnover"], rel=1e-9)
        assert row["model_used"] == plain[key]["model_used"]


def test_a_value_that_is_no_number_ends_the_company(inputs):
    f, basis = inputs
    beta = np.zeros(basis.size)
    beta[0] = 1e6  # the exponential overflows
    tables = f.panel, f.baseline, f.groups, f.static
    got = routed.routed_forecast(*tables, {"ACE": routed.LinearRoute("Ridge", basis, beta)})
    assert got.filter("model_used = 'Ridge'").count() == 0
    assert got.filter("mission = 'ACE'").count() > 0


def test_plan_does_not_grow_with_the_horizon(inputs):
    f, basis = inputs
    tables = f.panel, f.baseline, f.groups, f.static

    def plan(end_year):
        df = routed.routed_forecast(*tables, {"ACE": route_of(basis, 1)}, end_year)
        return df._jdf.queryExecution().executedPlan().toString()

    near, far = plan(2030), plan(2060)
    assert near.count("Exchange") == far.count("Exchange")
    assert "Python" not in far and "Arrow" not in far
