"""Recursion for routes that need a fitted model.

A fitted model scores whole feature rows, so the recursion advances one year per
job: each company's feature row is turned into next year's row by expressions
alone (no shuffle, no window over the grown panel), and every step is a table in
the shared folder."""

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import (
    cagr_growth,
    decayed,
    gated_growth,
    grown,
    growth_signal,
    is_finite,
    ratio,
)
from ledgerline.operators.features import (
    engineered_panel,
    growth_core,
    growth_statistics,
    missing_flags,
    missing_summary,
    turnover_averages,
)
from ledgerline.operators.forecast import growth_anchor, seed_companies
from ledgerline.operators.preprocess import FORECAST_SET, cast_inputs
from ledgerline.operators.ranks import attach
from ledgerline.settings import FORECAST_END_YEAR, STABLE_MODEL, TREND_MODEL
from ledgerline.sources.writers import written


def origin_rows(panel: DataFrame, baseline: DataFrame, groups: DataFrame, static: DataFrame) -> DataFrame:
    """Feature row of each company at its baseline year, with route facts."""
    rows = engineered_panel(seed_companies(panel, baseline, static), baseline)
    start = baseline.select("company_id", F.col("baseline_year").alias("accounting_year"))
    evidence = groups.select("company_id", F.col("forecast_evidence_group").alias("evidence_group"))
    rows = rows.join(start, ["company_id", "accounting_year"]).join(evidence, "company_id", "left")
    rows = attach(rows.fillna("D", ["evidence_group"]), growth_anchor(growth_core(panel)), ["mission"])
    return rows.withColumn("step", F.lit(0))


def _flat_if_known(level: str) -> Column:
    """Growth of a level that is carried forward unchanged."""
    return F.when(F.col(level).isNotNull(), F.lit(0.0))


TRANSIENT = ["raw", "next_turnover", "has_employee_data", "has_financial_statement_data"]


def next_rows(scored: DataFrame) -> DataFrame:
    """Feature row of the following year, given `next_turnover`."""
    t, new = F.col("turnover_t"), F.col("next_turnover")
    moved = scored.withColumns(
        {
            "turnover_lag_3": F.col("turnover_lag_2"),
            "turnover_lag_2": F.col("turnover_lag_1"),
            "turnover_lag_1": t,
            "turnover_t": new,
            "turnover": new,
            "accounting_year": F.col("accounting_year") + 1,
            "company_age": F.col("accounting_year") + 1 - F.col("founded_year"),
            "step": F.col("step") + 1,
            "historical_turnover_max": F.greatest("historical_turnover_max", new),
            "historical_turnover_min": F.least("historical_turnover_min", new),
            "n_prior_turnover_values": F.col("n_prior_turnover_values") + 1,
            "history_span_years": F.col("history_span_years") + 1,
            "years_since_previous_turnover": F.lit(1),
            "consecutive_history_length_to_date": F.col("consecutive_history_length_to_date") + 1,
            "has_growth_history": F.lit(True),
            "has_three_year_history": F.col("n_prior_turnover_values") >= 1,
            "export_share": ratio(F.col("export_revenue"), new),
            "employee_growth": _flat_if_known("employees"),
            "asset_growth": _flat_if_known("total_assets"),
        }
    )
    out = turnover_averages(growth_statistics(moved)).withColumns(
        {
            "log_turnover_t": F.log1p("turnover_t"),
            "log_turnover_lag_1": F.log1p("turnover_lag_1"),
            "log_turnover_lag_2": F.log1p("turnover_lag_2"),
            "positive_growth_count": F.coalesce("positive_growth_count", F.lit(0.0))
            + (F.col("log_growth_1y") > 0).cast("double"),
            "negative_growth_count": F.coalesce("negative_growth_count", F.lit(0.0))
            + (F.col("log_growth_1y") < 0).cast("double"),
        }
    )
    stale = [c for c in out.columns if c.startswith("is_missing_") or c.startswith("missing_feature_")]
    return missing_summary(missing_flags(out.drop(*stale, *TRANSIENT)))


def route(rows: DataFrame) -> DataFrame:
    signal = growth_signal(F.col("log_growth_3y_mean"), F.col("log_growth_1y"))
    return rows.withColumn("growth_signal", signal).withColumn(
        "growth_classification", gated_growth(F.col("growth_signal"), F.col("evidence_group"))
    )


def score(rows: DataFrame, models: dict[str, PipelineModel], labels: dict[str, str]) -> DataFrame:
    """Next turnover of every row by its route; decayed where a trend is continued."""
    t, step = F.col("turnover_t"), F.col("step") + 1
    own = cagr_growth(F.col("log_growth_3y_mean"), F.col("log_growth_2y_mean"), F.col("log_growth_1y"))
    growing = F.col("growth_classification") == "growing"
    fitted = growing & F.col("mission").isin(list(models))
    parts = [rows.filter(~fitted).withColumn("raw", F.when(growing, grown(t, own)).otherwise(t))]
    for mission, model in models.items():
        mine = rows.filter(growing & (F.col("mission") == mission))
        inputs = cast_inputs(mine.select("company_id", *FORECAST_SET.numeric, *FORECAST_SET.categories), FORECAST_SET)
        raw = model.transform(inputs).select("company_id", F.col("predicted").alias("raw"))
        parts.append(mine.join(raw, "company_id"))
    scored = reduce(DataFrame.unionByName, parts)
    value = F.when(growing, decayed(t, F.col("raw"), step, F.col("anchor"))).otherwise(F.col("raw"))
    label = F.lit(TREND_MODEL)
    for mission in models:
        label = F.when(F.col("mission") == mission, labels[mission]).otherwise(label)
    return scored.withColumn("next_turnover", F.when(is_finite(value) & (value >= 0), value)).withColumn(
        "model_used", F.when(growing, label).otherwise(STABLE_MODEL)
    )


OUTPUT = [
    "company_id", "mission", "accounting_year", "sic_code_1", "value_stream", "total_assets", "employees",
    "export_revenue", "company_size", "company_age", "turnover", "model_used", "growth_signal",
    "evidence_group", "growth_classification", "step",
]


def stepwise_forecast(
    panel: DataFrame,
    baseline: DataFrame,
    groups: DataFrame,
    static: DataFrame,
    models: dict[str, PipelineModel],
    labels: dict[str, str],
    end_year: int = FORECAST_END_YEAR,
) -> DataFrame:
    """Yearly jobs up to the end year; a company without a valid prediction stops."""
    state = written(origin_rows(panel, baseline, groups, static), "origin")
    first = state.agg(F.min("accounting_year")).first()[0]
    steps = []
    for _ in range(end_year - first if first is not None else 0):
        active = route(state.filter(F.col("accounting_year") < end_year))
        scored = score(active, models, labels).filter(F.col("next_turnover").isNotNull())
        state = written(next_rows(scored), "step")
        steps.append(state.select(*OUTPUT))
    return reduce(DataFrame.unionByName, steps)
