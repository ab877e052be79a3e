"""The recursive forecast where growing companies of some missions follow a fitted linear model.

A linear model's score is a sum over the feature row, so it can be taken inside the fold
over a company's years: the state is the feature row itself, which each step turns into next
year's row. One narrow stage after the feature pass: no yearly jobs, no join of scores, no
stored steps, whatever the horizon."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import (
    cagr_growth,
    decayed,
    gated_growth,
    grown,
    growth_signal,
    is_finite,
    log_growth,
    mean_of,
    median_of_three,
    not_nan,
    ratio,
    stddev_of,
)
from ledgerline.operators.forecast import STEP, let
from ledgerline.operators.gram import Basis, Fits
from ledgerline.operators.preprocess import FORECAST_SET, cast_inputs
from ledgerline.operators.stepwise import OUTPUT, origin_rows
from ledgerline.settings import ENGINEERED, FORECAST_END_YEAR, STABLE_MODEL, TREND_MODEL

ROW = FORECAST_SET.numeric  # what the state carries, as doubles
ROW_TYPE = f"struct<{', '.join(f'{c}: double' for c in ROW)}>"
# Features that are gaps exactly where another one is.
SAME_GAP = {
    "log_turnover_t": "turnover_t",
    "log_turnover_lag_1": "turnover_lag_1",
    "log_turnover_lag_2": "turnover_lag_2",
    "rolling_growth_mean_3": "log_growth_3y_mean",
    "rolling_growth_std_3": "growth_volatility",
}


@dataclass(frozen=True)
class LinearRoute:
    """A fitted model of log turnover next year: coefficients of the basis columns, and its name."""

    label: str
    basis: Basis
    beta: np.ndarray

    @classmethod
    def of(cls, fits: Fits, group: str, model: str) -> "LinearRoute":
        return cls(model, fits.basis, fits.refits[group][0, model, fits.chosen[group][0, model]])

    def fixed(self) -> Column:
        """Constant and category terms, which no step changes."""
        numbers = len(self.basis.features.numeric)
        total = F.lit(float(self.beta[0]))
        if not self.basis.fields:
            return total
        betas = F.array(*[F.lit(float(b)) for b in self.beta])
        for code in self.basis.inputs()[numbers:]:
            total = total + F.get(betas, code)
        return total

    def moving(self, row: Column) -> Column:
        """Terms of the numbers; a gap has a coefficient of its own."""
        names, logs = self.basis.features.numeric, set(self.basis.features.log)
        total = F.lit(0.0)
        for j, c in enumerate(names):
            value = not_nan(F.log1p(row[c]) if c in logs else row[c])
            slope, gap = float(self.beta[1 + j]), float(self.beta[1 + len(names) + j])
            total = total + F.coalesce(value * F.lit(slope), F.lit(gap))
        return total


def _with(row: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(c, row[c]).cast("double").alias(c) for c in ROW])


def _gaps(row: Column) -> Column:
    """How many engineered features are gaps; those outside the state keep their first value."""
    total = F.lit(0)
    for c in ENGINEERED:
        name = SAME_GAP.get(c, c)
        value = row[name] if name in ROW else F.col(c)
        total = total + value.isNull().cast("int")
    return total


def _next_row(row: Column, new: Column, step: Column) -> Column:
    """The feature row one year on; levels that are not forecast stay as they are."""
    t, l1, l2 = row["turnover_t"], row["turnover_lag_1"], row["turnover_lag_2"]
    g0, g1, g2 = log_growth(new, t), log_growth(t, l1), log_growth(l1, l2)

    def flat(level: str) -> Column:
        return F.when(row[level].isNotNull(), F.lit(0.0))

    def moved(g: Column) -> Column:
        now, growths = g["g0"], [g["g2"], g["g1"], g["g0"]]
        return _with(
            row,
            turnover_t=new,
            turnover_lag_1=t,
            turnover_lag_2=l1,
            turnover_lag_3=l2,
            rolling_turnover_mean_2=mean_of([t, new]),
            rolling_turnover_mean_3=mean_of([l1, t, new]),
            rolling_turnover_median_3=median_of_three(l1, t, new),
            historical_turnover_max=F.greatest(row["historical_turnover_max"], new),
            historical_turnover_min=F.least(row["historical_turnover_min"], new),
            company_age=F.col("accounting_year") + step - F.col("founded_year"),
            n_prior_turnover_values=row["n_prior_turnover_values"] + 1,
            history_span_years=row["history_span_years"] + 1,
            years_since_previous_turnover=F.lit(1),
            consecutive_history_length_to_date=row["consecutive_history_length_to_date"] + 1,
            log_growth_1y=now,
            log_growth_2y_mean=mean_of(growths[1:]),
            log_growth_3y_mean=mean_of(growths),
            growth_volatility=stddev_of(growths),
            growth_acceleration=now - g["g1"],
            positive_growth_count=F.coalesce(row["positive_growth_count"], F.lit(0.0)) + (now > 0).cast("double"),
            negative_growth_count=F.coalesce(row["negative_growth_count"], F.lit(0.0)) + (now < 0).cast("double"),
            employee_growth=flat("employees"),
            asset_growth=flat("total_assets"),
            export_share=ratio(row["export_revenue"], new),
            has_growth_history=F.lit(1.0),
            has_three_year_history=row["n_prior_turnover_values"] >= 1,
        )

    def counted(next_row: Column) -> Column:
        return let(
            _gaps(next_row),
            lambda n: _with(next_row, missing_feature_count=n, missing_feature_proportion=n / F.lit(float(len(ENGINEERED)))),
        )

    growths = F.struct(g0.alias("g0"), g1.alias("g1"), g2.alias("g2"))
    return let(let(growths, moved), counted)


def _advance(acc: Column, step: Column, trend: Callable[[Column], Column]) -> Column:
    row = acc["state"]
    t = row["turnover_t"]

    def routed(signal: Column) -> Column:
        return F.struct(signal.alias("signal"), gated_growth(signal, F.col("evidence_group")).alias("class"))

    def predicted(route: Column) -> Column:
        value = F.when(route["class"] == "growing", decayed(t, trend(row), step, F.col("anchor"))).otherwise(t)
        return let(value, lambda v: F.struct(route.alias("route"), F.when(is_finite(v) & (v >= 0), v).alias("next")))

    def appended(p: Column) -> Column:
        line = F.struct(
            step.cast("int").alias("step"),
            p["next"].alias("turnover"),
            p["route"]["signal"].alias("growth_signal"),
            p["route"]["class"].alias("growth_classification"),
        )
        rows = F.when(p["next"].isNotNull(), F.concat(acc["rows"], F.array(line))).otherwise(acc["rows"])
        state = _next_row(row, p["next"], step)
        return F.struct(state.cast(ROW_TYPE).alias("state"), rows.cast(STEP).alias("rows"))

    signal = growth_signal(row["log_growth_3y_mean"], row["log_growth_1y"])
    return let(let(let(signal, routed), predicted), appended)


def routed_forecast(
    panel: DataFrame,
    baseline: DataFrame,
    groups: DataFrame,
    static: DataFrame,
    routes: dict[str, LinearRoute],
    end_year: int = FORECAST_END_YEAR,
) -> DataFrame:
    """`recursive_forecast` with a fitted model for the growing years of the missions in `routes`.

    Same columns; `model_used` names the formula or model that gave the value. A prediction that
    is no finite, non-negative number ends its company."""
    mission = F.col("mission")
    active = origin_rows(panel, baseline, groups, static).filter(F.col("accounting_year") < end_year)
    fixed, label = F.lit(None).cast("double"), F.lit(TREND_MODEL)
    for name, route in routes.items():
        fixed = F.when(mission == name, route.fixed()).otherwise(fixed)
        label = F.when(mission == name, route.label).otherwise(label)
    raw = {c: F.col(c) for c in FORECAST_SET.categories}  # labels for the model, plain values for the output
    active = cast_inputs(active.withColumns({f"_{c}": v for c, v in raw.items()}), FORECAST_SET).withColumn("_fixed", fixed)
    active = active.withColumns({c: F.col(f"_{c}") for c in raw})

    def trend(row: Column) -> Column:
        own = cagr_growth(row["log_growth_3y_mean"], row["log_growth_2y_mean"], row["log_growth_1y"])
        out = grown(row["turnover_t"], own)
        for name, route in routes.items():
            out = F.when(mission == name, F.expm1(F.col("_fixed") + route.moving(row))).otherwise(out)
        return out

    first = F.struct(
        F.struct(*[F.col(c).cast("double").alias(c) for c in ROW]).cast(ROW_TYPE).alias("state"),
        F.array().cast(STEP).alias("rows"),
    )
    steps = F.sequence(F.lit(1), (F.lit(end_year) - F.col("accounting_year")).cast("int"))
    folded = F.aggregate(steps, first, lambda acc, k: _advance(acc, k, trend))
    kept = [c for c in active.columns if c not in ("step", "turnover")]
    out = active.withColumn("_rows", folded["rows"]).select(*kept, F.inline("_rows"))
    year = F.col("accounting_year") + F.col("step")
    out = out.withColumns(
        {
            "model_used": F.when(F.col("growth_classification") == "growing", label).otherwise(STABLE_MODEL),
            "company_age": year - F.col("founded_year"),
            "accounting_year": year,
        }
    )
    return out.select(*OUTPUT)
