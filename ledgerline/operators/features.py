"""Features known at the end of each company-year.

All windows share one (company, year) ordering, so the whole feature set costs
one exchange and one sort. Lags count observed rows; only targets and runs ask
for consecutive calendar years. A company has at most one row per supported
year here, which bounds every window partition."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerline.functions.numeric import (
    age,
    filled,
    growth_bucket,
    log_growth,
    mean_of,
    median_of_three,
    ratio,
    recency,
    size_bucket,
    stddev_of,
)
from ledgerline.functions.numeric import currency, evidence_group
from ledgerline.functions.text import normalized_url, public_body_flag, research_body_flag
from ledgerline.operators.keys import first_per_key
from ledgerline.operators.panel import employee_columns, quoted
from ledgerline.operators.quality import guard_non_negative, null_negative_age
from ledgerline.settings import (
    ACCELERATOR_SLOTS,
    BOOLEAN_SIGNALS,
    ENGINEERED,
    FUNDRAISING_COLUMNS,
    GRANT_COLUMNS,
    SPINOUT_SLOTS,
    STATEMENT_DATE,
    STATEMENT_RATIOS,
)

def by_year() -> WindowSpec:
    return Window.partitionBy("company_id").orderBy("accounting_year")


def to_date() -> WindowSpec:
    return by_year().rowsBetween(Window.unboundedPreceding, 0)


def turnover_lags(panel: DataFrame) -> DataFrame:
    t = F.col("turnover")
    lags = {f"turnover_lag_{n}": F.lag(t, n).over(by_year()) for n in (1, 2, 3)}
    return panel.withColumns({"turnover_t": t, **lags}).withColumns(
        {
            "log_turnover_t": F.log1p("turnover_t"),
            "log_turnover_lag_1": F.log1p("turnover_lag_1"),
            "log_turnover_lag_2": F.log1p("turnover_lag_2"),
        }
    )


def growth_core(panel: DataFrame) -> DataFrame:
    """Turnover lags and one-year growth only."""
    lagged = panel.withColumn("turnover_t", F.col("turnover")).withColumns(
        {f"turnover_lag_{n}": F.lag("turnover", n).over(by_year()) for n in (1, 2, 3)}
    )
    return lagged.withColumn("log_growth_1y", log_growth(F.col("turnover_t"), F.col("turnover_lag_1")))


def growth_statistics(lagged: DataFrame) -> DataFrame:
    """Growth and its 2 / 3 row statistics, taken from the three lags at hand."""
    t, l1, l2, l3 = (F.col(c) for c in ("turnover_t", "turnover_lag_1", "turnover_lag_2", "turnover_lag_3"))
    g0, g1, g2 = log_growth(t, l1), log_growth(l1, l2), log_growth(l2, l3)
    out = lagged.withColumns({"log_growth_1y": g0, "_g1": g1, "_g2": g2})
    now, last, before = F.col("log_growth_1y"), F.col("_g1"), F.col("_g2")
    out = out.withColumns(
        {
            "log_growth_2y_mean": mean_of([last, now]),
            "log_growth_3y_mean": mean_of([before, last, now]),
            "growth_volatility": stddev_of([before, last, now]),
            "growth_acceleration": now - last,
        }
    ).withColumns(
        {
            "rolling_growth_mean_3": F.col("log_growth_3y_mean"),
            "rolling_growth_std_3": F.col("growth_volatility"),
        }
    )
    return out.drop("_g1", "_g2")


def growth_features(lagged: DataFrame) -> DataFrame:
    out = growth_statistics(lagged)
    now = F.col("log_growth_1y")
    for name, hit in (("positive_growth_count", now > 0), ("negative_growth_count", now < 0)):
        out = out.withColumn(name, F.sum(hit.cast("double")).over(to_date()))
    return out


def turnover_averages(lagged: DataFrame) -> DataFrame:
    t, l1, l2 = F.col("turnover_t"), F.col("turnover_lag_1"), F.col("turnover_lag_2")
    return lagged.withColumns(
        {
            "rolling_turnover_mean_2": mean_of([l1, t]),
            "rolling_turnover_mean_3": mean_of([l2, l1, t]),
            "rolling_turnover_median_3": median_of_three(l2, l1, t),
        }
    )


def turnover_rolling(lagged: DataFrame) -> DataFrame:
    return turnover_averages(lagged).withColumns(
        {
            "historical_turnover_max": F.max("turnover_t").over(to_date()),
            "historical_turnover_min": F.min("turnover_t").over(to_date()),
        }
    )


def run_length(breaks: Column, position: Column) -> Column:
    """Rows since the last break, the breaking row counted as the first."""
    start = F.max(F.when(breaks, position)).over(to_date())
    return position - start + 1


def history_features(panel: DataFrame) -> DataFrame:
    year = F.col("accounting_year")
    out = panel.withColumns(
        {
            "_position": F.row_number().over(by_year()),
            "_first_year": F.min(year).over(to_date()),
            "_previous_year": F.lag(year).over(by_year()),
        }
    )
    gap = F.coalesce(year - F.col("_previous_year") != 1, F.lit(True))
    out = out.withColumns(
        {
            "n_prior_turnover_values": F.col("_position") - 1,
            "history_span_years": year - F.col("_first_year"),
            "years_since_previous_turnover": year - F.col("_previous_year"),
            "consecutive_history_length_to_date": run_length(gap, F.col("_position")),
            "has_growth_history": F.col("_position") >= 2,
            "has_three_year_history": F.col("_position") >= 3,
        }
    )
    return out.drop("_position", "_first_year", "_previous_year")


def financial_features(panel: DataFrame) -> DataFrame:
    employees, assets = F.col("employees"), F.col("total_assets")
    return panel.withColumns(
        {
            "assets_per_employee": ratio(assets, employees),
            "export_share": ratio(F.col("export_revenue"), F.col("turnover")),
            "employee_growth": log_growth(employees, F.lag(employees).over(by_year())),
            "asset_growth": log_growth(assets, F.lag(assets).over(by_year())),
        }
    )


MISSING_FLAGS = [
    "turnover_lag_1", "turnover_lag_2", "turnover_lag_3", "total_assets", "employees", "export_revenue",
]


def missing_flags(df: DataFrame) -> DataFrame:
    flags = [f"{c} is null as is_missing_{c}" for c in MISSING_FLAGS]
    flags += [
        "employees is not null as has_employee_data",
        "total_assets is not null as has_financial_statement_data",
    ]
    return df.selectExpr("*", *flags)


def missing_summary(df: DataFrame, features: list[str] = ENGINEERED) -> DataFrame:
    absent = " + ".join(f"cast({c} is null as int)" for c in features)
    return df.selectExpr("*", f"{absent} as missing_feature_count").selectExpr(
        "*", f"missing_feature_count / {len(features)}D as missing_feature_proportion"
    )


def next_year_target(panel: DataFrame) -> DataFrame:
    """Attach next year's turnover; null unless the next row is the next year."""
    next_year = F.lead("accounting_year").over(by_year())
    follows = next_year == F.col("accounting_year") + 1
    return panel.withColumns(
        {
            "target_turnover_next_year": F.when(follows, F.lead("turnover").over(by_year())),
            "target_year": F.when(follows, next_year),
        }
    )


def reliability_columns(panel: DataFrame, baseline: DataFrame) -> DataFrame:
    facts = baseline.select(
        "company_id",
        F.col("turnover_source").alias("estimation_turnover_source"),
        F.col("baseline_reliability").alias("estimation_reliability"),
        F.col("reliability_reason").alias("estimation_reliability_reason"),
    )
    return panel.join(facts, "company_id", "left")


def engineered_panel(panel: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    guarded = guard_non_negative(panel, ["turnover", "employees", "total_assets"])
    out = turnover_rolling(growth_features(turnover_lags(guarded)))
    out = missing_summary(missing_flags(financial_features(history_features(out))))
    return out if baseline is None else reliability_columns(out, baseline)


def training_features(panel: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Feature rows that have a next-year target, from the same window pass."""
    return engineered_panel(next_year_target(panel), baseline).filter(F.col("target_year").isNotNull())


def evidence_groups(baseline: DataFrame, properties: DataFrame) -> DataFrame:
    years = properties.select("company_id", "n_turnover_years")
    joined = baseline.join(years, "company_id", "left").fillna(0, ["n_turnover_years"])
    group = evidence_group(F.col("n_turnover_years"), F.col("turnover_source"))
    return joined.withColumn("forecast_evidence_group", group)


def with_growth_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("growth_trajectory", growth_bucket(F.col("log_growth_1y")))


# --- estimation side ----------------------------------------------------------------


def signal_features(df: DataFrame, url: str) -> DataFrame:
    """Signals, slot counts, amounts and latest dates per profile URL."""
    slots = [quoted(c) for c in ACCELERATOR_SLOTS if c in df.columns]
    spinouts = [quoted(c) for c in SPINOUT_SLOTS if c in df.columns]
    columns = [normalized_url(F.col(url)).alias("url_norm")]
    columns += [quoted(src).cast("int").alias(out) for src, out in BOOLEAN_SIGNALS.items()]
    columns += [
        (filled(slots) > 0).cast("int").alias("has_attended_accelerator"),
        filled(slots).alias("accelerator_count"),
        (filled(spinouts) > 0).cast("int").alias("is_academic_spinout"),
    ]
    for names in (GRANT_COLUMNS, FUNDRAISING_COLUMNS):
        count, amount, latest = names.items()
        columns += [
            quoted(count[1]).cast("double").alias(count[0]),
            currency(quoted(amount[1])).alias(amount[0]),
            quoted(latest[1]).alias(latest[0]),
        ]
    kept = [c for c in df.columns if c in ("company_id", "ordinal")]
    return df.select(*kept, *columns)


def ratio_features(df: DataFrame, url: str) -> DataFrame:
    """Ratios of the latest statement, valid only for the year of its accounts."""
    kept = [c for c in df.columns if c in ("company_id", "ordinal")]
    ratios = [
        quoted(f"Financial Statement 1 - {src}").cast("double").alias(out)
        for src, out in STATEMENT_RATIOS.items()
        if f"Financial Statement 1 - {src}" in df.columns
    ]
    year = F.year(quoted(STATEMENT_DATE.format(n=1)))
    out = df.select(*kept, normalized_url(F.col(url)).alias("url_norm"), year.alias("year"), *ratios)
    return out.filter(F.col("year").isNotNull())


def add_recency(df: DataFrame) -> DataFrame:
    year = F.col("year")
    return (
        df.withColumn("grant_recency_years", recency(year, F.col("grants_latest_date")))
        .withColumn("fundraising_recency_years", recency(year, F.col("fundraising_latest_date")))
        .drop("grants_latest_date", "fundraising_latest_date")
    )


def join_signals(df: DataFrame, signals: DataFrame, bridge: DataFrame) -> DataFrame:
    """Signals by company through the URL bridge; recency by panel year.

    Rows of one URL are reduced to their first before the join, so a URL that
    many rows share reaches it as a single row."""
    by_url = first_per_key(signals, ["url_norm"], ["ordinal"])
    matched = by_url.join(bridge, "url_norm").drop("url_norm")
    one = first_per_key(matched, ["company_id"], ["ordinal"]).drop("ordinal")
    return add_recency(df.join(one, "company_id", "left"))


def join_ratios(df: DataFrame, ratios: DataFrame, bridge: DataFrame) -> DataFrame:
    by_url = first_per_key(ratios, ["url_norm", "year"], ["ordinal"])
    matched = by_url.join(bridge, "url_norm").drop("url_norm")
    one = first_per_key(matched, ["company_id", "year"], ["ordinal"]).drop("ordinal")
    return df.join(one, ["company_id", "year"], "left")


def per_employee(df: DataFrame) -> DataFrame:
    head = F.col("total_employees")
    return df.withColumn("assets_per_employee", ratio(F.col("balance_sheet_total_assets"), head)).withColumn(
        "export_revenue_per_employee", ratio(F.col("total_export_revenue"), head)
    )


def with_age(df: DataFrame) -> DataFrame:
    return df.withColumn("company_age_years", age(F.col("year"), F.col("founded_year")))


def body_flags(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("is_public_sector_body", public_body_flag(F.col(name))).withColumn(
        "is_international_research_body", research_body_flag(F.col(name))
    )


def estimation_features(
    panel: DataFrame, static: DataFrame, sizes: DataFrame, signals: DataFrame, ratios: DataFrame,
    bridge: DataFrame, name: str,
) -> tuple[DataFrame, DataFrame]:
    """Full feature rows of the labelled panel and the log of negative ages.

    `static` has founded_year, sic_code_1, value_stream per company; `sizes` the
    size label per company-year."""
    out = panel.join(static, "company_id", "left").join(sizes, ["company_id", "year"], "left")
    out = per_employee(out.withColumn("company_age_years", F.col("year") - F.col("founded_year")))
    out, age_log = null_negative_age(out)
    log = age_log.select("company_id", "year", "founded_year", "original_company_age_years", "reason")
    out = join_ratios(join_signals(out, signals, bridge), ratios, bridge)
    return body_flags(out, name), log


def prediction_features(
    snapshot: DataFrame, static: DataFrame, signals: DataFrame, ratios: DataFrame, bridge: DataFrame, name: str
) -> DataFrame:
    """The training features for snapshot rows of companies without turnover."""
    out = snapshot.join(static, "company_id", "left")
    out = per_employee(employee_columns(with_age(out)))
    return body_flags(join_ratios(join_signals(out, signals, bridge), ratios, bridge), name)


def size_from_employees(df: DataFrame, employees: str = "total_employees") -> DataFrame:
    return df.withColumn("company_size", size_bucket(F.col(employees)))
