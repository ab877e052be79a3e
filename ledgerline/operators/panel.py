"""Reshaping wide and statement-style records to (company, year) panels."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio
from ledgerline.functions.text import normalized_url
from ledgerline.operators.keys import first_per_key, with_count
from ledgerline.operators.quality import check_turnover
from ledgerline.settings import (
    SPACE,
    STALE_AFTER_YEARS,
    STATEMENT_DATE,
    STATEMENT_FIELDS,
    STATEMENTS,
    YEAR_MEASURES,
    YEARS,
)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def turnover_columns(df: DataFrame, years: list[int] = YEARS) -> list[str]:
    names = [YEAR_MEASURES["total_turnover"].format(year=y) for y in years]
    return [n for n in names if n in df.columns]


def _measure(df: DataFrame, measure: str, year: int) -> Column:
    name = YEAR_MEASURES[measure].format(year=year)
    if name in df.columns:
        return quoted(name).alias(measure)
    kind = "string" if measure == "company_size" else "double"
    return F.lit(None).cast(kind).alias(measure)


def _has_any(df: DataFrame, measures: list[str], year: int) -> bool:
    return any(YEAR_MEASURES[m].format(year=year) in df.columns for m in measures)


def year_records(df: DataFrame, measures: list[str], years: list[int] = YEARS) -> Column:
    """Array of (year, measures...) structs built from the wide year columns."""
    present = [y for y in years if _has_any(df, measures, y)]
    return F.array(
        *[F.struct(F.lit(y).alias("year"), *[_measure(df, m, y) for m in measures]) for y in present]
    )


def melt_years(
    df: DataFrame, ids: list[str], measures: list[str], years: list[int] = YEARS
) -> DataFrame:
    """One row per id and year, all measures in one pass over the wide table."""
    return df.select(*ids, F.inline(year_records(df, measures, years)))


def employee_columns(df: DataFrame) -> DataFrame:
    """Filed head count first, else the estimate, with the source of the value."""
    filed, estimated = F.col("total_employees_ch"), F.col("total_employees_est")
    return df.withColumn("total_employees", F.coalesce(filed, estimated)).withColumn(
        "employee_count_source",
        F.when(filed.isNotNull(), "filed").when(estimated.isNotNull(), "estimated"),
    )


def inverse_weight(df: DataFrame, key: str = "company_id") -> DataFrame:
    counted = with_count(df, [key], "_rows")
    return counted.withColumn("sample_weight", F.lit(1.0) / F.col("_rows")).drop("_rows")


def long_panel(df: DataFrame, ids: list[str], years: list[int] = YEARS) -> tuple[DataFrame, DataFrame]:
    """Labelled panel: one row per company-year with valid observed turnover."""
    measures = [m for m in YEAR_MEASURES if m != "company_size"]
    rows = melt_years(df, ids, measures, years).filter(F.col("total_turnover").isNotNull())
    checked, log = check_turnover(rows, "total_turnover")
    kept = inverse_weight(employee_columns(checked.filter(F.col("total_turnover").isNotNull())))
    log = log.select(*ids, "year", "total_turnover", "exclusion_reason")
    return kept.withColumn("population_type", F.lit(SPACE)), log


def latest_observed(df: DataFrame, ids: list[str], years: list[int] = YEARS) -> DataFrame:
    """Most recent year with a turnover value per row of the wide table."""
    records = F.filter(year_records(df, ["total_turnover"], years), lambda r: r["total_turnover"].isNotNull())
    rows = df.select(*ids, F.array_max(records).alias("_last")).filter(F.col("_last").isNotNull())
    best = rows.groupBy(*ids).agg(F.max("_last").alias("_last"))
    return best.select(*ids, F.col("_last.year"), F.col("_last.total_turnover").alias("turnover_value"))


def covariate_snapshot(df: DataFrame, years: list[int] = YEARS) -> DataFrame:
    """Most recent year with any covariate; else the last year, all empty.

    Works on one wide row at a time, so no shuffle is needed."""
    measures = [m for m in YEAR_MEASURES if m != "total_turnover"]
    records = year_records(df, measures, years)

    def any_value(r: Column) -> Column:
        return F.coalesce(*[r[m].cast("string") for m in measures]).isNotNull()

    found = F.filter(records, any_value)
    last = F.element_at(found, -1)
    rest = [c for c in df.columns if not _is_year_column(c, years)]
    out = df.select(*[quoted(c) for c in rest], F.when(F.size(found) > 0, last).alias("_s"))
    return out.select(
        *[quoted(c) for c in rest],
        F.coalesce(F.col("_s.year"), F.lit(max(years))).alias("year"),
        *[F.col(f"_s.{m}").alias(m) for m in measures],
        F.col("_s").isNull().alias("is_fallback_year"),
    )


def _is_year_column(name: str, years: list[int]) -> bool:
    return any(name == fmt.format(year=y) for fmt in YEAR_MEASURES.values() for y in years)


def statement_records(df: DataFrame, ids: list[Column], fields: dict[str, str]) -> DataFrame:
    """One row per numbered statement block that exists and has a date."""
    blocks = []
    for n in range(1, STATEMENTS + 1):
        names = [STATEMENT_DATE.format(n=n)] + [f.format(n=n) for f in fields.values()]
        if all(name in df.columns for name in names):
            values = [quoted(f.format(n=n)).cast("double").alias(k) for k, f in fields.items()]
            blocks.append(
                F.struct(F.lit(n).alias("statement"), F.year(quoted(names[0])).alias("year"), *values)
            )
    return df.select(*ids, F.inline(F.array(*blocks))).filter(F.col("year").isNotNull())


def statement_panel(df: DataFrame, order: str) -> DataFrame:
    """(company, year) panel from statement blocks; the lowest block number wins."""
    rows = statement_records(df, [F.col("company_id"), F.col(order)], STATEMENT_FIELDS)
    best = first_per_key(rows, ["company_id", "year"], ["statement", order])
    return best.drop("statement", order)


def url_bridge(df: DataFrame, url: str, order: str) -> DataFrame:
    """Unique normalised URL to company id; the first id wins on a shared URL."""
    norm = df.select(normalized_url(F.col(url)).alias("url_norm"), "company_id", order)
    known = norm.filter(F.col("url_norm").isNotNull())
    return known.groupBy("url_norm").agg(F.min_by("company_id", order).alias("company_id"))


def weeks_factors(statements: DataFrame, bridge: DataFrame, url: str, order: str) -> DataFrame:
    """52 / weeks per company-year over all statement blocks, joined by URL."""
    fields = {"weeks": STATEMENT_FIELDS["weeks"]}
    rows = statement_records(
        statements, [normalized_url(F.col(url)).alias("url_norm"), F.col(order)], fields
    ).filter(F.col("weeks").isNotNull())
    by_url = first_per_key(rows, ["url_norm", "year"], ["statement", order])
    matched = by_url.join(bridge, "url_norm").drop("url_norm")
    best = first_per_key(matched, ["company_id", "year"], ["statement", order])
    return best.select(
        "company_id", "year", "weeks", ratio(F.lit(52.0), F.col("weeks")).alias("annualization_factor")
    )


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, failing the job if a key appears twice."""
    rest = [c for c in df.columns if c not in keys]
    facts = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    twice = F.raise_error(F.lit(f"repeated key in {', '.join(keys)}")).cast("int")
    return facts.withColumn("_n", F.when(F.col("_n") > 1, twice)).filter(F.col("_n").isNull()).drop("_n")


def annualize(
    df: DataFrame, value: str, year: str, factors: DataFrame, eligible: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scale turnover of irregular accounting periods to 52 weeks.

    A company-year without a factor keeps its value; `eligible` limits which rows
    may change (a modelled value belongs to no accounting period)."""
    unique = unique_rows(
        factors.select("company_id", F.col("year").alias("_year"), "weeks", "annualization_factor"),
        ["company_id", "_year"],
    ).withColumnRenamed("company_id", "_id")
    joined = df.join(unique, (df["company_id"] == F.col("_id")) & (df[year] == F.col("_year")), "left")
    factor = F.coalesce(F.col("annualization_factor"), F.lit(1.0))
    changed = (factor != 1.0) & F.col(value).isNotNull() & (F.lit(True) if eligible is None else eligible)
    log = joined.filter(changed).select(
        "company_id",
        F.col(year),
        F.col(value).alias("raw_turnover"),
        "weeks",
        "annualization_factor",
        (F.col(value) * factor).alias("annualized_turnover"),
    )
    scaled = F.when(F.coalesce(changed, F.lit(False)), F.col(value) * factor).otherwise(F.col(value))
    return joined.withColumn(value, scaled).select(*df.columns), log


def annualization_stats(log: DataFrame, panel: DataFrame) -> DataFrame:
    """Corrected rows, strong distortions and factor range per mission."""
    spread = F.abs(F.col("annualization_factor") - 1)
    corrected = log.join(panel.select("company_id", "year", "mission"), ["company_id", "year"], "left")
    changed = corrected.groupBy("mission").agg(
        F.count("*").alias("corrected_rows"),
        F.count_if(spread > 0.30).alias("rows_over_30pct"),
        F.min("annualization_factor").alias("min_factor"),
        F.max("annualization_factor").alias("max_factor"),
        F.count_distinct("company_id").alias("companies"),
    )
    totals = panel.groupBy("mission").agg(
        F.count("*").alias("panel_rows"), F.count_if(F.col("weeks") != 52).alias("irregular_rows")
    )
    return totals.join(changed, "mission", "left").withColumn(
        "irregular_share", F.col("irregular_rows") / F.col("panel_rows")
    )


def staleness(df: DataFrame, year: str = "year") -> DataFrame:
    """Age of each value against the latest observed year of the whole table."""
    observed = F.col("turnover_source") == "observed"
    latest = df.filter(observed).select(F.max(year)).scalar()
    aged = df.withColumn("turnover_age_years", latest - F.col(year))
    stale = observed & (F.col("turnover_age_years") > STALE_AFTER_YEARS)
    return aged.withColumn("turnover_is_stale", F.coalesce(stale, F.lit(False)))


def history_properties(panel: DataFrame) -> DataFrame:
    """Observed years, span and latest unbroken run of each company."""
    years = panel.groupBy("company_id", "accounting_year").agg(F.count("*").alias("_rows"))
    by_year = Window.partitionBy("company_id").orderBy("accounting_year")
    island = F.col("accounting_year") - F.row_number().over(by_year)
    # The island number grows along the years, so the last run has the largest one.
    runs = years.withColumn("_island", island)
    facts = runs.groupBy("company_id").agg(
        F.sum("_rows").alias("n_turnover_years"),
        F.min("accounting_year").alias("first_turnover_year"),
        F.max("accounting_year").alias("latest_turnover_year"),
        F.min(F.struct(-F.col("_island"), F.col("accounting_year")))["accounting_year"].alias("_run_start"),
    )
    latest = panel.select(F.max("accounting_year")).scalar()
    last, first = F.col("latest_turnover_year"), F.col("first_turnover_year")
    return facts.select(
        "company_id",
        "n_turnover_years",
        "first_turnover_year",
        "latest_turnover_year",
        (last - first).alias("history_span"),
        (latest - last).alias("years_since_latest_turnover"),
        (last - F.col("_run_start") + 1).alias("consecutive_history_length"),
    )
