"""Analyses described alongside the models: backtests, concentration, skew, ranks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import ratio
from ledgerline.operators import gram
from ledgerline.operators.metrics import r_squared
from ledgerline.operators.panel import quoted
from ledgerline.operators.preprocess import FeatureSet
from ledgerline.operators.ranks import attach, cell_starts, quantile, salt_of, with_cells
from ledgerline.settings import ACCELERATOR_SLOTS


def backtest_rows(training: DataFrame, predicted: str, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """Test-window rows of companies that also have training-window rows."""
    year = F.col("target_year")
    known = training.filter(year.between(*train)).select("company_id").distinct()
    rows = training.filter(year.between(*test)).join(known, "company_id", "left_semi")
    return rows.select(
        "company_id", "mission", F.col("target_turnover_next_year").alias("actual"), F.col(predicted).alias("predicted")
    )


def fitted_backtest(
    training: DataFrame, features: FeatureSet, target: str, train: tuple[int, int], test: tuple[int, int]
) -> DataFrame:
    """Held-out Ridge predictions of the test window, tuned and fitted on the training window alone,
    of companies that have rows in both."""
    year = F.col("target_year")
    known = training.filter(year.between(*train)).select("company_id").distinct()
    rows = training.filter(year.between(*train)).unionByName(training.filter(year.between(*test)).join(known, "company_id", "left_semi"))
    cut, outers = gram.yearly_cells(rows, cutoffs=[train[1]])
    scored = gram.out_of_fold(
        cut, outers, {"Ridge": gram.FORECAST_LINEAR["Ridge"]}, features, target, None, ["company_id", "mission"], F.col("mission")
    )
    return scored.select("company_id", "mission", "actual", "predicted")


def temporal_backtest(rows: DataFrame) -> DataFrame:
    """R2 with and without the largest company, and the median percentage error."""
    y, p = F.col("actual"), F.col("predicted")
    peaks = rows.groupBy("mission").agg(F.max_by("company_id", F.struct("actual", "company_id")).alias("largest"))
    marked = attach(rows, peaks, ["mission"]).withColumn("rest", F.col("company_id") != F.col("largest"))
    rest = F.col("rest")
    sums = marked.groupBy("mission").agg(
        F.count("*").alias("n_test_rows"),
        r_squared(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count("*")).alias("R2"),
        r_squared(
            F.sum(F.when(rest, (y - p) * (y - p))), F.var_pop(F.when(rest, y)) * F.count_if(rest)
        ).alias("R2_without_largest"),
    )
    error = rows.withColumn("error", F.abs(F.try_divide(y - p, y)) * 100)
    return attach(sums, quantile(error, ["mission"], "error", 0.5, "median_abs_pct_error"), ["mission"])


def error_concentration(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """Share of the weighted squared error of a mission that each company causes."""
    e = F.col(actual) - F.col(predicted)
    own = df.groupBy("mission", "company_id").agg(F.sum(F.col(weight) * e * e).alias("error"))
    totals = own.groupBy("mission").agg(F.sum("error").alias("total"))
    return attach(own, totals, ["mission"]).withColumn("share", F.try_divide("error", "total")).drop("total")


def outlier_scan(engineered: DataFrame, factor: float = 50.0) -> DataFrame:
    """Company-years with extreme turnover swings, with their turnover per head."""
    swing = ratio(F.col("turnover_t"), F.col("turnover_lag_1"))
    per_head = ratio(F.col("turnover_t"), F.col("employees"))
    out = engineered.withColumn("swing", swing).withColumn("turnover_per_employee", per_head)
    return out.filter((F.col("swing") > factor) | (F.col("swing") < 1 / factor))


def leakage_check(df: DataFrame, formulas: dict[str, tuple[str, str, float]]) -> DataFrame:
    """How closely each ratio is rebuilt from a numerator and denominator.

    A ratio that is rebuilt exactly from turnover gives the target away."""
    rows = []
    for name, (top, bottom, scale) in formulas.items():
        rebuilt = F.try_divide(F.col(top), F.col(bottom)) * scale
        gap = F.abs(F.try_divide(F.col(name) - rebuilt, rebuilt))
        rows.append(
            F.struct(
                F.lit(name).alias("ratio"),
                F.count(gap).alias("compared"),
                F.count_if(gap < 1e-6).alias("exact"),
                F.avg(gap).alias("mean_gap"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def spearman(df: DataFrame, groups: list[str], features: list[str], target: str, out: str) -> DataFrame:
    """Rank correlation of every feature with the target per group, from exact average ranks.

    A feature's ranks are taken over the rows that have it. The target is ranked for all features
    at once, one row a company-year, and then each feature, one row a value; both within cells of
    the value range whose first ranks were counted before."""

    def number(column: str) -> Column:
        x = F.col(column).cast("double") + F.lit(0.0)  # no negative zero
        return F.when(~F.isnan(x), x)

    values, cells = [f"a{i}" for i in range(len(features))], [f"cell{i}" for i in range(len(features))]
    rows = df.select(*groups, number(target).alias("b"), *[number(c).alias(v) for c, v in zip(features, values)])
    rows = with_cells(rows.filter(F.col("b").isNotNull()), {"b": "b_cell", **dict(zip(values, cells))})

    def by_feature(rows: DataFrame, keep: list[str], extra: dict[str, list[Column]]) -> DataFrame:
        """One row a value."""
        parts = [
            F.struct(F.lit(i).alias("feature"), F.col(v).alias("a"), F.col(c).alias("a_cell"), *[x[i].alias(n) for n, x in extra.items()])
            for i, (v, c) in enumerate(zip(values, cells))
        ]
        return rows.select(*groups, *keep, F.inline(F.array(*parts))).filter(F.col("a").isNotNull())

    keys = [*groups, "feature"]
    long = by_feature(rows, ["b", "b_cell"], {})
    a_starts, b_starts = cell_starts(long, keys, "a_cell", "a"), cell_starts(long, keys, "b_cell", "b")

    single = rows.groupBy(*groups, "b_cell").agg((F.min("b") == F.max("b")).alias("single"))
    dealt = attach(rows, single, [*groups, "b_cell"]).withColumn("salt", salt_of(F.col("single"), *values)).drop("single")
    cell = Window.partitionBy(*groups, "b_cell", "salt")
    upto = [F.count(v).over(cell.orderBy("b").rangeBetween(Window.unboundedPreceding, 0)) for v in values]
    equal = [F.count(v).over(Window.partitionBy(*groups, "b_cell", "salt", "b")) for v in values]
    inside = {f"r{i}": u - (e - 1) / F.lit(2.0) for i, (u, e) in enumerate(zip(upto, equal))}
    placed = by_feature(dealt.withColumns(inside), ["b_cell"], {"inside": [F.col(r) for r in inside]})
    placed = attach(placed, b_starts, [*keys, "b_cell"])
    rank = F.col("base") + F.when(F.col("single"), 0.0).otherwise(F.col("inside"))
    placed = placed.select(*keys, "a", "a_cell", rank.alias("rb"))

    placed = attach(placed, a_starts, [*keys, "a_cell"]).withColumn("salt", salt_of(F.col("single"), "rb")).drop("single")
    ordered = Window.partitionBy(*keys, "a_cell", "salt").orderBy("a")
    last = F.count("a").over(ordered.rangeBetween(Window.unboundedPreceding, 0))
    rank = F.col("base") + F.when(F.col("salt") < 0, (F.rank().over(ordered) + last) / F.lit(2.0)).otherwise(0.0)
    ranked = placed.select(*keys, rank.alias("ra"), "rb")
    spread = F.stddev_pop("ra") * F.stddev_pop("rb")
    rho = ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("ra", "rb"), spread).alias(out))
    return rho.withColumn("feature", F.get(F.array(*[F.lit(c) for c in features]), F.col("feature")))


def slot_profile(signals: DataFrame, key: str) -> DataFrame:
    """Distinct companies per accelerator over all attendance slots."""
    slots = [quoted(c) for c in ACCELERATOR_SLOTS if c in signals.columns]
    names = signals.select(key, F.explode(F.array(*slots)).alias("accelerator"))
    known = names.filter(F.col("accelerator").isNotNull()).distinct()
    return known.groupBy("accelerator").agg(F.count("*").alias("companies"))


def attendee_split(companies: DataFrame, signals: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Age and evidence, by mission, of companies that attended an accelerator of at least `least`
    companies, and of all others; `companies` has key, mission, age, forecast_evidence_group."""
    slots = [quoted(c) for c in ACCELERATOR_SLOTS if c in signals.columns]
    names = signals.select(key, F.explode(F.array(*slots)).alias("accelerator"))
    known = names.filter(F.col("accelerator").isNotNull()).distinct()
    large = known.groupBy("accelerator").agg(F.count("*").alias("companies")).filter(F.col("companies") >= least)
    members = attach(known, large, ["accelerator"], "inner").select(key).distinct()
    rows = companies.join(members.withColumn("attended", F.lit(True)), key, "left").fillna(False, ["attended"])
    groups = ["mission", "attended"]
    facts = rows.groupBy(*groups).agg(
        F.count("*").alias("companies"),
        F.avg("age").alias("mean_age"),
        F.avg((F.col("forecast_evidence_group") == "D").cast("double")).alias("share_without_turnover"),
    )
    return attach(facts, quantile(rows, groups, "age", 0.5, "median_age"), groups)


def skewness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Skewness of each column before and after the log transform."""
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.skewness(c).alias("raw"), F.skewness(F.log1p(c)).alias("logged")
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
