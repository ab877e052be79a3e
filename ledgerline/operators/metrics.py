"""Error metrics as aggregates, and fold-table statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.keys import join_facts
from ledgerline.settings import BROKEN_FOLD_R2, MAE_BLOWUP

METRICS = ["MAE", "RMSE", "R2"]


def r_squared(residual_sum: Column, total_sum: Column) -> Column:
    perfect = F.when(residual_sum == 0, 1.0).otherwise(0.0)
    return F.when(total_sum == 0, perfect).otherwise(1.0 - residual_sum / total_sum)


def weighted_metrics(df: DataFrame, groups: list[str], actual: str, predicted: str, weight: str) -> DataFrame:
    """R2 against squares around the weighted mean, which large values with a small spread don't cancel."""
    y, p, w = F.col(actual), F.col(predicted), F.col(weight)
    means = df.groupBy(*groups).agg((F.sum(w * y) / F.sum(w)).alias("_mean"))
    from_mean = y - F.col("_mean")
    sums = join_facts(df, means, groups).groupBy(*groups).agg(
        F.count("*").alias("n_test_rows"),
        F.sum(w).alias("_w"),
        F.sum(w * F.abs(y - p)).alias("_a"),
        F.sum(w * (y - p) * (y - p)).alias("_s"),
        F.sum(w * from_mean * from_mean).alias("_t"),
    )
    total = F.col("_t")
    return sums.select(
        *groups,
        "n_test_rows",
        (F.col("_a") / F.col("_w")).alias("MAE"),
        F.sqrt(F.col("_s") / F.col("_w")).alias("RMSE"),
        F.when(F.col("n_test_rows") >= 2, r_squared(F.col("_s"), total)).alias("R2"),
    )


def metrics_of_moments(df: DataFrame, groups: list[str]) -> DataFrame:
    """The metrics above from moments of parts of each group (n, w, mean, around, low, high, off, squares), as
    gram.score_moments sums them; rows without a weight have w = n."""
    n, w, mean = F.col("n"), F.col("w"), F.col("mean")
    means = df.groupBy(*groups).agg((F.sum(w * mean) / F.sum(w)).alias("_mean"))
    from_mean = mean - F.col("_mean")
    equal = F.min("low") == F.max("high")  # rounding of the means must not give equal labels a spread
    sums = join_facts(df, means, groups).groupBy(*groups).agg(
        F.sum(n).alias("n_test_rows"),
        F.sum(w).alias("_w"),
        F.sum("off").alias("_a"),
        F.sum("squares").alias("_s"),
        F.when(equal, 0.0).otherwise(F.sum(F.col("around") + w * from_mean * from_mean)).alias("_t"),
    )
    return sums.select(
        *groups,
        "n_test_rows",
        (F.col("_a") / F.col("_w")).alias("MAE"),
        F.sqrt(F.col("_s") / F.col("_w")).alias("RMSE"),
        F.when(F.col("n_test_rows") >= 2, r_squared(F.col("_s"), F.col("_t"))).alias("R2"),
    )


def metrics(df: DataFrame, groups: list[str], actual: str, predicted: str) -> DataFrame:
    """Unweighted metrics; R2 is null below two rows."""
    y, p = F.col(actual), F.col(predicted)
    sums = df.groupBy(*groups).agg(
        F.count("*").alias("n_test_rows"),
        F.avg(F.abs(y - p)).alias("MAE"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("RMSE"),
        F.sum((y - p) * (y - p)).alias("_s"),
        (F.var_pop(y) * F.count("*")).alias("_t"),
    )
    r2 = F.when(F.col("n_test_rows") >= 2, r_squared(F.col("_s"), F.col("_t")))
    return sums.withColumn("R2", r2).drop("_s", "_t")


def metric_summary(folds: DataFrame, groups: list[str]) -> DataFrame:
    stats = []
    for m in METRICS:
        stats += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy(*groups).agg(
        *stats, F.count("MAE").alias("n_folds"), F.sum("n_test_rows").alias("n_test_rows_total")
    )


def robustness(folds: DataFrame, groups: list[str]) -> DataFrame:
    """Broken or blown-up folds per model; a group holds one row per fold."""
    facts = folds.groupBy(*groups).agg(
        F.coalesce(F.bool_or(F.col("R2") < BROKEN_FOLD_R2), F.lit(False)).alias("had_broken_fold_r2"),
        F.percentile("MAE", 0.5).alias("_median"),
        F.max("MAE").alias("max_fold_mae"),
        F.min("R2").alias("worst_fold_r2"),
    )
    blown = (F.col("_median") > 0) & (F.col("max_fold_mae") > MAE_BLOWUP * F.col("_median"))
    return (
        facts.withColumn("had_mae_blowup_fold", F.coalesce(blown, F.lit(False)))
        .withColumn("robustness_violation", F.col("had_broken_fold_r2") | F.col("had_mae_blowup_fold"))
        .drop("_median")
    )


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    y, p = F.col(actual), F.col(predicted)
    return df.withColumns(
        {
            "residual": y - p,
            "abs_residual": F.abs(y - p),
            "pct_error": F.try_divide(y - p, y) * 100,
        }
    )


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Non-null count per feature, one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in features])
    return counts.unpivot([], features, "feature", "non_null")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows"))
