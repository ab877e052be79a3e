"""Ranking of candidate models and choice of winners, all on fold tables.

These tables hold one row per model and fold, so their windows stay small."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.metrics import metric_summary, robustness
from ledgerline.operators.ranks import rank_of
from ledgerline.settings import (
    BENCHMARKS,
    FORECAST_SIMPLICITY,
    R2_TOLERANCE,
    RANK_TOLERANCE,
    USABLE_R2,
)

# Metric and whether larger is better.
RANKED = {
    "MAE_mean": False,
    "RMSE_mean": False,
    "R2_mean": True,
    "MAE_std": False,
    "RMSE_std": False,
    "R2_std": False,
}


def composite_rank(summary: DataFrame, groups: list[str], metrics: dict[str, bool] = RANKED) -> DataFrame:
    """Average rank over the metrics a model has, to two decimals."""
    keys = [F.col(g) for g in groups]
    out = summary.withColumns({f"rank_{m}": rank_of(F.col(m), keys, up) for m, up in metrics.items()})
    ranks = [F.col(f"rank_{m}") for m in metrics]
    total = sum((F.coalesce(r, F.lit(0.0)) for r in ranks), F.lit(0.0))
    n = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    return out.withColumn("composite_rank", F.bround(F.try_divide(total, n.cast("double")), 2))


def simplicity(model: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(model == name, rank).otherwise(out)
    return out


def ranked_models(
    folds: DataFrame, groups: list[str], ranks: dict[str, int] = FORECAST_SIMPLICITY
) -> DataFrame:
    keys = [*groups, "Model"]
    ranked = composite_rank(metric_summary(folds, keys), groups)
    return ranked.join(robustness(folds, keys), keys).withColumn(
        "simplicity_rank", simplicity(F.col("Model"), ranks)
    )


def pick_winner(ranked: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: winner, runner-up, margins and how the choice was made.

    Robust models compete (all of them if none is robust). Among models close to
    the best one in rank and R2 the simplest wins."""
    group = Window.partitionBy(*groups)
    robust = ~F.col("robustness_violation")
    pool = ranked.withColumn("_robust", F.count_if(robust).over(group)).filter(
        robust | (F.col("_robust") == 0)
    )
    by_rank = [F.col("composite_rank"), F.col("simplicity_rank"), F.col("Model")]
    pool = pool.withColumn("_place", F.row_number().over(group.orderBy(*by_rank)))
    is_top = F.col("_place") == 1
    pool = pool.withColumns(
        {
            "_top_rank": F.max(F.when(is_top, F.col("composite_rank"))).over(group),
            "_top_r2": F.max(F.when(is_top, F.col("R2_mean"))).over(group),
            "_top_model": F.max(F.when(is_top, F.col("Model"))).over(group),
        }
    )
    close = (F.col("composite_rank") <= F.col("_top_rank") + RANK_TOLERANCE) & (
        F.abs(F.col("R2_mean") - F.col("_top_r2")) < R2_TOLERANCE
    )
    pool = pool.withColumn("_close", F.coalesce(close, F.lit(False)) | is_top)
    simplest = [F.col("_close").desc(), F.col("simplicity_rank"), F.col("composite_rank"), F.col("Model")]
    pool = pool.withColumn("_winner", F.row_number().over(group.orderBy(*simplest)) == 1)
    pool = pool.withColumn(
        "_second", ~F.col("_winner") & (F.row_number().over(group.orderBy("_winner", *by_rank)) == 1)
    )
    carried = ["Model", *RANKED]
    out = pool.groupBy(*groups).agg(
        F.max(F.when(F.col("_winner"), F.struct(*carried))).alias("w"),
        F.max(F.when(F.col("_second"), F.struct(*carried))).alias("r"),
        F.count_if("_close").alias("_n_close"),
        F.max("_robust").alias("_n_robust"),
        F.max("_top_model").alias("top_ranked_model"),
    )
    beats = [
        F.when((F.col(f"w.{m}") > F.col(f"r.{m}")) if up else (F.col(f"w.{m}") < F.col(f"r.{m}")), m)
        for m, up in RANKED.items()
    ]
    mae_gap = F.col("r.MAE_mean") - F.col("w.MAE_mean")
    return out.select(
        *groups,
        F.col("w.Model").alias("selected_model"),
        F.col("r.Model").alias("runner_up"),
        F.concat_ws(",", *beats).alias("beats_runner_up_on"),
        (F.col("w.R2_mean") - F.col("r.R2_mean")).alias("margin_r2"),
        F.when(F.col("r.MAE_mean") > 0, mae_gap / F.col("r.MAE_mean") * 100).alias("margin_mae_pct"),
        F.col("w.R2_mean").alias("r2_mean"),
        (F.col("_n_close") > 1).alias("tie_break_used"),
        (F.col("_n_robust") == 0).alias("fallback_used_no_robust_survivor"),
        "top_ranked_model",
        (F.col("w.Model") == F.col("top_ranked_model")).alias("winner_is_top_ranked"),
    )


def usability(selected: DataFrame) -> DataFrame:
    """Whether a selected model beats predicting the mean, and why not."""
    usable = F.coalesce(F.col("r2_mean") > USABLE_R2, F.lit(False))
    # Reason text.
    reason = F.concat(
        F.lit("no reliable model available — best model ("),
        F.col("selected_model"),
        F.lit(") has R2_mean="),
        F.format_string("%.2f", "r2_mean"),
        F.lit(
            ", at or below the usability threshold (0.0); insufficient labelled data / "
            "no genuine predictive value under repeated cross-validation"
        ),
    )
    return selected.withColumn("usable", usable).withColumn(
        "exclusion_reason", F.when(usable, "").otherwise(reason)
    )


def forecast_selection(folds: DataFrame) -> DataFrame:
    """Winner per mission and horizon; horizon 1 drives the recursion."""
    picked = pick_winner(ranked_models(folds, ["mission", "horizon"]), ["mission", "horizon"])
    return usability(picked).withColumns(
        {
            "is_primary_recursive_model": F.col("horizon") == "1",
            "is_benchmark": F.col("selected_model").isin(BENCHMARKS),
            "runner_up_is_benchmark": F.col("runner_up").isin(BENCHMARKS),
        }
    )


def override_selection(selected: DataFrame, locked: DataFrame) -> DataFrame:
    """Replace the ranked choice of a mission by a recorded decision.

    `locked` has mission, selected_model, adjacent_weight, r2_mean, reason."""
    chosen = locked.select(
        "mission",
        F.col("selected_model").alias("_model"),
        F.col("r2_mean").alias("_r2"),
        F.col("adjacent_weight"),
        F.col("reason").alias("override_reason"),
    )
    joined = selected.join(chosen, "mission", "full_outer")
    locked_row = F.col("_model").isNotNull()
    return usability(
        joined.withColumn("selected_model", F.coalesce("_model", "selected_model"))
        .withColumn("r2_mean", F.when(locked_row, F.col("_r2")).otherwise(F.col("r2_mean")))
        .withColumn("is_locked", locked_row)
        .drop("_model", "_r2")
    )


def subgroup_ranks(scores: DataFrame, subgroup: str, ranks: dict[str, int] = FORECAST_SIMPLICITY) -> DataFrame:
    """Average rank of MAE, RMSE and R2 inside each subgroup, simplest first on ties."""
    ranked = composite_rank(scores, [subgroup], {"MAE": False, "RMSE": False, "R2": True})
    ranked = ranked.withColumn("simplicity_rank", simplicity(F.col("Model"), ranks))
    order = Window.partitionBy(subgroup).orderBy("composite_rank", "simplicity_rank", "Model")
    return ranked.withColumn("place", F.row_number().over(order))


def pooled_comparison(pooled: DataFrame, selected: DataFrame) -> DataFrame:
    """Pooled model sliced per mission next to the mission's own model."""
    own = selected.select(
        "mission",
        F.col("selected_model").alias("mission_specific_model"),
        F.col("r2_mean").alias("mission_specific_R2_mean"),
    )
    theirs = pooled.select(
        "mission", F.col("Model").alias("pooled_model"), F.col("R2_mean").alias("pooled_R2_mean"),
        F.col("MAE_mean").alias("pooled_MAE_mean"),
    )
    beats = F.col("pooled_R2_mean") > F.col("mission_specific_R2_mean")
    return own.join(theirs, "mission", "left").withColumn("pooled_beats_mission_specific_R2", beats)


def structure_score(parts: DataFrame) -> DataFrame:
    """Size-weighted R2 over the sub-models of each structure."""
    return parts.groupBy("mission").agg(
        F.try_divide(F.sum(F.col("n") * F.col("R2")), F.sum("n")).alias("weighted_r2"),
        F.sum("n").alias("n"),
    )
