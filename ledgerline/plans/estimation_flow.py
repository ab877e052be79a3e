"""The estimation from the wide master to the completed table and the forecast's inputs.

Identity, segments, the eligibility gate, panel, features, model selection, scoring and the
cascade feed each other; the completed table, validated and annualised, is the baseline that
`ForecastFlow` starts from. Stages that several later ones read are written once."""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import features, gram, identity, metrics, panel, preprocess, quality, scoring, segments, selection
from ledgerline.operators.preprocess import ESTIMATION_SET
from ledgerline.plans.flow import ForecastFlow
from ledgerline.settings import CROSS_CUTTING, SIMPLICITY, YEAR_MEASURES, YEARS
from ledgerline.sources.writers import written

YEAR_COLUMNS = [YEAR_MEASURES["total_turnover"].format(year=y) for y in YEARS]
STATIC = ["founded_year", "sic_code_1", "value_stream"]
# The forecast's names of the estimation's columns.
HISTORY = {
    "year": "accounting_year",
    "total_turnover": "turnover",
    "total_employees": "employees",
    "balance_sheet_total_assets": "total_assets",
    "total_export_revenue": "export_revenue",
    "company_age_years": "company_age",
}
BASELINE = {"year": "baseline_year", "turnover_value": "baseline_turnover", "reliability": "baseline_reliability"}


class EstimationFlow:
    """`master` has one row per company with ids, facts and a column per measure and year; `mapping`
    gives each value stream's mission, `misplaced` the companies out of scope (company_id, note);
    `statements` and `signals` are keyed by profile URL."""

    def __init__(
        self, master: DataFrame, mapping: DataFrame, misplaced: DataFrame, statements: DataFrame, signals: DataFrame,
        order: str, error_value: str | None = None, url: str = "profile_url",
    ):
        self.master, self.mapping, self.misplaced, self.error_value = master, mapping, misplaced, error_value
        self.statements, self.signals, self.order, self.url = statements, signals, order, url

    # --- who takes part ---

    @cached_property
    def segmented(self) -> DataFrame:
        flags, _ = identity.resolve_duplicates(self.master.drop("mission"), "ch_no", "trading_name", self.url)
        out, _ = segments.segment_missions(flags, self.mapping, "value_stream", self.error_value, self.misplaced)
        return written(out, "segmented")

    @cached_property
    def modelled(self) -> DataFrame:
        """Companies that models learn from or score: the eligible ones and, by models of their own, the
        cross-cutting ones; no true duplicate and no company without a mission."""
        own = (F.col("mission") == CROSS_CUTTING) & ~F.col("is_true_duplicate")
        return self.segmented.filter(F.col("training_eligible") | own)

    @cached_property
    def panel(self) -> DataFrame:
        labelled, _ = segments.split_labelled(self.modelled, YEAR_COLUMNS)
        return written(panel.long_panel(labelled, ["company_id", "company_name", "trading_name", "mission"], YEARS)[0], "labelled")

    @cached_property
    def static(self) -> DataFrame:
        return self.segmented.select("company_id", *STATIC)

    @cached_property
    def bridge(self) -> DataFrame:
        return written(panel.url_bridge(self.segmented, self.url, self.order), "bridge")

    @cached_property
    def sizes(self) -> DataFrame:
        return panel.melt_years(self.segmented, ["company_id"], ["company_size"], YEARS)

    @cached_property
    def side_tables(self) -> tuple[DataFrame, DataFrame]:
        """Signals and ratios by profile URL, read by training and scoring."""
        signals = features.signal_features(self.signals, self.url)
        return written(signals, "signals"), written(features.ratio_features(self.statements, self.url), "ratios")

    # --- models ---

    @cached_property
    def training(self) -> DataFrame:
        rows, _ = features.estimation_features(
            self.panel.drop("company_name"), self.static, self.sizes, *self.side_tables, self.bridge, "trading_name")
        return written(preprocess.cast_inputs(rows, ESTIMATION_SET), "estimation")

    @cached_property
    def bake(self) -> gram.BakeOff:
        """Every linear candidate on every fold of its mission, and refitted on all its rows."""
        cut, outers = gram.grouped_cells(self.training, "mission")
        keep = ["company_id", "year", "mission"]
        return gram.bake_off(
            cut, outers, gram.LINEAR, ESTIMATION_SET, "total_turnover", "sample_weight", keep, F.col("mission"), gram.whole_of_grouped())

    @cached_property
    def folds(self) -> DataFrame:
        """Scores of every linear candidate on every held-out fold of its mission."""
        scores = metrics.metrics_of_moments(self.bake.moments(["mission"]), ["mission", "repeat", "fold", "Model"])
        return written(scores, "fold-results")

    @cached_property
    def selected(self) -> DataFrame:
        """The winner of each mission and whether it is usable."""
        ranked = selection.ranked_models(self.folds, ["mission"], SIMPLICITY)
        return written(selection.usability(selection.pick_winner(ranked, ["mission"])), "selected")

    @cached_property
    def predictions(self) -> DataFrame:
        """Companies without turnover, scored by their mission's selected model where it is usable."""
        _, unlabelled = segments.split_labelled(self.modelled, YEAR_COLUMNS)
        rows = panel.covariate_snapshot(unlabelled).drop(*STATIC, self.order)
        rows = features.prediction_features(rows, self.static, *self.side_tables, self.bridge, "trading_name")
        flagged = scoring.reliability(written(rows, "inference"), self.training)
        inputs = preprocess.cast_inputs(flagged, ESTIMATION_SET).withColumn("prediction_year", F.col("year"))
        models = {r["mission"]: r["selected_model"] for r in self.selected.filter("usable").select("mission", "selected_model").collect()}
        keep = ["company_id", "mission", "prediction_year", "reliability", "reliability_reason"]
        scored = gram.predict(inputs, self.bake.final, models, F.col("mission"), keep, "predicted_total_turnover")
        return written(quality.validate_predictions(scored), "predictions")

    # --- results ---

    @cached_property
    def completed(self) -> DataFrame:
        """One row per company: observed, predicted, or why there is no turnover."""
        return written(scoring.assemble(self.segmented, self.predictions.filter("prediction_valid"), self.selected, YEARS)[0], "completed")

    @cached_property
    def factors(self) -> DataFrame:
        return written(panel.weeks_factors(self.statements, self.bridge, self.url, self.order), "factors")

    @cached_property
    def inputs(self) -> tuple[DataFrame, DataFrame]:
        """Validated panel and baseline of the forecast; a company with an invalid turnover is in neither."""
        past = self.panel.select(
            "company_id", "company_name", "mission", "year", "total_turnover", "total_employees",
            "balance_sheet_total_assets", "total_export_revenue")
        past = past.join(self.static, "company_id", "left").join(self.sizes, ["company_id", "year"], "left")
        past = panel.annualize(features.with_age(past), "total_turnover", "year", self.factors)[0]
        history, history_log = quality.validate_panel(past.withColumnsRenamed(HISTORY), "company_id")
        done = self.completed.withColumnsRenamed(BASELINE).filter(F.col("baseline_year").isNotNull())
        start, start_log = quality.validate_baseline(done, "company_id")
        seen: Column = F.col("turnover_source_raw") == "observed"
        start = panel.annualize(start, "baseline_turnover", "baseline_year", self.factors, seen)[0]
        flags = written(quality.invalid_turnover_flags(start_log, history_log), "invalid")
        start, history = quality.exclude_invalid_history(start, history, flags)
        return written(history, "panel"), written(start, "baseline")

    @cached_property
    def forecast(self) -> ForecastFlow:
        history, start = self.inputs
        return ForecastFlow(history, start, self.static)
