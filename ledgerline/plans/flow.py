"""The forecast from validated inputs to reports, stage by stage.

The inputs should be stored tables. Stages that several later steps read
(training rows, folds, trajectories) are written once to the shared folder;
everything else stays lazy. With `routes`, growing companies of those missions follow a
fitted model instead of their own growth."""

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import features, forecast, reports, routed
from ledgerline.operators.panel import history_properties
from ledgerline.operators.quality import primary_model_eligible
from ledgerline.sources.writers import written


class ForecastFlow:
    def __init__(
        self, panel: DataFrame, baseline: DataFrame, static: DataFrame, routes: dict[str, routed.LinearRoute] | None = None
    ):
        self.panel, self.baseline, self.static, self.routes = panel, baseline, static, routes

    @cached_property
    def growth(self) -> DataFrame:
        return features.growth_core(self.panel)

    @cached_property
    def engineered(self) -> DataFrame:
        return features.engineered_panel(self.panel)

    @cached_property
    def training(self) -> DataFrame:
        return written(features.training_features(self.panel, self.baseline), "training")

    @cached_property
    def history(self) -> DataFrame:
        return history_properties(self.panel)

    @cached_property
    def groups(self) -> DataFrame:
        return features.evidence_groups(self.baseline, self.history)

    @cached_property
    def spread(self) -> DataFrame:
        return forecast.residual_spread(self.growth, self.groups)

    @cached_property
    def predicted(self) -> DataFrame:
        inputs = self.panel, self.baseline, self.groups, self.static
        steps = routed.routed_forecast(*inputs, self.routes) if self.routes else forecast.recursive_forecast(*inputs)
        return written(forecast.with_intervals(steps, self.spread), "trajectories")

    @cached_property
    def trajectories(self) -> DataFrame:
        return forecast.full_trajectories(self.panel, self.predicted, self.baseline)

    @cached_property
    def summary(self) -> DataFrame:
        return forecast.final_summary(self.groups, self.trajectories, self.predicted)

    @cached_property
    def runs(self) -> DataFrame:
        return reports.gazelle_runs(self.trajectories)

    @cached_property
    def context(self) -> DataFrame:
        return reports.report_context(self.trajectories, self.predicted, self.summary)

    @cached_property
    def scaling(self) -> DataFrame:
        return reports.operational_scaling(features.financial_features(self.panel))

    @cached_property
    def intersection(self) -> DataFrame:
        return reports.credible_intersection(self.context, self.runs, self.trajectories)

    @cached_property
    def primary_training(self) -> DataFrame:
        """Rows that take part in model selection: the missions with a model of their own."""
        return self.training.filter(primary_model_eligible(F.col("mission")))

    @cached_property
    def folds(self) -> DataFrame:
        return written(forecast.benchmark_folds(self.primary_training), "folds")
