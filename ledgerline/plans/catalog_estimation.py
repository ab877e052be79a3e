"""Queries of the flow from the wide master to the forecast."""

from pyspark.sql import functions as F

from ledgerline.plans.catalog_clean import SEGMENT_SQL, mapping
from ledgerline.plans.estimation_flow import EstimationFlow
from ledgerline.plans.registry import query
from ledgerline.sources.domain import Tables


def estimation_flow(t: Tables) -> EstimationFlow:
    misplaced = t.company().filter("balance > 9800").select("company_id", F.lit("not in scope").alias("note"))
    master = t.master().withColumn("value_stream", F.when(F.col("sic_code_1") == 21, "Own Name").otherwise(F.col("value_stream")))
    return EstimationFlow(master, mapping(t), misplaced, t.statements(), t.signals(), "ordinal", "Own Name")


MODELLED_SQL = f"select * from ({SEGMENT_SQL}) g where training_eligible or (mission = 'Cross-cutting' and not is_true_duplicate)"


@query("r2_eligible_panel", "company_id year:i mission total_turnover:m total_employees:r sample_weight:r", f"""
select v.company_id, v.year, m.mission, v.total_turnover, coalesce(v.total_employees_ch, v.total_employees_est) as total_employees,
  1.0 / count(*) over (partition by v.company_id) as sample_weight from x_covariates v join ({MODELLED_SQL}) m on m.company_id = v.company_id where v.total_turnover is not null""")
def _(t):
    return estimation_flow(t).panel


MODEL_SOURCES = ["predicted", "no_model_insufficient_data", "cross_cutting_unmodelled"]


@query("p15_estimated_sources", "company_id mission year:i turnover_value:m turnover_source reliability_reason", f"""
select g.company_id, g.mission, l.year, l.total_turnover as turnover_value, case when l.year is not null then 'observed' when g.mission is null then 'excluded_data_entry_error'
    when g.is_true_duplicate and g.mission <> 'Cross-cutting' then 'excluded_duplicate_company_record' else 'left to the models' end as turnover_source,
  case when l.year is not null then '' when g.mission is null then g.exclusion_reason
    when g.is_true_duplicate and g.mission <> 'Cross-cutting' then 'true duplicate of another record, excluded pending manual review' end as reliability_reason
from ({SEGMENT_SQL}) g left join (select * from x_covariates where total_turnover is not null and balance <= 9800
  qualify row_number() over (partition by company_id order by year desc) = 1) l on l.company_id = g.company_id""")
def _(t):
    open_to_models = F.col("turnover_source").isin(MODEL_SOURCES)
    known = {c: F.when(~open_to_models, F.col(c)) for c in ("year", "turnover_value", "reliability_reason")}
    rows = estimation_flow(t).completed.withColumns(known)
    return rows.withColumn("turnover_source", F.when(open_to_models, "left to the models").otherwise(F.col("turnover_source")))


@query("p15_estimated_turnover", "company_id mission year:i turnover_value:f turnover_source reliability reliability_reason turnover_is_stale:b")
def _(t):
    return estimation_flow(t).completed


@query("f13_estimated_summary", "company_id mission baseline_year:i baseline_turnover:f turnover_2030:f turnover_source baseline_reliability forecast_evidence_group final_step_model_used")
def _(t):
    return estimation_flow(t).forecast.summary
