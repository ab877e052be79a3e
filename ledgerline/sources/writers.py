"""Stage outputs, upserts, exports and saved models."""

import re
import tempfile
import uuid
from functools import cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Display labels of exported columns.
LABELS = {
    "company_id": "Company ID",
    "company_name": "Company Name",
    "ch_no": "Companies House Number",
    "mission": "Mission",
    "year": "Turnover Year",
    "turnover_value": "Turnover (£)",
    "turnover_source": "Turnover Source",
    "reliability": "Reliability",
    "reliability_reason": "Reliability Notes",
    "turnover_age_years": "Years Since Last Filing",
    "turnover_is_stale": "Stale Filing Flag",
    "accounting_year": "Year",
    "turnover": "Turnover (£)",
    "data_type": "Data Type",
    "model_used": "Forecast Model Used",
    "growth_classification": "Growth Classification",
    "turnover_lower": "Forecast Lower Bound (£, 95% CI)",
    "turnover_upper": "Forecast Upper Bound (£, 95% CI)",
    "baseline_year": "Baseline Year",
    "baseline_turnover": "Baseline Turnover (£)",
    "turnover_2030": "Forecast Turnover 2030 (£)",
    "forecast_evidence_group": "Evidence Group",
    "baseline_turnover_source": "Baseline Source",
    "growth_decay_applied": "Growth Model Ever Applied",
    "n_real_years": "Real Turnover Years",
    "evidence_gate_triggered": "Evidence Gate Triggered",
    "longest_run_10pct": "Longest Growth Streak >=10% (yrs)",
    "longest_run_20pct": "Longest Growth Streak >=20% (yrs)",
    "gazelle_10pct": "Gazelle (>=10%)",
    "gazelle_20pct": "Gazelle (>=20%)",
    "credibility_status": "Credibility Status",
    "n_real_years_employee_growth": "Real Employee-Growth Years",
    "employee_growth_10pct": "Employee Growth >=10% (3+ yrs)",
    "employee_growth_20pct": "Employee Growth >=20% (3+ yrs)",
    "n_real_years_asset_growth": "Real Asset-Growth Years",
    "asset_growth_10pct": "Asset Growth >=10% (3+ yrs)",
    "asset_growth_20pct": "Asset Growth >=20% (3+ yrs)",
    "operational_scaling_10pct": "Operational Scaling Flag (>=10%)",
    "operational_scaling_20pct": "Operational Scaling Flag (>=20%)",
}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach: `spark.checkpoint.dir`. A local one stands in for it
    only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors reach")
    return _single_machine_folder()


@cache
def _single_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerline-")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_stage(df: DataFrame, path: str, partition: str | None = "mission") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def written(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """The same rows read back from a new table in the shared folder.

    Cuts lineage; a lost executor costs a re-read, not a recomputation."""
    path = stage_path(df.sparkSession, name)
    write_stage(df, path, partition)
    columns = [f"`{c}`" for c in df.columns]
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*columns)


def upsert_by_mission(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the rows of every mission in `new`, keep the others."""
    touched = new.select("mission").distinct()
    return prior.join(touched, "mission", "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_table(new: DataFrame, path: str) -> None:
    """Overwrite only the mission partitions that `new` holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mission").parquet(path)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stored table with the columns and types of `like`."""
    return spark.read.schema(like.schema).parquet(path).select(*[f"`{c}`" for c in like.columns])


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in LABELS.items() if k in df.columns})


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """One labelled dataset per report table."""
    for name, df in tables.items():
        labelled(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_export(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A table that `export` wrote from `df`, under its labels, as text."""
    names = ", ".join(f"`{c}` string" for c in labelled(df).columns)
    return spark.read.schema(names).option("header", True).csv(path)


def write_commented_csv(df: DataFrame, path: str, notes: list[str], parts: int = 1) -> None:
    """A CSV of `parts` files, each led by its `#` notes and a header line.

    Rows are spread over the files by a hash of the whole line. Values must not hold line breaks."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    head = [f"# {line}" for note in notes for line in note.splitlines()] + [header]
    lines = df.select(F.to_csv(F.struct(*[f"`{c}`" for c in df.columns])).alias("value"))
    lines = lines.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int")).withColumn("place", F.lit(len(head)))
    top = df.sparkSession.createDataFrame([(v, p, i) for p in range(parts) for i, v in enumerate(head)], "value string, part int, place int")
    whole = top.unionByName(lines).repartition(parts, "part").sortWithinPartitions("part", "place")
    whole.select("value", "part").write.mode("overwrite").partitionBy("part").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
