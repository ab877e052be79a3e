"""Reading inputs with declared columns, and checks that inputs exist."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.quality import nan_to_null
from ledgerline.settings import MASTER_CH, MASTER_CH_SHORT, MASTER_COLUMNS, MASTER_NAME

MAPPING_SCHEMA = "mission string, value_stream string"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Value stream to mission lookup with a header line."""
    return read_csv(spark, path, MAPPING_SCHEMA)


def read_commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose leading `#` lines are notes."""
    return spark.read.option("header", True).option("comment", "#").schema(schema).csv(path)


def standard_master(df: DataFrame, ordinal: str | None = None, url: str = "Profile URL") -> DataFrame:
    """Master headers to the common names, NaN to null; `url` is the header of the profile URL."""
    names = {MASTER_NAME: "company_name", MASTER_CH: "ch_no", MASTER_CH_SHORT: "ch_short", url: "profile_url", **MASTER_COLUMNS}
    out = nan_to_null(df).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return out if ordinal is None else out.withColumn("ordinal", F.col(ordinal))


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fail before any work when an upstream table is missing."""
    missing = []
    for name, path in paths.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            missing.append(f"{name} ({path})")
    if missing:
        raise FileNotFoundError("missing upstream input: " + ", ".join(missing))


def input_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per input."""
    out = None
    for name, df in tables.items():
        rows = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
