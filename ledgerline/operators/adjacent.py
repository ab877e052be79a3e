"""Training-only companies from foreign exports: same features, other headers."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import primary_code, ratio, size_bucket
from ledgerline.functions.text import company_id, registration_key
from ledgerline.operators.features import (
    add_recency,
    body_flags,
    per_employee,
    ratio_features,
    signal_features,
    size_from_employees,
)
from ledgerline.operators.identity import exclude_known_companies
from ledgerline.operators.keys import first_per_key
from ledgerline.operators.panel import annualize, inverse_weight, quoted, statement_panel
from ledgerline.operators.quality import check_turnover
from ledgerline.settings import (
    ADJACENT,
    FOREIGN_CH,
    FOREIGN_CODES,
    FOREIGN_FIRST_CODE,
    FOREIGN_NAME,
    FUNDRAISING_COLUMNS,
    GRANT_COLUMNS,
    STATEMENT_DATE,
    STATEMENT_FIELDS,
    STATEMENTS,
)

DATE_COLUMNS = [STATEMENT_DATE.format(n=n) for n in range(1, STATEMENTS + 1)] + [
    GRANT_COLUMNS["grants_latest_date"],
    FUNDRAISING_COLUMNS["fundraising_latest_date"],
]


def parse_dates(df: DataFrame) -> DataFrame:
    """Text dates to timestamps; unreadable ones become null."""
    text = {f.name for f in df.schema if f.dataType.typeName() == "string"}
    known = [c for c in DATE_COLUMNS if c in text]
    return df.withColumns({c: F.try_to_timestamp(quoted(c)) for c in known}) if known else df


def normalise_variant(
    df: DataFrame, numbered_codes: bool = False, side: DataFrame | None = None, url: str = "profile_url"
) -> DataFrame:
    """One file layout to the common one; `side` adds grant columns by URL."""
    out = parse_dates(df)
    if numbered_codes:
        out = out.withColumnRenamed(FOREIGN_FIRST_CODE, FOREIGN_CODES)
    if side is not None:
        extra = parse_dates(side)
        out = out.join(extra.drop(*[c for c in extra.columns if c == FOREIGN_NAME]), url, "left")
    return out


def union_by_priority(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Stack files and keep the row of the first-listed file per company."""
    ranked = [f.withColumn("file_priority", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    keyed = stacked.withColumn("_key", registration_key(quoted(FOREIGN_CH)))
    best = first_per_key(keyed, [*keys, "_key"], ["file_priority", order])
    return best.drop("_key", "file_priority")


def with_foreign_id(df: DataFrame, url: str = "profile_url") -> DataFrame:
    name = quoted(FOREIGN_NAME).cast("string")
    return df.withColumn("company_id", company_id(quoted(FOREIGN_CH), name, F.col(url)))


def load_all(
    files: dict[str, list[DataFrame]], known: DataFrame, known_ch: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """All missions in one table: priority, overlap exclusion, ids."""
    listed = [f.withColumn("mission", F.lit(m)) for m, frames in files.items() for f in frames]
    stacked = union_by_priority(listed, ["mission"], order)
    kept, overlap = exclude_known_companies(stacked, known, f"`{FOREIGN_CH}`", known_ch)
    log = overlap.select(quoted(FOREIGN_NAME), quoted(FOREIGN_CH), "mission", "reason")
    return with_foreign_id(kept), log


def multi_mission_overlap(df: DataFrame) -> DataFrame:
    """Per company and mission, the other missions it also appears in."""
    missions = df.groupBy("company_id").agg(F.collect_set("mission").alias("_all"))
    spread = missions.select("company_id", F.explode("_all").alias("mission"), "_all")
    others = F.array_sort(F.array_except("_all", F.array("mission")))
    return spread.select("company_id", "mission", F.array_join(others, ", ").alias("multi_mission_overlap"))


def static_features(df: DataFrame, overlap: DataFrame, url: str = "profile_url") -> DataFrame:
    head = quoted(STATEMENT_FIELDS["total_employees"].format(n=1))
    out = df.select(
        "company_id",
        quoted(FOREIGN_NAME).cast("string").alias("company_name"),
        F.col(url).alias("profile_url"),
        quoted(FOREIGN_CH).alias("ch_no"),
        "mission",
        primary_code(quoted(FOREIGN_CODES)).alias("sic_code_1"),
        size_bucket(head).alias("company_size"),
        F.lit(None).cast("double").alias("company_age_years"),
        F.lit(None).cast("double").alias("total_export_revenue"),
    )
    return out.join(overlap, ["company_id", "mission"], "left")


def turnover_panel(df: DataFrame, order: str) -> DataFrame:
    """Statement panel of every mission at once; a company may be in several."""
    pair = F.concat_ws("\u0001", "mission", "company_id")
    keyed = df.withColumn("company_id", pair)
    panel = statement_panel(keyed, order)
    parts = F.split("company_id", "\u0001")
    return panel.withColumn("mission", parts[0]).withColumn("company_id", parts[1])


def annualize_panel(panel: DataFrame, missions: list[str]) -> tuple[DataFrame, DataFrame]:
    """One factor per company-year across all mission copies, then scale turnover."""
    place = F.array_position(F.array(*[F.lit(m) for m in missions]), F.col("mission"))
    factors = panel.groupBy("company_id", "year").agg(F.min_by("weeks", place).alias("weeks"))
    factors = factors.withColumn("annualization_factor", ratio(F.lit(52.0), F.col("weeks")))
    return annualize(panel.drop("weeks"), "turnover", "year", factors)


def training_rows(
    raw: DataFrame, annualized: DataFrame, overlap: DataFrame, order: str, url: str = "profile_url"
) -> tuple[DataFrame, DataFrame]:
    """Feature rows of all missions in the layout of the labelled features."""
    keyed = raw.withColumnRenamed(order, "ordinal")
    ratios = first_per_key(
        ratio_features(keyed, url).drop("url_norm"), ["company_id", "year"], ["ordinal"]
    ).drop("ordinal")
    signals = first_per_key(
        signal_features(keyed, url).drop("url_norm"), ["company_id"], ["ordinal"]
    ).drop("ordinal")
    static = static_features(raw, overlap, url).drop("company_size")
    panel = annualized.withColumnRenamed("turnover", "total_turnover")
    panel = panel.join(ratios, ["company_id", "year"], "left").join(signals, "company_id", "left")
    panel = add_recency(panel).join(static, ["company_id", "mission"], "left")
    panel = size_from_employees(panel).withColumns(
        {
            "value_stream": F.lit(None).cast("string"),
            "employee_count_source": F.when(F.col("total_employees").isNotNull(), "filed"),
            "population_type": F.lit(ADJACENT),
        }
    )
    panel = per_employee(body_flags(panel, "company_name"))
    weighted = inverse_weight(panel.withColumn("_pair", F.concat_ws("|", "mission", "company_id")), "_pair")
    checked, log = check_turnover(weighted.drop("_pair"), "total_turnover")
    return checked.filter(F.col("total_turnover").isNotNull()), log


def mission_training_set(space: DataFrame, adjacent: DataFrame, weights: dict[str, float], default: float) -> DataFrame:
    """Space rows plus adjacent rows, the latter at a reduced weight per mission."""
    factor = F.lit(default)
    for mission, weight in weights.items():
        factor = F.when(F.col("mission") == mission, F.lit(weight)).otherwise(factor)
    scaled = adjacent.withColumn("sample_weight", F.col("sample_weight") * factor)
    return space.unionByName(scaled, allowMissingColumns=True)
