"""Sources, identity, data-quality checks and derived columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import numeric as N
from ledgerline.functions import text as X
from ledgerline.operators import adjacent, features, identity, panel, quality, scoring, segments
from ledgerline.operators.keys import join_facts
from ledgerline.operators.metrics import residuals
from ledgerline.operators.reports import crossings
from ledgerline.plans.registry import query
from ledgerline.settings import (
    ACCELERATOR_SLOTS,
    BOOLEAN_SIGNALS,
    CORE_MISSIONS,
    FOREIGN_CH,
    FOREIGN_CODES,
    FOREIGN_NAME,
    REQUIRED_BASELINE_FIELDS,
    REQUIRED_PANEL_FIELDS,
    STATEMENT_DATE,
    STATEMENT_FIELDS,
    YEARS,
)
from ledgerline.sources import readers, writers
from ledgerline.sources.domain import MISSION_OF, Tables, cents, money, shifted

YEAR_COLUMNS = [f"Total Turnover (CH {y})" for y in YEARS]

# --- helper tables -----------------------------------------------------------------


def dirty(t: Tables) -> DataFrame:
    """Order totals per company, year and status with faults set by nation."""
    facts = t.company().select("ordinal", "mission", "value_stream", F.col("sic_code_1").cast("int").alias("nation"))
    orders = t.table("orders")
    grouped = orders.groupBy(
        "o_custkey", F.year(shifted(F.col("o_orderdate"))).alias("y"), F.col("o_orderstatus").alias("status")
    ).agg(
        money(F.sum(cents("o_totalprice"))).cast("string").alias("total"),
        F.count("*").alias("n"),
        F.min("o_orderkey").alias("row"),
    )
    d = grouped.join(facts, F.col("o_custkey") == F.col("ordinal")).drop("ordinal")
    nation, status = F.col("nation"), F.col("status")
    filed = status == "F"
    year = F.col("y").cast("double")
    return d.select(
        F.when((nation == 7) & (status == "P"), None)
        .when((nation == 8) & (status == "P"), " ")
        .otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
        .alias("company_id"),
        F.when((nation == 9) & (status == "O"), 1900.0)
        .when((nation == 10) & filed, 2015.5)
        .when((nation == 10) & (status == "O"), 15.0)
        .otherwise(year)
        .alias("accounting_year"),
        F.when(filed & (nation == 11), "n/a")
        .when(filed & (nation == 12), "-5")
        .when(filed & (nation == 13), "-inf")
        .when(filed & (nation == 14), "inf")
        .when(~(filed & (nation == 15)), F.col("total"))
        .alias("turnover"),
        F.when(nation == 16, 1000000.0).otherwise(F.col("n").cast("double")).alias("employees"),
        F.when((F.col("value_stream") == "MACHINERY") & (nation >= 12), "Unknown")
        .when(F.col("value_stream") == "MACHINERY", None)
        .when(nation == 17, F.concat(F.lower("mission"), F.lit(" ")))
        .otherwise(F.col("mission"))
        .alias("mission"),
        F.col("row").alias("ordinal"),
        nation.alias("nation"),
        status.alias("status"),
    )


def both(checked: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Clean rows (no reason) and logged rows in one table."""
    clean, log = checked
    same = [F.col(c).cast("string").alias(c) for c in clean.columns if c in log.columns]
    return clean.select(*same, F.lit("clean").alias("part"), F.lit(None).cast("string").alias("reason")).unionByName(
        log.select(*same, F.lit("log").alias("part"), F.col("exclusion_reason").alias("reason"))
    )


def corrections(t: Tables) -> DataFrame:
    c = t.company()
    low, high = c.filter("balance < -900"), c.filter("balance > 9900")
    text = F.lit(None).cast("string")
    rows = [
        low.select("company_name", F.lit("ch_no").alias("f"), text.alias("v"), F.lit("number belongs to another body").alias("r")),
        low.select("company_name", F.lit("profile_url").alias("f"), text.alias("v"), F.lit("number belongs to another body").alias("r")),
        high.select(
            "company_name", F.lit("ch_no").alias("f"),
            F.concat(F.lit("FIX"), F.col("ordinal").cast("string")).alias("v"), F.lit("wrong number filed").alias("r"),
        ),
    ]
    stacked = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return stacked.toDF("match_name", "field", "new_value", "reason")


CORRECTIONS_SQL = """
select company_name as match_name, 'ch_no' as field, null as new_value, 'number belongs to another body' as reason from x_company where balance < -900
union all select company_name, 'profile_url', null, 'number belongs to another body' from x_company where balance < -900
union all select company_name, 'ch_no', 'FIX'||ordinal, 'wrong number filed' from x_company where balance > 9900"""


def mapping(t: Tables) -> DataFrame:
    streams = t.table("customer").select(F.col("c_mktsegment").alias("value_stream")).distinct()
    mission = F.lit(None).cast("string")
    for stream, name in MISSION_OF.items():
        mission = F.when(F.col("value_stream") == stream, name).otherwise(mission)
    return streams.withColumn("mission", mission).filter(F.col("mission").isNotNull())


def flagged(t: Tables) -> DataFrame:
    flags, _ = identity.resolve_duplicates(t.company(), "ch_no", "trading_name", "profile_url")
    return flags


def segmented(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Segmentation with an error value and a list of misplaced companies."""
    misplaced = t.company().filter("balance > 9800").select("company_id", F.lit("not in scope").alias("note"))
    source = flagged(t).drop("mission").withColumn(
        "value_stream", F.when(F.col("sic_code_1") == 21, "Own Name").otherwise(F.col("value_stream"))
    )
    return segments.segment_missions(source, mapping(t), "value_stream", "Own Name", misplaced)


DUPLICATE_SQL = """
select c.*, coalesce(n > 1 and lo = hi, false) as is_true_duplicate, coalesce(n > 1 and lo <> hi, false) as is_shared_ch_anomaly from x_company c left join (
  select ch_no, count(*) as n, min(norm) as lo, max(norm) as hi from (select ch_no, regexp_replace(regexp_replace(lower(trading_name),
    '\\b(ltd|limited|llp|plc|inc|the|group|holdings|uk)\\b', '', 'g'), '[^a-z0-9]', '', 'g') as norm from x_company where ch_no is not null) z group by ch_no) k on k.ch_no = c.ch_no"""

SEGMENT_SQL = f"""
select d.* exclude (mission, value_stream), case when sic_code_1 = 21 then 'Own Name' else value_stream end as value_stream,
  case when sic_code_1 <> 21 and balance <= 9800 then mission end as mission,
  concat_ws('; ', case when sic_code_1 = 21 then 'data_entry_error: Value Stream is company''s own name' end,
    case when balance > 9800 then 'known_miscategorized_company: not in scope' end,
    case when mission is null and sic_code_1 <> 21 and balance <= 9800 then 'unmapped_value_stream' end,
    case when is_true_duplicate then 'duplicate_company_record' end) as exclusion_reason,
  coalesce(sic_code_1 <> 21 and balance <= 9800 and mission <> 'Cross-cutting', false) and not is_true_duplicate as training_eligible
from ({DUPLICATE_SQL}) d"""

# --- sources and sinks -----------------------------------------------------------------


def raw_master(t: Tables) -> DataFrame:
    """The company table under the headers of the raw file, with a second URL header."""
    names = {"company_name": "Organisation Name", "ch_no": "CH No. (full)", "founded_year": "Founded",
             "sic_code_1": "SIC Code 1", "value_stream": "Value Stream", "profile_url": "Profile URL"}
    return t.company().withColumnsRenamed(names).withColumn("Website URL", F.lit("https://example.org"))


@query("s1_scan_master", "company_id company_name ch_no value_stream sic_code_1:r founded_year:i profile_url",
       "select company_id, company_name, ch_no, value_stream, sic_code_1, founded_year, profile_url from x_company")
def _(t):
    return readers.standard_master(raw_master(t))


@query("s2_scan_mapping", "mission value_stream",
       "select distinct mission, value_stream from x_company where mission is not null")
def _(t):
    return mapping(t)


@query("s3_scan_variants", "ordinal:i codes accounts_year:i grants_count:i weeks:r", """
select s.ordinal, s.nation||', 99999' as codes, y.year as accounts_year, e.grants_count, y.weeks from x_suppliers s
join (select * from x_sup_years qualify row_number() over (partition by l_suppkey order by year desc) = 1) y on y.l_suppkey = s.ordinal
left join (select user_id, grants_count from x_events where user_id in (select c_custkey from customer)) e on e.user_id = s.ordinal""")
def _(t):
    numbered = t.supplier_export().withColumnRenamed(FOREIGN_CODES, "SIC Codes (2007) 1 - Code")
    df = adjacent.normalise_variant(numbered, numbered_codes=True, side=t.supplier_signals())
    weeks = F.col(f"`{STATEMENT_FIELDS['weeks'].format(n=1)}`")
    return df.select(
        "ordinal", F.col(f"`{FOREIGN_CODES}`").alias("codes"),
        F.year(F.col(f"`{STATEMENT_DATE.format(n=1)}`")).alias("accounts_year"),
        F.col("`Grants - Number of grants received by the company`").alias("grants_count"), weeks.alias("weeks"),
    )


@query("s4_union_priority", "number ordinal:i",
       "select upper(key) as number, ordinal from x_suppliers where balance >= 4000 or nation < 10")
def _(t):
    out = adjacent.union_by_priority(t.adjacent_files()["ACE"], [], "ordinal")
    return out.select(X.registration_key(F.col(f"`{FOREIGN_CH}`")).alias("number"), "ordinal")


@query("s5_load_all", "mission company_id ordinal:i", "select mission, company_id, ordinal from x_adjacent")
def _(t):
    return adjacent.load_all(t.adjacent_files(), t.company(), "ch_no", "ordinal")[0]


@query("s6_sink_stage", "company_id mission accounting_year:i turnover:m",
       "select company_id, mission, accounting_year, turnover from x_panel")
def _(t):
    return writers.written(t.panel().select("company_id", "mission", "accounting_year", "turnover"), "panel", "mission")


def yearly_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("mission", "accounting_year").agg(money(F.sum(cents("turnover"))).alias("turnover"))


@query("s7_upsert_by_mission", "mission accounting_year:i turnover:m", """
select mission, accounting_year, cast(sum(cast(turnover as decimal(18,2))) as double) as turnover from x_raw_panel where mission <> 'ACE' group by 1, 2
union all select mission, accounting_year, cast(sum(cast(round(turnover, 2) as decimal(18,2))) as double) from x_panel where mission = 'ACE' group by 1, 2""")
def _(t):
    fresh = t.panel().filter(F.col("mission") == "ACE").withColumn("turnover", F.round("turnover", 2))
    prior = yearly_totals(t.raw_panel())
    path = writers.stage_path(t.spark, "totals")
    writers.write_stage(prior, path)
    writers.upsert_table(yearly_totals(fresh), path)
    return writers.read_table(t.spark, path, prior)


@query("s10_labelled_export", ["Company ID", "Company Name", "Mission", "Baseline Year:i", "Baseline Turnover (£):m"], """
select company_id as "Company ID", company_name as "Company Name", mission as "Mission", baseline_year as "Baseline Year",
  baseline_turnover as "Baseline Turnover (£)" from x_baseline""")
def _(t):
    return writers.labelled(t.baseline())


@query("s12_input_guard", "dataset rows:i", """
select 'customer' as dataset, count(*) as rows from customer union all select 'orders', count(*) from orders
union all select 'lineitem', count(*) from lineitem""")
def _(t):
    names = ["customer", "orders", "lineitem"]
    readers.require_inputs(t.spark, {n: f"{t.path}/{n}.parquet" for n in names})
    return readers.input_rows({n: t.table(n) for n in names})


# --- identity and checks ------------------------------------------------------------------

NORM_SQL = """regexp_replace(regexp_replace(lower({c}), '\\b(ltd|limited|llp|plc|inc|the|group|holdings|uk)\\b', '', 'g'), '[^a-z0-9]', '', 'g')"""


@query("c1_normalize_name", "company_id name", f"""
select company_id, coalesce({NORM_SQL.format(c='trading_name')}, '') as name from x_company""")
def _(t):
    return t.company().select("company_id", X.normalized_name(F.col("trading_name")).alias("name"))


@query("c2_normalize_url", "page_id:i url",
       "select page_id, regexp_replace(lower(url), '/+$', '') as url from pages")
def _(t):
    noisy = F.concat(F.lit("  "), F.upper("url"), F.lit("// "))
    return t.table("pages").select("page_id", X.normalized_url(noisy).alias("url"))


@query("c3_apply_corrections", "company_id ch_no profile_url", """
select company_id, case when balance < -900 then null when balance > 9900 then 'FIX'||ordinal else ch_no end as ch_no,
  case when balance >= -900 then profile_url end as profile_url from x_company""")
def _(t):
    return identity.apply_corrections(t.company(), corrections(t), "company_name", ["ch_no", "profile_url"])[0]


@query("c3_corrections_log", "company_name field_corrected old_value new_value reason", f"""
select c.company_name, k.field as field_corrected, case k.field when 'ch_no' then c.ch_no else c.profile_url end as old_value, k.new_value, k.reason
from x_company c join ({CORRECTIONS_SQL}) k on k.match_name = c.company_name""")
def _(t):
    return identity.apply_corrections(t.company(), corrections(t), "company_name", ["ch_no", "profile_url"])[1]


@query("c4_duplicate_identity", "company_id is_true_duplicate:b is_shared_ch_anomaly:b",
       f"select company_id, is_true_duplicate, is_shared_ch_anomaly from ({DUPLICATE_SQL}) d")
def _(t):
    return flagged(t)


ID_SQL = f"""case when ch_no is not null then 'ch_'||upper(ch_no)||'_'||{NORM_SQL.format(c='trading_name')}
  else 'fallback_'||substr(sha1(lower(trading_name)||'|'||lower(profile_url)), 1, 12) end"""


@query("c5_make_company_id", "company_id made_id", f"select company_id, {ID_SQL} as made_id from x_company")
def _(t):
    made = X.company_id(F.col("ch_no"), F.col("trading_name"), F.col("profile_url"))
    return t.company().withColumn("made_id", made)


def prepared(t: Tables) -> tuple[DataFrame, DataFrame]:
    source = t.company().withColumnRenamed("company_id", "source_id")
    return identity.prepare_master(
        source, corrections(t), "ch_no", "company_name", "profile_url", ["ch_no", "profile_url"]
    )


PREPARED_SQL = f"""
select company_id as source_id, case when balance < -900 then null when balance > 9900 then 'FIX'||ordinal else ch_no end as ch,
  case when balance >= -900 then profile_url end as url, company_name from x_company"""


@query("c6_prepare_master", "source_id company_id is_shared_ch_anomaly:b", f"""
select p.source_id, case when p.ch is not null then 'ch_'||p.ch||'_'||{NORM_SQL.format(c='company_name')}
  else 'fallback_'||substr(sha1(lower(p.company_name)||'|'||coalesce(p.url, '')), 1, 12) end as company_id,
  p.ch is not null and count(*) over (partition by p.ch) > 1 as is_shared_ch_anomaly from ({PREPARED_SQL}) p""")
def _(t):
    return prepared(t)[0]


@query("c6_prepare_master_log", "log_type company_name", f"""
select 'correction' as log_type, match_name as company_name from ({CORRECTIONS_SQL}) k
union all select 'duplicate_ch', company_name from (
  select *, p.ch is not null and count(*) over (partition by p.ch) > 1 as shared from ({PREPARED_SQL}) p) z where shared""")
def _(t):
    return prepared(t)[1]


@query("c7_clean_currency", "company_id amount:m", """
select 'c'||c_custkey as company_id, case when c_nationkey not in (3, 4) then abs(c_acctbal) end as amount from customer""")
def _(t):
    nation = F.col("c_nationkey")
    amount = F.abs("c_acctbal").cast("decimal(18,2)").cast("string")
    text = F.when(nation == 3, "(no value)").when(nation == 4, "n/a").otherwise(amount)
    return t.table("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("company_id"), N.currency(text).alias("amount")
    )


CHECK = "ordinal part company_id reason"


@query("c8_check_company_id", CHECK, """
select cast(ordinal as varchar) as ordinal, company_id, case when trim(coalesce(company_id, '')) = '' then 'log' else 'clean' end as part,
  case when trim(coalesce(company_id, '')) = '' then 'missing_or_blank_company_id' end as reason from x_dirty""")
def _(t):
    return both(quality.check_company_id(dirty(t)))


@query("c9_check_duplicates", CHECK, """
select cast(ordinal as varchar) as ordinal, company_id, 'log' as part,
  'duplicate_key_flagged_for_manual_review_no_reliability_or_timestamp_signal' as reason from x_dirty
qualify count(*) over (partition by company_id, accounting_year) > 1
union all select cast(ordinal as varchar), company_id, 'clean', null from x_dirty
qualify row_number() over (partition by company_id, accounting_year order by ordinal) = 1""")
def _(t):
    return both(quality.check_duplicates(dirty(t), ["company_id", "accounting_year"], "ordinal"))


@query("c10_check_turnover", "ordinal:i part value:m raw reason", """
select ordinal, 'clean' as part, case when turnover not in ('n/a', '-5', '-inf', 'inf') then cast(turnover as double) end as value, null as raw, null as reason from x_dirty
union all select ordinal, 'log', null, turnover, case turnover when 'n/a' then 'turnover_non_numeric' when '-5' then 'turnover_negative' else 'turnover_non_finite' end
from x_dirty where turnover in ('n/a', '-5', '-inf', 'inf')""")
def _(t):
    clean, log = quality.check_turnover(dirty(t), "turnover")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return clean.select("ordinal", F.lit("clean").alias("part"), F.col("turnover").alias("value"), text.alias("raw"), text.alias("reason")).unionByName(
        log.select("ordinal", F.lit("log").alias("part"), number.alias("value"), F.col("turnover").alias("raw"), F.col("exclusion_reason").alias("reason")))


@query("c11_check_years", CHECK, """
select cast(ordinal as varchar) as ordinal, company_id, case when accounting_year between 2013 and 2025 and accounting_year = floor(accounting_year) then 'clean' else 'log' end as part,
  case when accounting_year <> floor(accounting_year) or accounting_year < 1000 then 'year_not_four_digit_integer'
    when accounting_year not between 2013 and 2025 then 'year_outside_supported_range' end as reason from x_dirty""")
def _(t):
    return both(quality.check_years(dirty(t), "accounting_year"))


@query("c12_check_plausible", "ordinal:i employees:r reason", """
select ordinal, case when employees <= 500000 then employees end as employees, null as reason from x_dirty
union all select ordinal, employees, 'employees_exceeds_plausible_max' from x_dirty where employees > 500000""")
def _(t):
    clean, log = quality.check_plausible_employees(dirty(t))
    return clean.select("ordinal", "employees", F.lit(None).cast("string").alias("reason")).unionByName(
        log.select("ordinal", "employees", F.col("exclusion_reason").alias("reason")))


CANONICAL_SQL = """case lower(trim(mission)) when 'ace' then 'ACE' when 'beyond earth' then 'Beyond Earth'
  when 'resilient earth' then 'Resilient Earth' when 'cross-cutting' then 'Cross-Cutting' end"""


@query("c13_check_mission", "ordinal:i mission eligible:b reason", f"""
select ordinal, coalesce({CANONICAL_SQL}, mission) as mission, case when {CANONICAL_SQL} is not null then {CANONICAL_SQL} <> 'Cross-Cutting' end as eligible,
  case when mission is null then 'missing_mission' when {CANONICAL_SQL} is null then 'unrecognized_mission_value' end as reason from x_dirty""")
def _(t):
    clean, log = quality.check_mission(dirty(t))
    return clean.select("ordinal", "mission", F.col("primary_model_eligible").alias("eligible"), F.lit(None).cast("string").alias("reason")).unionByName(
        log.select("ordinal", "mission", F.lit(None).cast("boolean").alias("eligible"), F.col("exclusion_reason").alias("reason")))


def completed(t: Tables) -> DataFrame:
    """Baseline under the upstream source labels, some of them unknown."""
    raw = F.when(F.col("baseline_reliability") == "low", "cross_cutting_unmodelled").when(
        F.col("baseline_year") == 2019, "approximate").otherwise(F.col("turnover_source_raw"))
    return t.baseline().withColumn("turnover_source", raw).drop("turnover_source_raw")


COMPLETED_SQL = """select * exclude (turnover_source, turnover_source_raw), case when baseline_reliability = 'low' then 'cross_cutting_unmodelled'
  when baseline_year = 2019 then 'approximate' else turnover_source_raw end as raw from x_baseline"""


@query("c14_normalize_source", "company_id turnover_source turnover_source_raw logged:b", f"""
select company_id, case when baseline_turnover is not null then case raw when 'observed' then 'observed' when 'predicted' then 'estimated' end end as turnover_source,
  raw as turnover_source_raw, baseline_turnover is not null and raw not in ('observed', 'predicted') as logged from ({COMPLETED_SQL}) b""")
def _(t):
    out, log = quality.normalize_source(completed(t))
    return out.join(log.select("company_id", F.lit(True).alias("logged")), "company_id", "left").fillna(False, ["logged"])


@query("c15_missing_fields", "dataset field present:b non_null:i", """
select 'historical_panel' as dataset, unnest(['company_id', 'company_name', 'mission', 'accounting_year', 'turnover', 'employees', 'total_assets', 'current_assets', 'liabilities',
    'funding_raised', 'export_revenue', 'company_age', 'company_size', 'value_stream']) as field,
  unnest([true, true, true, true, true, true, true, false, false, false, true, true, true, true]) as present,
  unnest([count(company_id), count(company_name), count(mission), count(accounting_year), count(turnover), count(employees), count(total_assets), 0, 0, 0,
    count(export_revenue), count(company_age), count(company_size), count(value_stream)]) as non_null from x_panel
union all select 'completed_baseline', unnest(['company_id', 'company_name', 'mission', 'baseline_year', 'baseline_turnover', 'turnover_source', 'baseline_lower', 'baseline_upper', 'baseline_reliability']),
  unnest([true, true, true, true, true, true, false, false, true]),
  unnest([count(company_id), count(company_name), count(mission), count(baseline_year), count(baseline_turnover), count(turnover_source), 0, 0, count(baseline_reliability)]) from x_baseline""")
def _(t):
    return quality.field_report(t.panel(), REQUIRED_PANEL_FIELDS, "historical_panel").unionByName(
        quality.field_report(t.baseline(), REQUIRED_BASELINE_FIELDS, "completed_baseline"))


def checked_panel(t: Tables) -> tuple[DataFrame, DataFrame]:
    return quality.validate_panel(dirty(t), "ordinal")


def dirty_baseline(t: Tables) -> DataFrame:
    """Rows of each company's latest order year under the baseline field names."""
    d = dirty(t)
    source = F.when(F.col("status") == "O", "predicted").otherwise("observed")
    latest = join_facts(d, d.groupBy("company_id").agg(F.max("accounting_year").alias("latest")), ["company_id"])
    return latest.filter("accounting_year = latest").select(
        "company_id", F.col("accounting_year").alias("baseline_year"), F.col("turnover").alias("baseline_turnover"),
        "mission", source.alias("turnover_source"), "ordinal",
    )


def checked_baseline(t: Tables) -> tuple[DataFrame, DataFrame]:
    return quality.validate_baseline(dirty_baseline(t), "ordinal")


# Each step of the chain sees what the previous steps kept.
PANEL_CHAIN_SQL = f"""
with a as (select * from x_dirty where trim(coalesce(company_id, '')) <> ''),
 b as (select *, count(*) over (partition by company_id, accounting_year) as copies,
   row_number() over (partition by company_id, accounting_year order by ordinal) as place from a),
 c as (select * from b where place = 1),
 d as (select *, {CANONICAL_SQL} as canonical from c where accounting_year between 2013 and 2025 and accounting_year = floor(accounting_year))"""
VALUE_SQL = "case when turnover not in ('n/a', '-5', '-inf', 'inf') then cast(turnover as double) end"
FAULT_SQL = "case turnover when 'n/a' then 'turnover_non_numeric' when '-5' then 'turnover_negative' else 'turnover_non_finite' end"
BASELINE_CHAIN_SQL = PANEL_CHAIN_SQL.replace(
    "from x_dirty where", "from (select * from x_dirty qualify accounting_year = max(accounting_year) over (partition by company_id)) l where").replace(
    "partition by company_id, accounting_year", "partition by company_id")


@query("c18_validate_panel", "company_id accounting_year:i turnover:m employees:r mission", f"""
{PANEL_CHAIN_SQL} select company_id, accounting_year, {VALUE_SQL} as turnover, case when employees <= 500000 then employees end as employees, canonical as mission
from d where canonical is not null""")
def _(t):
    return checked_panel(t)[0]


@query("c18_validate_panel_log", "ordinal:i check exclusion_reason", f"""
{PANEL_CHAIN_SQL} select ordinal, 'company_id' as "check", 'missing_or_blank_company_id' as exclusion_reason from x_dirty where trim(coalesce(company_id, '')) = ''
union all select ordinal, 'duplicate_company_year', 'duplicate_key_flagged_for_manual_review_no_reliability_or_timestamp_signal' from b where copies > 1
union all select ordinal, 'turnover', {FAULT_SQL} from c where turnover in ('n/a', '-5', '-inf', 'inf')
union all select ordinal, 'employees', 'employees_exceeds_plausible_max' from c where employees > 500000
union all select ordinal, 'accounting_year', case when accounting_year <> floor(accounting_year) or accounting_year < 1000 then 'year_not_four_digit_integer' else 'year_outside_supported_range' end
  from c where not (accounting_year between 2013 and 2025 and accounting_year = floor(accounting_year))
union all select ordinal, 'mission', case when mission is null then 'missing_mission' else 'unrecognized_mission_value' end from d where canonical is null""")
def _(t):
    return checked_panel(t)[1]


@query("c18_validate_baseline", "company_id baseline_year:i baseline_turnover:m mission turnover_source primary_model_eligible:b", f"""
{BASELINE_CHAIN_SQL} select company_id, accounting_year as baseline_year, {VALUE_SQL} as baseline_turnover, canonical as mission,
  case when {VALUE_SQL} is not null then case when status = 'O' then 'estimated' else 'observed' end end as turnover_source,
  canonical <> 'Cross-Cutting' as primary_model_eligible from d where canonical is not null""")
def _(t):
    return checked_baseline(t)[0]


INVALID_SQL = f"""
select company_id, 'historical_panel' as source, cast(floor(accounting_year) as bigint) as offending_year, turnover as offending_value, {FAULT_SQL} as exclusion_reason
from ({PANEL_CHAIN_SQL} select * from c) z where turnover in ('n/a', '-5', '-inf', 'inf')
union all select company_id, 'completed_baseline', cast(floor(accounting_year) as bigint), turnover, {FAULT_SQL}
from ({BASELINE_CHAIN_SQL} select * from c) y where turnover in ('n/a', '-5', '-inf', 'inf')"""


@query("c16_invalid_flags", "company_id source offending_year:i offending_value exclusion_reason", INVALID_SQL)
def _(t):
    return quality.invalid_turnover_flags(checked_baseline(t)[1], checked_panel(t)[1])


@query("c17_exclude_invalid_history", "part company_id year:i", f"""
select 'panel' as part, company_id, accounting_year as year from ({PANEL_CHAIN_SQL} select * from d where canonical is not null) p
where company_id not in (select company_id from ({INVALID_SQL}) f)
union all select 'baseline', company_id, accounting_year from ({BASELINE_CHAIN_SQL} select * from d where canonical is not null) b
where company_id not in (select company_id from ({INVALID_SQL}) f)""")
def _(t):
    (baseline, baseline_log), (rows, rows_log) = checked_baseline(t), checked_panel(t)
    flags = quality.invalid_turnover_flags(baseline_log, rows_log)
    kept, kept_rows = quality.exclude_invalid_history(baseline, rows, flags)
    return kept_rows.select(F.lit("panel").alias("part"), "company_id", F.col("accounting_year").alias("year")).unionByName(
        kept.select(F.lit("baseline").alias("part"), "company_id", F.col("baseline_year").alias("year")))


@query("c19_negative_log_inputs", "company_id column value:m", """
select company_id, 'balance' as "column", balance as value from x_company where balance < 0
union all select company_id, 'shifted', balance - 500 from x_company where balance < 500""")
def _(t):
    df = t.company().withColumn("shifted", F.col("balance") - 500)
    return quality.negative_log_inputs(df, "company_id", ["balance", "shifted", "sic_code_1"])


@query("c20_validate_predictions", "ordinal:i value:m valid:b reason", """
select ordinal, case when turnover not in ('n/a', '-5', '-inf', 'inf') then cast(turnover as double) end as value,
  coalesce(turnover not in ('n/a', '-5', '-inf', 'inf'), false) as valid,
  case when turnover = '-5' then 'negative_prediction' when turnover is null or turnover in ('n/a', '-inf', 'inf') then 'non_finite_prediction' else '' end as reason from x_dirty""")
def _(t):
    scored = dirty(t).withColumn("predicted_total_turnover", N.number_of(F.col("turnover")))
    out = quality.validate_predictions(scored)
    return out.select("ordinal", F.col("predicted_total_turnover").alias("value"),
                      F.col("prediction_valid").alias("valid"), F.col("prediction_invalid_reason").alias("reason"))


@query("c22_one_per_company", "company_id source_id part", f"""
select made as company_id, company_id as source_id, case when count(*) over (partition by made) > 1 then 'review' else 'kept' end as part
from (select company_id, {ID_SQL} as made from x_company) z""")
def _(t):
    named = t.company().withColumnRenamed("company_id", "source_id")
    made = identity.with_company_id(named, "ch_no", "trading_name", "profile_url")
    kept, review = quality.one_row_per_company(made, "master")
    columns = ["company_id", "source_id"]
    return kept.select(*columns, F.lit("kept").alias("part")).unionByName(review.select(*columns, F.lit("review").alias("part")))


@query("c23_negative_age", "company_id year:i age:i original:i reason", """
select company_id, accounting_year as year, case when accounting_year >= founded_year then accounting_year - founded_year end as age,
  null as original, null as reason from x_filed
union all select company_id, accounting_year, null, accounting_year - founded_year, 'negative_company_age: turnover recorded in a year before Founded'
from x_filed where accounting_year < founded_year""")
def _(t):
    aged = t.filed().withColumn("company_age_years", F.col("accounting_year") - F.col("founded_year"))
    clean, log = quality.null_negative_age(aged)
    year, none = F.col("accounting_year").alias("year"), F.lit(None)
    return clean.select("company_id", year, F.col("company_age_years").alias("age"), none.cast("int").alias("original"), none.cast("string").alias("reason")).unionByName(
        log.select("company_id", year, none.cast("int").alias("age"), F.col("original_company_age_years").alias("original"), "reason"))


@query("c24_assign_id_foreign", "company_id ordinal:i", "select company_id, ordinal from x_suppliers")
def _(t):
    return adjacent.with_foreign_id(t.supplier_export())


@query("c25_exclude_overlap", "ordinal:i part", """
select ordinal, case when key in (select upper(ch_no) from x_company where ch_no is not null) then 'overlap' else 'kept' end as part from x_suppliers""")
def _(t):
    kept, overlap = identity.exclude_known_companies(t.supplier_export(), t.company(), f"`{FOREIGN_CH}`", "ch_no")
    return kept.select("ordinal", F.lit("kept").alias("part")).unionByName(overlap.select("ordinal", F.lit("overlap").alias("part")))


@query("c26_negative_guard", "mission rows:i turnover:m", """
select mission, count(*) as rows, cast(sum(cast(round(turnover, 2) as decimal(18,2))) as double) as turnover from x_panel group by mission""")
def _(t):
    guarded = quality.guard_non_negative(t.panel(), ["turnover", "employees", "total_assets"])
    total = money(F.sum(cents(F.round("turnover", 2))))
    return guarded.groupBy("mission").agg(F.count("*").alias("rows"), total.alias("turnover"))


@query("c27_cast_categorical", "company_id code balance", """
select company_id, cast(cast(sic_code_1 as bigint) as varchar) as code,
  case when balance = floor(balance) then cast(cast(balance as bigint) as varchar) else cast(balance as varchar) end as balance from x_company""")
def _(t):
    return t.company().select("company_id", X.category(F.col("sic_code_1")).alias("code"), X.category(F.col("balance")).alias("balance"))


# --- projections and derived columns ----------------------------------------------------------


@query("p1_rename_map", ["Organisation Name", "CH No. (full)", "Founded:i", "SIC Code 1:r", "Value Stream"], """
select company_name as "Organisation Name", ch_no as "CH No. (full)", founded_year as "Founded", sic_code_1 as "SIC Code 1", value_stream as "Value Stream" from x_company""")
def _(t):
    names = {"company_name": "Organisation Name", "ch_no": "CH No. (full)", "founded_year": "Founded",
             "sic_code_1": "SIC Code 1", "value_stream": "Value Stream"}
    renamed = t.company().withColumnsRenamed(names)
    back = readers.standard_master(renamed)
    return back.withColumnsRenamed(names)


@query("p2_segment_missions", "company_id value_stream mission exclusion_reason training_eligible:b is_true_duplicate:b",
       f"select company_id, value_stream, mission, exclusion_reason, training_eligible, is_true_duplicate from ({SEGMENT_SQL}) s")
def _(t):
    return segmented(t)[0]


@query("p2_segment_log", "company_id reason", f"""
select company_id, exclusion_reason as reason from ({SEGMENT_SQL}) s
where sic_code_1 = 21 or balance > 9800 or value_stream = 'MACHINERY'""")
def _(t):
    return segmented(t)[1]


@query("p3_split_labelled", "company_id part", """
select company_id, case when balance >= 0 then 'labelled' else 'inference' end as part from x_company""")
def _(t):
    labelled, inference = segments.split_labelled(t.master(), YEAR_COLUMNS)
    return labelled.select("company_id", F.lit("labelled").alias("part")).unionByName(
        inference.select("company_id", F.lit("inference").alias("part")))


def covariates(t: Tables) -> DataFrame:
    measures = ["total_turnover", "total_employees_ch", "total_employees_est", "balance_sheet_total_assets", "total_export_revenue"]
    return panel.melt_years(t.master(), ["company_id"], measures, YEARS)


@query("p4_employees_source", "company_id year:i total_employees:r employee_count_source", """
select c.company_id, y.year, coalesce(v.total_employees_ch, v.total_employees_est) as total_employees,
  case when v.total_employees_ch is not null then 'filed' when v.total_employees_est is not null then 'estimated' end as employee_count_source
from x_company c cross join (select unnest(range(2013, 2026)) as year) y left join x_covariates v on v.company_id = c.company_id and v.year = y.year""")
def _(t):
    return panel.employee_columns(covariates(t))


@query("p5_safe_ratio", "company_id year:i assets_per_order:r export_share:r", """
select company_id, accounting_year as year, total_assets / nullif(employees, 0) as assets_per_order, export_revenue / nullif(turnover, 0) as export_share from x_filed""")
def _(t):
    return t.filed().select("company_id", F.col("accounting_year").alias("year"),
                            N.ratio(F.col("total_assets"), F.col("employees")).alias("assets_per_order"),
                            N.ratio(F.col("export_revenue"), F.col("turnover")).alias("export_share"))


@query("p6_company_age", "company_id year:i age:i", """
select company_id, accounting_year as year, case when accounting_year >= founded_year then accounting_year - founded_year end as age from x_filed""")
def _(t):
    return t.filed().select("company_id", F.col("accounting_year").alias("year"),
                            N.age(F.col("accounting_year"), F.col("founded_year")).alias("age"))


@query("p7_recency_no_leak", "company_id year:i recency:i", """
select f.company_id, f.accounting_year as year, case when f.accounting_year >= e.grant_year then f.accounting_year - e.grant_year end as recency
from x_filed f left join x_events e on e.user_id = f.ordinal""")
def _(t):
    latest = t.signals().select("ordinal", F.col("`Grants - Date of the company's latest grant`").alias("d"))
    return t.filed().join(latest, "ordinal", "left").select(
        "company_id", F.col("accounting_year").alias("year"), N.recency(F.col("accounting_year"), F.col("d")).alias("recency"))


@query("p8_size_bucket", "company_id year:i company_size", "select company_id, accounting_year as year, company_size from x_size")
def _(t):
    return t.filings().select("company_id", F.col("accounting_year").alias("year"), N.size_bucket(F.col("employees")).alias("company_size"))


@query("p9_primary_code", "ordinal:i code:r", "select ordinal, nation as code from x_suppliers")
def _(t):
    return t.supplier_export().select("ordinal", N.primary_code(F.col(f"`{FOREIGN_CODES}`")).alias("code"))


BODY_NAME = {1: "HM Revenue of ", 2: "North County Council ", 3: "Royal nhs Trust ", 4: "Met Office ", 5: "SKAO ", 6: "Cern ", 7: "HMS Works "}


def body_names(t: Tables) -> DataFrame:
    prefix = F.lit("")
    for nation, text in BODY_NAME.items():
        prefix = F.when(F.col("sic_code_1") == nation, text).otherwise(prefix)
    return t.company().select("company_id", F.concat(prefix, "value_stream").alias("name"))


BODY_SQL = f"""select company_id, case cast(sic_code_1 as int) {' '.join(f"when {k} then '{v}'" for k, v in BODY_NAME.items())} else '' end||value_stream as name,
  cast(sic_code_1 as int) as nation from x_company"""


@query("p10_public_body_flag", "company_id flag:i", f"""
select company_id, cast(regexp_matches(name, '^HM \\w+|\\b\\w+ (County|City|Borough|District) Council\\b|\\bNHS\\b|Met Office', 'i') as int) as flag from ({BODY_SQL}) z""")
def _(t):
    return body_names(t).select("company_id", X.public_body_flag(F.col("name")).alias("flag"))


@query("p10_research_body_flag", "company_id flag:i", f"""
select company_id, cast(nation in (5, 6) as int) as flag from ({BODY_SQL}) z""")
def _(t):
    return body_names(t).select("company_id", X.research_body_flag(F.col("name")).alias("flag"))


@query("p11_slot_any_count", "ordinal:i slots:i any_slot:b", """
select c.ordinal, e.accelerator_count as slots, e.accelerator_count > 0 as any_slot from x_events e join x_company c on c.ordinal = e.user_id""")
def _(t):
    n = N.filled([F.col(f"`{c}`") for c in ACCELERATOR_SLOTS])
    return t.signals().select("ordinal", n.alias("slots"), (n > 0).alias("any_slot"))


@query("p12_bool_to_int", "ordinal:i equity:i patent:i", """
select c.ordinal, cast(e.s1 as int) as equity, cast(e.s8 as int) as patent from x_events e join x_company c on c.ordinal = e.user_id""")
def _(t):
    first, *_, last = list(BOOLEAN_SIGNALS)
    return t.signals().select("ordinal", F.col(f"`{first}`").cast("int").alias("equity"), F.col(f"`{last}`").cast("int").alias("patent"))


@query("p13_build_source3_features", "ordinal:i url_norm signal_equity_fundraising:i signal_ipo:i has_attended_accelerator:i accelerator_count:i "
       "is_academic_spinout:i grants_count:i grants_total_amount:m grant_year:i fundraising_count:i fundraising_total_amount:m fundraising_year:i", """
select c.ordinal, c.profile_url as url_norm, cast(e.s1 as int) as signal_equity_fundraising, cast(e.s6 as int) as signal_ipo,
  cast(e.accelerator_count > 0 as int) as has_attended_accelerator, e.accelerator_count, cast(e.is_academic_spinout as int) as is_academic_spinout,
  e.grants_count, e.grants_total_amount, e.grant_year, e.fundraising_count, e.fundraising_total_amount, e.fundraising_year
from x_events e join x_company c on c.ordinal = e.user_id""")
def _(t):
    out = features.signal_features(t.signals(), "profile_url")
    return out.withColumn("grant_year", F.year("grants_latest_date")).withColumn("fundraising_year", F.year("fundraising_latest_date"))


@query("p14_build_ratio_features", "ordinal:i year:i fs1_current_ratio:r fs1_gearing_pct:r fs1_rota_pct:r", """
select c.ordinal, f.accounting_year as year, f.total_assets / f.turnover as fs1_current_ratio, f.export_revenue / f.total_assets * 100 as fs1_gearing_pct,
  f.turnover / f.employees / 100 as fs1_rota_pct from x_last_filing f join x_company c on c.company_id = f.company_id""")
def _(t):
    return features.ratio_features(t.statements(), "profile_url")


@query("p17_evidence_group", "company_id n_turnover_years:i forecast_evidence_group", "select company_id, n_turnover_years, forecast_evidence_group from x_groups")
def _(t):
    return features.evidence_groups(t.baseline(), panel.history_properties(t.panel()))


@query("p22_growth_bucket", "company_id accounting_year:i growth_trajectory", """
select company_id, accounting_year, case when log_growth_1y > ln(1.1) then 'growing (>=10% YoY)' when log_growth_1y < -ln(1.1) then 'declining (<=-10% YoY)'
  when log_growth_1y is not null then 'flat (-10% to +10%)' else 'insufficient_history (no lag_1)' end as growth_trajectory from x_growth""")
def _(t):
    return features.with_growth_bucket(features.engineered_panel(t.panel()))


@query("p23_residuals", "company_id accounting_year:i residual:m abs_residual:m pct_error:r", """
select company_id, accounting_year, target_turnover_next_year - turnover_t as residual, abs(target_turnover_next_year - turnover_t) as abs_residual,
  (target_turnover_next_year - turnover_t) / nullif(target_turnover_next_year, 0) * 100 as pct_error from x_training""")
def _(t):
    return residuals(features.training_features(t.panel()), "target_turnover_next_year", "turnover_t")


@query("p24_value_route", "company_id sub_segment", """
select company_id, case when value_stream = 'HOUSEHOLD' then 'consultancy_other' else 'blended' end as sub_segment from x_company""")
def _(t):
    route = scoring.sub_segment(F.col("value_stream"), {"HOUSEHOLD": "consultancy_other", "FURNITURE": "blended"})
    return t.company().select("company_id", route.alias("sub_segment"))


@query("p27_strip_feature_name", "company_id feature base", """
select company_id, 'categorical__sic_code_1_'||cast(sic_code_1 as int) as feature, 'sic_code_1' as base from x_company
union all select company_id, 'plain_numeric__company_age_years', 'company_age_years' from x_company
union all select company_id, 'categorical__value_stream_'||value_stream, 'value_stream' from x_company""")
def _(t):
    code = F.concat(F.lit("categorical__sic_code_1_"), F.col("sic_code_1").cast("int").cast("string"))
    stream = F.concat(F.lit("categorical__value_stream_"), "value_stream")
    names = t.company().select("company_id", F.explode(F.array(code, F.lit("plain_numeric__company_age_years"), stream)).alias("feature"))
    return names.withColumn("base", X.base_feature_name(F.col("feature")))


@query("p26_threshold_cross", "company_id baseline_turnover:m turnover_2030:m", """
select b.company_id, b.baseline_turnover, f.peak as turnover_2030 from x_baseline b
join (select company_id, max(turnover) as peak from x_panel group by 1) f on f.company_id = b.company_id
where b.baseline_turnover < 10000000 and f.peak >= 10000000""")
def _(t):
    peak = t.panel().groupBy("company_id").agg(F.max("turnover").alias("turnover_2030"))
    return crossings(t.baseline().join(peak, "company_id"))


@query("p20_growth_multiple", "company_id multiple:r yearly:r", """
select b.company_id, b.baseline_turnover / nullif(f.t, 0) as multiple,
  case when b.baseline_year > f.y then pow(b.baseline_turnover / nullif(f.t, 0), 1.0 / (b.baseline_year - f.y)) - 1 end as yearly
from x_baseline b join (select company_id, arg_min(turnover, accounting_year) as t, min(accounting_year) as y from x_panel group by 1) f on f.company_id = b.company_id""")
def _(t):
    from ledgerline.operators.forecast import growth_multiple

    first = t.panel().groupBy("company_id").agg(F.min(F.struct("accounting_year", "turnover")).alias("f"))
    multiple, yearly = growth_multiple(F.col("baseline_turnover"), F.col("f.turnover"), F.col("baseline_year") - F.col("f.accounting_year"))
    return t.baseline().join(first, "company_id").select("company_id", multiple.alias("multiple"), yearly.alias("yearly"))


@query("p21_horizon_bucket", "company_id accounting_year:i cutoff_year:i horizon", """
select company_id, accounting_year, cutoff_year, horizon from x_tests""")
def _(t):
    from ledgerline.operators.splits import temporal_outer

    tests = temporal_outer(features.training_features(t.panel())).filter("role = 'test'")
    return tests.withColumn("horizon", N.horizon_bucket(F.col("target_year"), F.col("cutoff_year")))


@query("p28_static_features", "company_id mission sic_code_1:r company_size company_age_years:r multi_mission_overlap", """
select a.company_id, a.mission, a.sic_code_1, case when y.employees < 10 then 'Micro' when y.employees < 50 then 'Small' when y.employees < 250 then 'Medium' else 'Large' end as company_size,
  null as company_age_years, coalesce((select string_agg(o.mission, ', ' order by o.mission) from x_adjacent o where o.company_id = a.company_id and o.mission <> a.mission), '') as multi_mission_overlap
from x_adjacent a join (select * from x_sup_years qualify row_number() over (partition by l_suppkey order by year desc) = 1) y on y.l_suppkey = a.ordinal""")
def _(t):
    raw, _log = adjacent.load_all(t.adjacent_files(), t.company(), "ch_no", "ordinal")
    return adjacent.static_features(raw, adjacent.multi_mission_overlap(raw))


@query("a1_mission_summary", "mission total_companies:i training_eligible:i excluded_true_duplicate:i shared_ch_anomaly_not_excluded:i", f"""
select coalesce(mission, '(excluded: data entry error / miscategorized / unmapped)') as mission, count(*) as total_companies,
  count(*) filter (where mission is not null and training_eligible) as training_eligible, count(*) filter (where mission is not null and is_true_duplicate) as excluded_true_duplicate,
  count(*) filter (where mission is not null and is_shared_ch_anomaly and training_eligible) as shared_ch_anomaly_not_excluded from ({SEGMENT_SQL}) s group by 1""")
def _(t):
    return segments.mission_summary(segmented(t)[0])


@query("a20_value_counts", "check exclusion_reason rows:i", f"""
{PANEL_CHAIN_SQL} select 'company_id' as "check", 'missing_or_blank_company_id' as exclusion_reason, count(*) as rows from x_dirty where trim(coalesce(company_id, '')) = '' having count(*) > 0
union all select 'duplicate_company_year', 'duplicate_key_flagged_for_manual_review_no_reliability_or_timestamp_signal', count(*) from b where copies > 1 having count(*) > 0
union all select 'turnover', {FAULT_SQL}, count(*) from c where turnover in ('n/a', '-5', '-inf', 'inf') group by 2
union all select 'employees', 'employees_exceeds_plausible_max', count(*) from c where employees > 500000 having count(*) > 0
union all select 'accounting_year', case when accounting_year <> floor(accounting_year) or accounting_year < 1000 then 'year_not_four_digit_integer' else 'year_outside_supported_range' end, count(*)
  from c where not (accounting_year between 2013 and 2025 and accounting_year = floor(accounting_year)) group by 2
union all select 'mission', case when mission is null then 'missing_mission' else 'unrecognized_mission_value' end, count(*) from d where canonical is null group by 2""")
def _(t):
    from ledgerline.operators.metrics import value_counts

    return value_counts(checked_panel(t)[1], ["check", "exclusion_reason"])


@query("j1_join_lookup", "company_id value_stream mission", "select company_id, value_stream, mission from x_company")
def _(t):
    return t.company().drop("mission").join(mapping(t), "value_stream", "left")


@query("j13_dict_map", "company_id routed", """
select company_id, case mission when 'ACE' then 'Ridge' when 'Beyond Earth' then 'Company Historical CAGR'
  when 'Resilient Earth' then 'Company Historical CAGR' end as routed from x_company""")
def _(t):
    from ledgerline.settings import ROUTING

    table = F.create_map(*[F.lit(x) for m in CORE_MISSIONS for x in (m, ROUTING[m])])
    return t.company().select("company_id", F.try_element_at(table, F.col("mission")).alias("routed"))
