"""Company tables derived from the given star schema.

Customers stand in for companies, order years (shifted by 20 to fall into the
supported range) for accounting years, suppliers for adjacent companies, events
for funding signals. A company with a negative balance files no turnover. The
first year of a company is a stub period from its first order to the year end.

Tables that stand for raw input files (master, statements, exports) are stored
once per `Tables`, as the files they stand for would be; the others stay lazy."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.numeric import age, size_bucket
from ledgerline.operators.panel import annualize
from ledgerline.sources.writers import written
from ledgerline.settings import (
    ACCELERATOR_SLOTS,
    BOOLEAN_SIGNALS,
    FOREIGN_CH,
    FOREIGN_CODES,
    FOREIGN_FIRST_CODE,
    FOREIGN_NAME,
    FUNDRAISING_COLUMNS,
    GRANT_COLUMNS,
    MASTER_KEYWORDS,
    SPINOUT_SLOTS,
    STATEMENT_DATE,
    STATEMENT_FIELDS,
    STATEMENT_RATIOS,
    STATEMENTS,
    YEAR_MEASURES,
    YEARS,
)

SHIFT = 20
MISSION_OF = {
    "AUTOMOBILE": "ACE",
    "BUILDING": "Beyond Earth",
    "FURNITURE": "Resilient Earth",
    "HOUSEHOLD": "Cross-cutting",
}


def cents(col: Column | str) -> Column:
    """Two-decimal amount as whole cents, so sums are exact and cheap in any order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 100 + 0.5)


def money(total: Column, factor: int = 1) -> Column:
    return (total * factor) / F.lit(100.0)


def mission_of(segment: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, mission in MISSION_OF.items():
        out = F.when(segment == key, mission).otherwise(out)
    return out


def shifted(ts: Column) -> Column:
    return F.add_months(ts.cast("date"), 12 * SHIFT)


_SCHEMAS: dict[str, StructType] = {}


def once(build: Callable) -> Callable:
    """Build each derived table once per `Tables`, so its plan is analysed once."""

    @wraps(build)
    def cached(self):
        if build.__name__ not in self.built:
            self.built[build.__name__] = build(self)
        return self.built[build.__name__]

    return cached


class Tables:
    """Lazy tables under one directory of parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.built: dict = {}  # tables and the flow, by name

    def table(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @once
    def company(self) -> DataFrame:
        key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
        segment = F.col("c_mktsegment")
        shared = F.when(balance < 0, key + 1).otherwise(key)
        bucket = F.floor(F.abs(balance) / 500).cast("bigint").cast("string")
        return self.table("customer").select(
            F.concat(F.lit("c"), key.cast("string")).alias("company_id"),
            key.alias("ordinal"),
            F.col("c_name").alias("company_name"),
            F.concat(
                F.lit("The "), segment, F.when(nation < 12, " Holdings Ltd.").otherwise(" (UK) PLC")
            ).alias("trading_name"),
            F.when(nation != 0, F.concat(F.lit("CH"), shared.cast("string"))).alias("ch_no"),
            F.concat_ws(
                "/", F.lit("https://profiles.example"), F.lower(segment), nation.cast("string"), bucket
            ).alias("profile_url"),
            segment.alias("value_stream"),
            mission_of(segment).alias("mission"),
            nation.cast("double").alias("sic_code_1"),
            (nation + 1995).alias("founded_year"),
            balance.alias("balance"),
        )

    @once
    def filings(self) -> DataFrame:
        """(company, year) totals of orders and their lines, with weeks covered."""
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.sum(cents("l_quantity")).alias("q"),
                F.sum(cents("l_extendedprice")).alias("a"),
                F.sum(F.when(F.col("l_returnflag") == "R", cents("l_extendedprice"))).alias("x"),
            )
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        year = F.year(shifted(F.col("o_orderdate")))
        yearly = (
            orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .groupBy("o_custkey", year.alias("accounting_year"))
            .agg(
                money(F.sum(cents("o_totalprice")), 20).alias("turnover"),
                money(F.sum("q")).alias("employees"),
                money(F.sum("a")).alias("total_assets"),
                money(F.sum("x")).alias("export_revenue"),
                F.min(shifted(F.col("o_orderdate"))).alias("first_date"),
                F.max(shifted(F.col("o_orderdate"))).alias("last_date"),
            )
        )
        by_company = Window.partitionBy("o_custkey")
        first_year = F.min("accounting_year").over(by_company)
        year_end = F.make_date(F.col("accounting_year"), F.lit(12), F.lit(31))
        stub = F.ceil((F.date_diff(year_end, F.col("first_date")) + 1) / 7.0)
        weeks = F.when(F.col("accounting_year") == first_year, stub).otherwise(52).cast("double")
        known = F.col("employees").isNotNull()
        return yearly.withColumn("weeks", F.when(known, weeks)).withColumn(
            "company_id", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
        )

    @once
    def stored_filings(self) -> DataFrame:
        """`filings`, stored: the master and the statements are both cut from them."""
        self.built["filings"] = written(self.filings(), "filings")
        return self.built["filings"]

    @once
    def stored_filed(self) -> DataFrame:
        """`filed`, stored: both inputs of the forecast are cut from it."""
        self.built["filed"] = written(self.filed(), "filed")
        return self.built["filed"]

    @once
    def filed(self) -> DataFrame:
        """Filings with their company's facts; turnover only where one is filed."""
        facts = self.company().select(
            "company_id", "ordinal", "company_name", "mission", "value_stream", "sic_code_1", "founded_year", "balance"
        )
        joined = self.filings().drop("o_custkey").join(facts, "company_id")
        return joined.withColumn("turnover", F.when(F.col("balance") >= 0, F.col("turnover")))

    @once
    def factors(self) -> DataFrame:
        known = self.filings().filter(F.col("weeks").isNotNull())
        return known.select(
            "company_id",
            F.col("accounting_year").alias("year"),
            "weeks",
            (F.lit(52.0) / F.col("weeks")).alias("annualization_factor"),
        )

    @once
    def raw_panel(self) -> DataFrame:
        """Observed company-years before annualisation, missions spelled canonically."""
        mission = F.when(F.col("mission") == "Cross-cutting", "Cross-Cutting").otherwise(F.col("mission"))
        observed = self.filed().filter(F.col("turnover").isNotNull() & F.col("mission").isNotNull())
        return observed.select(
            "company_id",
            "company_name",
            mission.alias("mission"),
            "value_stream",
            "sic_code_1",
            "founded_year",
            "accounting_year",
            "turnover",
            "employees",
            "total_assets",
            "export_revenue",
            "weeks",
            size_bucket(F.col("employees")).alias("company_size"),
            age(F.col("accounting_year"), F.col("founded_year")).alias("company_age"),
        )

    @once
    def panel(self) -> DataFrame:
        """Validated panel: turnover scaled by the weeks of the same row."""
        factor = F.coalesce(F.lit(52.0) / F.col("weeks"), F.lit(1.0))
        scaled = F.when(factor != 1.0, F.col("turnover") * factor).otherwise(F.col("turnover"))
        return self.raw_panel().withColumn("turnover", scaled).drop("weeks")

    @once
    def baseline(self) -> DataFrame:
        """Latest observed turnover per company, else a stand-in estimate."""
        mission = F.when(F.col("mission") == "Cross-cutting", "Cross-Cutting").otherwise(F.col("mission"))
        rows = self.filed().filter(F.col("mission").isNotNull())
        factor = F.coalesce(F.lit(52.0) / F.col("weeks"), F.lit(1.0))
        scaled = F.when(factor != 1.0, F.col("turnover") * factor).otherwise(F.col("turnover"))
        value = F.coalesce(scaled, F.col("total_assets") / 10)
        last = rows.groupBy("company_id").agg(
            F.max(
                F.struct(
                    F.col("accounting_year").alias("baseline_year"),
                    "company_name",
                    mission.alias("mission"),
                    value.alias("baseline_turnover"),
                    F.col("turnover").isNotNull().alias("seen"),
                    "employees",
                )
            ).alias("l")
        )
        out = last.select("company_id", "l.*")
        seen = F.col("seen")
        known = F.col("baseline_turnover").isNotNull()
        low = F.col("employees").isNull()
        return out.select(
            "company_id",
            "company_name",
            "mission",
            "baseline_year",
            "baseline_turnover",
            F.when(known, F.when(seen, "observed").otherwise("estimated")).alias("turnover_source"),
            F.when(seen, "observed").when(low, "low").otherwise("standard").alias("baseline_reliability"),
            F.when(~seen & low, "no_covariate_data_any_year").otherwise("").alias("reliability_reason"),
            F.when(seen, "observed").otherwise("predicted").alias("turnover_source_raw"),
        )

    @once
    def static(self) -> DataFrame:
        return self.company().select("company_id", "founded_year", "sic_code_1", "value_stream")

    # --- wide inputs -----------------------------------------------------------------

    @once
    def master(self) -> DataFrame:
        """One row per company with a column per measure and year."""
        filings = self.stored_filings()
        facts = self.company()
        bare = F.col("balance") < -900
        values = {
            "total_turnover": F.when(F.col("balance") >= 0, F.col("turnover")),
            "total_employees_ch": F.when((F.col("sic_code_1") >= 5) & ~bare, F.col("employees")),
            "total_employees_est": F.when(~bare, F.col("employees") * 2),
            "balance_sheet_total_assets": F.when(~bare, F.col("total_assets")),
            "total_export_revenue": F.when(~bare, F.col("export_revenue")),
            "company_size": F.when(~bare, size_bucket(F.col("employees"))),
        }
        joined = filings.drop("o_custkey").join(facts.select("company_id", "balance", "sic_code_1"), "company_id")
        wide = joined.groupBy("company_id").agg(
            *[
                F.max(F.when(F.col("accounting_year") == y, value)).alias(YEAR_MEASURES[m].format(year=y))
                for y in YEARS
                for m, value in values.items()
            ]
        )
        words = F.concat_ws(",", F.col("value_stream"), F.concat(F.lit("Nation "), F.col("sic_code_1").cast("int").cast("string")))
        return written(facts.withColumn(MASTER_KEYWORDS, words).join(wide, "company_id", "left"), "master")

    @once
    def segmented(self) -> DataFrame:
        """Master with duplicate and eligibility flags already decided."""
        mission = F.col("mission")
        eligible = F.coalesce(mission != "Cross-cutting", F.lit(False))
        reason = F.when(mission.isNull(), "unmapped_value_stream").otherwise("")
        return self.master().withColumns(
            {
                "is_true_duplicate": F.lit(False),
                "is_shared_ch_anomaly": F.lit(False),
                "training_eligible": eligible,
                "sample_weight": F.lit(1.0),
                "exclusion_reason": reason,
                "is_miscategorised": F.lit(False),
            }
        )

    @once
    def statements(self) -> DataFrame:
        """Statement blocks per company, newest first, keyed by a URL variant."""
        newest = Window.partitionBy("o_custkey").orderBy(F.col("accounting_year").desc())
        rows = self.stored_filings().withColumn("block", F.row_number().over(newest))
        columns = [
            F.max(F.when(F.col("block") == n, F.col("last_date"))).alias(STATEMENT_DATE.format(n=n))
            for n in range(1, STATEMENTS + 1)
        ]
        source = {
            "turnover": "turnover",
            "weeks": "weeks",
            "total_employees": "employees",
            "balance_sheet_total_assets": "total_assets",
        }
        for field, header in STATEMENT_FIELDS.items():
            columns += [
                F.max(F.when(F.col("block") == n, F.col(source[field]))).alias(header.format(n=n))
                for n in range(1, STATEMENTS + 1)
            ]
        first = F.col("block") == 1
        ratios = {
            "Current ratio": F.col("total_assets") / F.col("turnover"),
            "Liquidity acid test": F.col("export_revenue") / F.col("turnover"),
            "Gearing (%)": F.col("export_revenue") / F.col("total_assets") * 100,
            "Equity (%)": F.col("turnover") / F.col("total_assets"),
            "Current debt ratio": F.col("employees") / F.col("weeks"),
            "Total debt ratio": F.col("employees") / F.col("turnover") * 1000,
            "Return on capital employed (%)": F.col("total_assets") / F.col("employees") / 100,
            "Return on total assets employed (%)": F.col("turnover") / F.col("employees") / 100,
            "Return on net assets employed (%)": F.col("export_revenue") / F.col("employees") / 100,
        }
        assert list(ratios) == list(STATEMENT_RATIOS)
        columns += [
            F.max(F.when(first, value)).alias(f"Financial Statement 1 - {name}") for name, value in ratios.items()
        ]
        wide = rows.groupBy("company_id").agg(*columns)
        url = F.concat(F.lit(" "), F.upper("profile_url"), F.lit("/"))
        keyed = self.company().select("company_id", "ordinal", url.alias("profile_url"))
        return written(keyed.join(wide, "company_id").drop("company_id"), "statements")

    @once
    def signals(self) -> DataFrame:
        """Funding signals per company from its events, keyed by profile URL."""
        value = F.col("value")
        kind = F.col("event_type")

        def text_total(event: str) -> Column:
            total = F.sum(F.when(kind == event, cents("value")))
            small = F.coalesce(F.max(F.when(kind == event, value)) < 25, F.lit(True))
            return F.when(small, "(no value)").otherwise(money(total).cast("string"))

        def latest(event: str) -> Column:
            months = F.floor(F.max(F.when(kind == event, value))).cast("int")
            return F.add_months(F.max(F.when(kind == event, F.col("ts"))).cast("date"), -months)

        kinds = ["click", "view", "purchase", "signup", "error"]
        booleans = [
            (F.count_if((kind == kinds[i % 5]) & (value > 20 + 5 * i)) > 0).alias(name)
            for i, name in enumerate(BOOLEAN_SIGNALS)
        ]
        slots = [
            F.max(F.when((kind == kinds[i]) & (value > 30), kind)).alias(name)
            for i, name in enumerate(ACCELERATOR_SLOTS)
        ]
        spinouts = [
            F.max(F.when((kind == kinds[i]) & (value > 45), kind)).alias(name)
            for i, name in enumerate(SPINOUT_SLOTS)
        ]
        grants = [
            F.count_if(kind == "click").alias(GRANT_COLUMNS["grants_count"]),
            text_total("click").alias(GRANT_COLUMNS["grants_total_amount"]),
            latest("click").alias(GRANT_COLUMNS["grants_latest_date"]),
        ]
        funds = [
            F.count_if(kind == "purchase").alias(FUNDRAISING_COLUMNS["fundraising_count"]),
            text_total("purchase").alias(FUNDRAISING_COLUMNS["fundraising_total_amount"]),
            latest("purchase").alias(FUNDRAISING_COLUMNS["fundraising_latest_date"]),
        ]
        per_user = self.table("events").groupBy("user_id").agg(*booleans, *slots, *spinouts, *grants, *funds)
        keyed = self.company().select("ordinal", F.concat("profile_url", F.lit("//")).alias("profile_url"))
        return keyed.join(per_user, F.col("ordinal") == F.col("user_id")).drop("user_id")

    # --- adjacent companies -------------------------------------------------------------

    @once
    def supplier_years(self) -> DataFrame:
        year = F.year(shifted(F.col("l_shipdate")))
        return (
            self.table("lineitem")
            .groupBy("l_suppkey", year.alias("year"))
            .agg(
                money(F.sum(cents("l_extendedprice")), 2).alias("turnover"),
                money(F.sum(cents("l_quantity"))).alias("employees"),
                money(F.sum(F.when(F.col("l_returnflag") == "A", cents("l_extendedprice")))).alias("assets"),
                F.max(shifted(F.col("l_shipdate"))).alias("last_date"),
                F.count_distinct(F.weekofyear(shifted(F.col("l_shipdate")))).alias("active_weeks"),
            )
            .withColumn("weeks", F.least(F.col("active_weeks"), F.lit(52)).cast("double"))
        )

    @once
    def supplier_export(self) -> DataFrame:
        """One export row per supplier with its statement blocks, stored like the raw
        file it stands for, so the slices below scan it instead of rebuilding it."""
        newest = Window.partitionBy("l_suppkey").orderBy(F.col("year").desc())
        rows = self.supplier_years().withColumn("block", F.row_number().over(newest))
        source = {
            "turnover": "turnover",
            "weeks": "weeks",
            "total_employees": "employees",
            "balance_sheet_total_assets": "assets",
        }
        columns = []
        for n in range(1, STATEMENTS + 1):
            here = F.col("block") == n
            date = F.max(F.when(here, F.col("last_date"))).cast("string")
            columns.append(date.alias(STATEMENT_DATE.format(n=n)))
            for field, header in STATEMENT_FIELDS.items():
                columns.append(F.max(F.when(here, F.col(source[field]))).alias(header.format(n=n)))
        first = F.col("block") == 1
        for i, name in enumerate(STATEMENT_RATIOS):
            value = F.col("assets") / F.col("turnover") * (i + 1)
            columns.append(F.max(F.when(first, value)).alias(f"Financial Statement 1 - {name}"))
        wide = rows.groupBy("l_suppkey").agg(*columns)
        nation, key = F.col("s_nationkey"), F.col("s_suppkey")
        number = F.concat(F.lit(" ch"), (nation * 100000 + key).cast("string"))
        codes = F.concat(nation.cast("string"), F.lit(", 99999"))
        suppliers = self.table("supplier").select(
            key.alias("ordinal"),
            number.alias(FOREIGN_CH),
            F.concat(F.lit("The "), F.col("s_name"), F.lit(" Limited")).alias(FOREIGN_NAME),
            F.concat(F.lit("https://suppliers.example/"), key.cast("string")).alias("profile_url"),
            codes.alias(FOREIGN_CODES),
            nation.alias("nation"),
            F.col("s_acctbal").alias("balance"),
        )
        export = suppliers.join(wide, F.col("ordinal") == F.col("l_suppkey")).drop("l_suppkey")
        return written(export, "supplier_export")

    @once
    def supplier_signals(self) -> DataFrame:
        """Funding columns per supplier, from the events of the same user id."""
        signals = self.signals().drop("profile_url")
        keys = self.table("supplier").select(
            F.col("s_suppkey").alias("ordinal"),
            F.concat(F.lit("https://suppliers.example/"), F.col("s_suppkey").cast("string")).alias("profile_url"),
        )
        rows = keys.join(signals, "ordinal").drop("ordinal")
        dates = [GRANT_COLUMNS["grants_latest_date"], FUNDRAISING_COLUMNS["fundraising_latest_date"]]
        return written(rows.withColumns({d: F.col(f"`{d}`").cast("string") for d in dates}), "supplier_signals")

    def adjacent_files(self) -> dict[str, list[DataFrame]]:
        """Source files per mission: attribute slices of the supplier export."""
        from ledgerline.operators.adjacent import normalise_variant

        export, side = self.supplier_export(), self.supplier_signals()
        numbered = export.withColumnRenamed(FOREIGN_CODES, FOREIGN_FIRST_CODE)

        def cut(df: DataFrame, condition: str, style: bool = False) -> DataFrame:
            return normalise_variant(df.filter(condition), numbered_codes=style, side=side).drop("nation", "balance")

        return {
            "ACE": [cut(export, "balance >= 4000"), cut(numbered, "nation < 10", True)],
            "Beyond Earth": [cut(export, "balance < 6000")],
            "Resilient Earth": [cut(export, "nation >= 12")],
            "Cross-cutting": [cut(numbered, "nation < 5", True)],
        }


def annualized(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Raw panel scaled through the factor table."""
    return annualize(tables.raw_panel().drop("weeks"), "turnover", "accounting_year", tables.factors())


