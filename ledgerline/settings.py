"""Thresholds, closed domains and declared feature lists."""

import math

# --- fixed values: years, missions, populations --------------------------------
YEARS = list(range(2013, 2026))
SUPPORTED_YEARS = (2013, 2025)
FORECAST_END_YEAR = 2030

CORE_MISSIONS = ["ACE", "Beyond Earth", "Resilient Earth"]
CROSS_CUTTING = "Cross-cutting"
FORECAST_MISSIONS = ["ACE", "Beyond Earth", "Resilient Earth", "Cross-Cutting"]

SPACE = "space"
ADJACENT = "adjacent"

# --- fixed values: input header formats -----------------------------------------
MASTER_NAME = "Organisation Name"
MASTER_CH = "CH No. (full)"
MASTER_CH_SHORT = "CH No."
MASTER_COLUMNS = {"Founded": "founded_year", "SIC Code 1": "sic_code_1", "Value Stream": "value_stream"}
MASTER_KEYWORDS = "LinkedIn Specialties (Keywords)"
YEAR_MEASURES = {
    "total_turnover": "Total Turnover (CH {year})",
    "total_employees_ch": "Total Employees (CH {year})",
    "total_employees_est": "Total Employees (Est. {year})",
    "balance_sheet_total_assets": "Balance Sheet Total Assets ({year})",
    "total_export_revenue": "Total Export Revenue {year}",
    "company_size": "Size {year}",
}
STATEMENTS = 10
STATEMENT_DATE = "Financial Statement {n} - Date of accounts"
STATEMENT_FIELDS = {
    "turnover": "Financial Statement {n} - Turnover",
    "weeks": "Financial Statement {n} - Number of weeks in the accounting year",
    "total_employees": "Financial Statement {n} - Number of employees",
    "balance_sheet_total_assets": "Financial Statement {n} - Total assets",
}
ACCELERATOR_SLOTS = [f"Accelerator Attendances {i} - Accelerator Name" for i in range(1, 6)]
SPINOUT_SLOTS = [f"Academic Spinout Events {i} - Academic Institution Name" for i in range(1, 3)]
GRANT_COLUMNS = {
    "grants_count": "Grants - Number of grants received by the company",
    "grants_total_amount": "Grants - Total amount received by the company through grants (GBP)",
    "grants_latest_date": "Grants - Date of the company's latest grant",
}
FUNDRAISING_COLUMNS = {
    "fundraising_count": "Fundraisings - Number of fundraisings completed by the company",
    "fundraising_total_amount": (
        "Fundraisings - Total amount received by the company through fundraisings (GBP)"
    ),
    "fundraising_latest_date": "Fundraisings - Date of the company's latest fundraising",
}
FOREIGN_CH = "Companies House ID"
FOREIGN_NAME = "Company name"
FOREIGN_CODES = "SIC Codes (2007) - Code"
FOREIGN_FIRST_CODE = "SIC Codes (2007) 1 - Code"

# --- fixed values: estimation -----------------------------------------------------
STALE_AFTER_YEARS = 3
OUT_OF_RANGE_FACTOR = 1.5
FOLDS, REPEATS, INNER_FOLDS = 5, 5, 3
SEED = 42
RARE_CATEGORY = 5
RANK_TOLERANCE = 1.0
R2_TOLERANCE = 0.05
BROKEN_FOLD_R2 = -2.0
MAE_BLOWUP = 3.0
USABLE_R2 = 0.0
MAX_EMPLOYEES = 500_000
NO_VALUE = "(no value)"

SIMPLICITY = {
    "Linear Regression": 1,
    "Ridge": 2,
    "Lasso": 2,
    "Elastic Net": 2,
    "k-NN": 3,
    "SVR": 4,
    "Gradient Boosting": 5,
    "Random Forest": 5,
    "Extra Trees": 5,
    "CatBoost": 6,
}
FORECAST_SIMPLICITY = {
    "Persistence": 0,
    "Mission-Average Growth": 0,
    "Company Historical CAGR": 0,
    "Linear Regression": 1,
    "Ridge": 2,
    "Lasso": 2,
    "Elastic Net": 2,
    "SVR": 4,
    "Gradient Boosting": 5,
    "Histogram Gradient Boosting": 5,
    "Random Forest": 5,
    "Extra Trees": 5,
    "CatBoost": 5,
}

# --- fixed values: forecasting ----------------------------------------------------
OUTER_CUTOFFS = [2018, 2019, 2020, 2021]
INNER_OFFSETS = [3, 2]
BENCHMARKS = ["Persistence", "Mission-Average Growth", "Company Historical CAGR"]
GROWTH_CUT = math.log(1.1)
DECAY_HALF_LIFE = 2.0
ROUTING = {
    "ACE": "Ridge",
    "Beyond Earth": "Company Historical CAGR",
    "Resilient Earth": "Company Historical CAGR",
    "Cross-Cutting": "Company Historical CAGR",
}
STABLE_MODEL = "Persistence"
TREND_MODEL = "Company Historical CAGR"
TREND_EVIDENCE = "A"
EVIDENCE_GROUPS = ["A", "B", "C", "D"]
Z_SCORE = 1.96
MIN_SPREAD_SAMPLES = 5

# --- fixed values: reports --------------------------------------------------------
TEN_MILLION = 10_000_000
FIFTY_MILLION = 50_000_000
ONE_MILLION = 1_000_000
GAZELLE_YEARS = 3
GAZELLE_CUTS = {"10pct": math.log(1.1), "20pct": math.log(1.2)}
RECENT_YEARS = 5
TOP_FEATURES = 15
MIN_WEIGHT = 1e-9

# --- fixed values: declared features, estimation -------------------------------------------------
BOOLEAN_SIGNALS = {
    "Growth signals - Equity fundraising": "signal_equity_fundraising",
    "Growth signals - Debt fundraising": "signal_debt_fundraising",
    "Growth signals - MBO/MBI": "signal_mbo_mbi",
    "Growth signals - Acquired": "signal_acquired",
    "Growth signals - Made acquisition": "signal_made_acquisition",
    "Growth signals - IPO": "signal_ipo",
    "Innovation signals - R&D grant": "signal_rd_grant",
    "Innovation signals - Patent": "signal_patent",
}
STATEMENT_RATIOS = {
    "Current ratio": "fs1_current_ratio",
    "Liquidity acid test": "fs1_liquidity_acid_test",
    "Gearing (%)": "fs1_gearing_pct",
    "Equity (%)": "fs1_equity_pct",
    "Current debt ratio": "fs1_current_debt_ratio",
    "Total debt ratio": "fs1_total_debt_ratio",
    "Return on capital employed (%)": "fs1_roce_pct",
    "Return on total assets employed (%)": "fs1_rota_pct",
    "Return on net assets employed (%)": "fs1_ronae_pct",
}
ESTIMATION_LOG = [
    "total_employees",
    "balance_sheet_total_assets",
    "total_export_revenue",
    "assets_per_employee",
    "export_revenue_per_employee",
    "grants_count",
    "grants_total_amount",
    "fundraising_count",
    "fundraising_total_amount",
]
ESTIMATION_PLAIN = [
    "year",
    "company_age_years",
    "grant_recency_years",
    "fundraising_recency_years",
    "accelerator_count",
    *BOOLEAN_SIGNALS.values(),
    "has_attended_accelerator",
    "is_academic_spinout",
    "is_public_sector_body",
    "is_international_research_body",
    *STATEMENT_RATIOS.values(),
]
ESTIMATION_CATEGORIES = ["employee_count_source", "company_size", "sic_code_1", "value_stream"]
# --- fixed values: declared features, forecasting ------------------------------------------------
FORECAST_LOG = [
    "turnover_t",
    "turnover_lag_1",
    "turnover_lag_2",
    "turnover_lag_3",
    "rolling_turnover_mean_2",
    "rolling_turnover_mean_3",
    "rolling_turnover_median_3",
    "historical_turnover_max",
    "historical_turnover_min",
    "total_assets",
    "assets_per_employee",
    "employees",
    "export_revenue",
]
FORECAST_PLAIN = [
    "company_age",
    "n_prior_turnover_values",
    "history_span_years",
    "years_since_previous_turnover",
    "consecutive_history_length_to_date",
    "log_growth_1y",
    "log_growth_2y_mean",
    "log_growth_3y_mean",
    "growth_volatility",
    "growth_acceleration",
    "positive_growth_count",
    "negative_growth_count",
    "employee_growth",
    "asset_growth",
    "export_share",
    "missing_feature_count",
    "missing_feature_proportion",
    "has_growth_history",
    "has_three_year_history",
    "has_employee_data",
    "has_financial_statement_data",
]
FORECAST_CATEGORIES = ["value_stream", "company_size", "sic_code_1", "estimation_reliability"]

ENGINEERED = [
    "turnover_t",
    "turnover_lag_1",
    "turnover_lag_2",
    "turnover_lag_3",
    "log_turnover_t",
    "log_turnover_lag_1",
    "log_turnover_lag_2",
    "log_growth_1y",
    "log_growth_2y_mean",
    "log_growth_3y_mean",
    "rolling_growth_mean_3",
    "growth_volatility",
    "rolling_growth_std_3",
    "growth_acceleration",
    "positive_growth_count",
    "negative_growth_count",
    "rolling_turnover_mean_2",
    "rolling_turnover_mean_3",
    "rolling_turnover_median_3",
    "historical_turnover_max",
    "historical_turnover_min",
    "n_prior_turnover_values",
    "history_span_years",
    "years_since_previous_turnover",
    "consecutive_history_length_to_date",
    "has_growth_history",
    "has_three_year_history",
    "assets_per_employee",
    "export_share",
    "employee_growth",
    "asset_growth",
    "is_missing_turnover_lag_1",
    "is_missing_turnover_lag_2",
    "is_missing_turnover_lag_3",
    "is_missing_total_assets",
    "is_missing_employees",
    "is_missing_export_revenue",
    "has_employee_data",
    "has_financial_statement_data",
]

REQUIRED_BASELINE_FIELDS = [
    "company_id", "company_name", "mission", "baseline_year", "baseline_turnover",
    "turnover_source", "baseline_lower", "baseline_upper", "baseline_reliability",
]
REQUIRED_PANEL_FIELDS = [
    "company_id", "company_name", "mission", "accounting_year", "turnover", "employees",
    "total_assets", "current_assets", "liabilities", "funding_raised", "export_revenue",
    "company_age", "company_size", "value_stream",
]
