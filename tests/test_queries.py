"""Registered queries against their SQL on the same tables.

A spread of the keys by default; LEDGERLINE_ALL_QUERIES=1 runs every key."""

import math
import os

import pytest

from __spark_entry__ import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4)
    return value


def table(rows, order):
    def key(row):
        return tuple((v is None, str(type(v)), 0 if v is None else v) for v in row)

    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=key)


EVERY = os.environ.get("LEDGERLINE_ALL_QUERIES") == "1"
SPREAD = [
    "s3_scan_variants", "s5_load_all", "c3_apply_corrections", "c4_duplicate_identity", "c5_make_company_id",
    "c9_check_duplicates", "c10_check_turnover", "c16_invalid_flags", "c18_validate_panel", "p2_segment_missions",
    "p13_build_source3_features", "p15_turnover_cascade", "r2_long_panel", "r4_weeks_factor", "j9_annualize",
    "j14_multi_overlap", "w12_operational_scaling", "w16_latest_snapshot", "f14_engineered_panel", "f19_estimation_features",
    "v1_group_folds", "e4_evaluate_benchmark", "t4_pick_winner", "x6_similarity_assign", "f11_intervals",
    "f13_summary_2030", "g2_gazelle_tiers", "d6_spearman_direction", "m4_rare_category",
    "r2_eligible_panel", "d7_attendee_split", "s7_upsert_by_mission", "s10_export_tables",
]


@pytest.mark.parametrize("key", sorted(ORACLES) if EVERY else SPREAD)
def test_matches_sql(spark, duck, data, key):
    result = QUERIES[key](spark, data)
    expected = duck.execute(ORACLES[key])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(result.columns)
    want = table(expected.fetchall(), [names.index(c) for c in result.columns])
    got = table(result.collect(), range(len(names)))
    assert got == want


def test_every_statement_binds(duck):
    """Names and types of every statement fit the tables, whether or not its key is in the spread."""
    for key, sql in ORACLES.items():
        try:
            duck.execute("explain " + sql)
        except Exception as error:
            raise AssertionError(f"{key}: {error}") from error


# Minutes of fitting; run by hand.
SLOW = [
    "e1_evaluate_model", "e2_run_bakeoff", "d2_weight_sweep", "e14_pooled_bakeoff",
    "e16_oof_predictions", "j15_oof_join", "e18_feature_weights", "s11_comment_csv", "e3_evaluate_temporal", "e5_run_forecast_bakeoff",
    "e12_sub_models", "e15_pooled_against_own", "x3_predict_mission", "x7_cross_cutting_scores", "p15_estimated_turnover", "f13_estimated_summary", "t3_fitted_top15", "g8_fitted_usage",
]


FITTED = sorted(set(QUERIES) - set(ORACLES) - set(SLOW))


@pytest.mark.parametrize("key", FITTED if EVERY else ["e17_in_sample", "m6_assemble"])
def test_fitted_query_runs(spark, data, key):
    result = QUERIES[key](spark, data)
    assert len(result.columns) == len(set(result.columns))
    assert result.count() > 0
