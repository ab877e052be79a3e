"""Edge rules on small hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import numeric as N
from ledgerline.functions import text as X
from ledgerline.operators import features, forecast, identity, panel, quality, reports, segments, selection


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_names_and_ids(spark):
    df = spark.createDataFrame(
        [(1, "The Foo Group Ltd.", " ab1 ", None), (2, None, None, None), (3, "N", None, "U"), (4, "N", " ", "U")],
        "i int, name string, ch string, url string",
    )
    out = df.select("i", X.normalized_name(F.col("name")), X.company_id(F.col("ch"), F.col("name"), F.col("url")))
    import hashlib

    digest = hashlib.sha1(b"n|u").hexdigest()[:12]
    rows = {r[0]: (r[1], r[2]) for r in out.collect()}
    assert rows[1] == ("foo", "ch_AB1_foo")
    assert rows[2][0] == ""
    assert rows[3][1] == rows[4][1] == f"fallback_{digest}"


def test_shared_numbers(spark):
    rows = [("X", "Foo Ltd"), ("X", "FOO limited"), ("Y", "A"), ("Y", "B"), (None, "C"), (None, "C")]
    df = spark.createDataFrame([(c, n, "u") for c, n in rows], "ch string, name string, url string")
    flagged, log = identity.resolve_duplicates(df, "ch", "name", "url")
    got = sorted(values(flagged, "name", "is_true_duplicate", "is_shared_ch_anomaly"))
    assert got == sorted(
        [("Foo Ltd", True, False), ("FOO limited", True, False), ("A", False, True), ("B", False, True), ("C", False, False), ("C", False, False)]
    )
    assert log.count() == 4


def test_turnover_check(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["12", "x", "-1", "-inf", None])], "i int, turnover string")
    clean, log = quality.check_turnover(df)
    assert values(clean.orderBy("i"), "turnover") == [(12.0,), (None,), (None,), (None,), (None,)]
    assert values(log.orderBy("i"), "turnover", "exclusion_reason") == [
        ("x", "turnover_non_numeric"), ("-1", "turnover_negative"), ("-inf", "turnover_non_finite")]


def test_year_check(spark):
    df = spark.createDataFrame([(2013.0,), (2013.5,), (13.0,), (2031.0,)], "y double")
    clean, log = quality.check_years(df, "y")
    assert values(clean, "y") == [(2013,)]
    assert sorted(values(log, "exclusion_reason")) == [
        ("year_not_four_digit_integer",), ("year_not_four_digit_integer",), ("year_outside_supported_range",)]


def test_duplicate_check_keeps_first_and_null_keys_are_equal(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 2), ("b", 1, 1), (None, 1, 7), (None, 1, 6)], "company_id string, y int, o int")
    clean, log = quality.check_duplicates(df, ["company_id", "y"], "o")
    assert sorted(values(clean, "o")) == [(1,), (2,), (6,)]
    assert sorted(values(log, "o")) == [(2,), (5,), (6,), (7,)]


def test_one_row_per_company_removes_all_copies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "company_id string, v int")
    kept, review = quality.one_row_per_company(df, "stage")
    assert values(kept, "v") == [(3,)]
    assert sorted(values(review, "v")) == [(1,), (2,)]


def test_guards_fail_the_job(spark):
    df = spark.createDataFrame([("a", -1.0)], "company_id string, turnover double")
    with pytest.raises(Exception, match="negative value in turnover"):
        quality.guard_non_negative(df, ["turnover"]).collect()
    twice = spark.createDataFrame([("a", 2013, 26.0, 2.0), ("a", 2013, 26.0, 2.0)], "company_id string, year int, weeks double, annualization_factor double")
    rows = spark.createDataFrame([("a", 2013, 100.0)], "company_id string, accounting_year int, turnover double")
    with pytest.raises(Exception, match="repeated key"):
        panel.annualize(rows, "turnover", "accounting_year", twice)[0].collect()


def test_annualize(spark):
    rows = spark.createDataFrame([("a", 2013, 100.0, "observed"), ("b", 2013, 100.0, "observed"), ("c", 2013, 100.0, "predicted")], "company_id string, y int, t double, s string")
    factors = spark.createDataFrame([("a", 2013, 26.0, 2.0), ("c", 2013, 26.0, 2.0)], "company_id string, year int, weeks double, annualization_factor double")
    out, log = panel.annualize(rows, "t", "y", factors, F.col("s") == "observed")
    assert sorted(values(out, "company_id", "t")) == [("a", 200.0), ("b", 100.0), ("c", 100.0)]
    assert values(log, "company_id", "raw_turnover", "annualized_turnover") == [("a", 100.0, 200.0)]


def test_ratios_ages_sizes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0), (1e308, 1e-10)], "a double, b double")
    assert values(df.select(N.ratio(F.col("a"), F.col("b")).alias("r")), "r") == [(None,), (None,), (None,), (1.5,), (None,)]
    sizes = spark.createDataFrame([(9.0,), (10.0,), (49.0,), (50.0,), (249.0,), (250.0,), (None,)], "e double")
    got = [r[0] for r in sizes.select(N.size_bucket(F.col("e"))).collect()]
    assert got == ["Micro", "Small", "Small", "Medium", "Medium", "Large", None]
    late = spark.sql("select 2015 as y, date'2023-05-01' as d")
    assert late.select(N.recency(F.col("y"), F.col("d"))).first()[0] is None
    codes = spark.createDataFrame([("58110, 58142",), ("x, 1",), ("",), (None,)], "c string")
    assert [r[0] for r in codes.select(N.primary_code(F.col("c"))).collect()] == [58110.0, None, None, None]
    money = spark.createDataFrame([("(no value)",), ("12.5",), ("abc",)], "c string")
    assert [r[0] for r in money.select(N.currency(F.col("c"))).collect()] == [None, 12.5, None]


def test_body_flags(spark):
    names = [("Kent County Council",), ("HM Treasury",), ("North NHS Trust",), ("The Stationery Office Limited",), ("Cern Ltd",), (None,)]
    df = spark.createDataFrame(names, "n string")
    got = [tuple(r) for r in df.select(X.public_body_flag(F.col("n")), X.research_body_flag(F.col("n"))).collect()]
    assert got == [(1, 0), (1, 0), (1, 0), (0, 0), (0, 1), (0, 0)]


def small_panel(spark, rows):
    schema = "company_id string, accounting_year int, turnover double, employees double, total_assets double, export_revenue double, mission string"
    return spark.createDataFrame([(*r, "ACE") if len(r) == 6 else (*r[:3], None, None, None, "ACE") for r in rows], schema)


def test_lags_span_gaps_but_targets_do_not(spark):
    df = features.engineered_panel(small_panel(spark, [("a", 2013, 10.0), ("a", 2016, 20.0)]))
    last = df.filter("accounting_year = 2016").first()
    assert last["turnover_lag_1"] == 10.0
    assert math.isclose(last["log_growth_1y"], math.log1p(20) - math.log1p(10))
    assert last["years_since_previous_turnover"] == 3 and last["consecutive_history_length_to_date"] == 1
    assert features.training_features(small_panel(spark, [("a", 2013, 10.0), ("a", 2016, 20.0)])).count() == 0


def test_rolling_median_and_spread(spark):
    df = features.engineered_panel(small_panel(spark, [("a", 2013, 1.0), ("a", 2014, 9.0), ("a", 2015, 4.0), ("a", 2016, 6.0)]))
    rows = df.orderBy("accounting_year").collect()
    assert [r["rolling_turnover_median_3"] for r in rows] == [1.0, 5.0, 4.0, 6.0]
    assert rows[1]["growth_volatility"] is None and rows[2]["growth_volatility"] is not None
    assert [r["positive_growth_count"] for r in rows] == [None, 1.0, 1.0, 2.0]
    three = spark.createDataFrame([(1.0, 3.0, None)], "a double, b double, c double")
    assert three.select(N.median_of_three(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 2.0


def test_latest_run(spark):
    years = [2013, 2014, 2018, 2019, 2020]
    props = panel.history_properties(small_panel(spark, [("a", y, 1.0) for y in years] + [("b", 2013, 1.0), ("b", 2025, 1.0)]))
    rows = {r["company_id"]: r for r in props.collect()}
    assert rows["a"]["consecutive_history_length"] == 3 and rows["a"]["history_span"] == 7
    assert rows["a"]["years_since_latest_turnover"] == 5 and rows["b"]["consecutive_history_length"] == 1


def test_gazelle_run_breaks_at_gap(spark):
    rows = [("a", 2013, 100.0), ("a", 2014, 112.5), ("a", 2015, 130.0), ("a", 2017, 156.5)]
    runs = reports.gazelle_runs(small_panel(spark, rows)).first()
    assert runs["longest_run_10pct"] == 2 and not runs["gazelle_10pct"]


def test_scaling_needs_unbroken_known_growth(spark):
    rows = [("a", 2013 + i, 1.0, e, None, None) for i, e in enumerate([10.0, 20.0, None, 40.0, 80.0, 160.0])]
    out = reports.operational_scaling(features.engineered_panel(small_panel(spark, rows))).first()
    assert out["n_real_years_employee_growth"] == 3 and not out["employee_growth_10pct"]


def test_gate_and_decay(spark):
    df = spark.sql("select 100D as t, 150D as raw, 2 as step, 0D as anchor, 'growing' as s, 'B' as g")
    decayed = df.select(N.decayed(F.col("t"), F.col("raw"), F.col("step"), F.col("anchor"))).first()[0]
    half = (math.log1p(150) - math.log1p(100)) / 2
    assert math.isclose(decayed, math.expm1(math.log1p(100) + half), rel_tol=1e-12)
    assert df.select(N.gated_growth(F.col("s"), F.col("g"))).first()[0] == "stable"


def test_interval_width(spark):
    df = spark.sql("select 100D as t, 0.5D as s, step from values (1), (4) as v(step)")
    lower, upper = N.interval(F.col("t"), F.col("s"), F.col("step"))
    one, four = df.select(lower.alias("l"), upper.alias("u")).collect()
    width = [math.log1p(r["u"]) - math.log1p(100) for r in (one, four)]
    assert math.isclose(width[1], 2 * width[0], rel_tol=1e-9) and four["l"] >= 0


def test_spread_fallback(spark):
    rows, group = [], []
    for n, (letter, count, scale) in enumerate([("A", 11, 0.2), ("B", 7, 0.6)]):
        company = f"c{n}"
        group.append((company, letter))
        for i in range(count):
            rows.append((company, 2000 + i, math.expm1(5 + scale * (i % 2)), None, None, None))
    engineered = features.growth_core(small_panel(spark, rows))
    spread = forecast.residual_spread(engineered, spark.createDataFrame(group, "company_id string, forecast_evidence_group string"))
    got = {r["forecast_evidence_group"]: r for r in spread.collect()}
    assert got["C"]["sigma_log_residual"] == got["D"]["sigma_log_residual"] == got["B"]["sigma_log_residual"]
    assert got["C"]["used_fallback_spread"] and not got["A"]["used_fallback_spread"]
    assert got["A"]["sigma_log_residual"] < got["B"]["sigma_log_residual"]


def test_winner_prefers_simple_comparable_model(spark):
    columns = "m string, Model string, composite_rank double, R2_mean double, MAE_mean double, RMSE_mean double, MAE_std double, RMSE_std double, R2_std double, robustness_violation boolean, simplicity_rank int"
    rows = [
        ("x", "top", 2.0, 0.60, 1.0, 1.0, 1.0, 1.0, 1.0, False, 5),
        ("x", "simple", 2.8, 0.58, 2.0, 2.0, 2.0, 2.0, 2.0, False, 2),
        ("x", "worse", 2.5, 0.50, 2.0, 2.0, 2.0, 2.0, 2.0, False, 1),
        ("x", "broken", 1.0, 0.90, 0.1, 0.1, 0.1, 0.1, 0.1, True, 0),
    ]
    got = selection.pick_winner(spark.createDataFrame(rows, columns), ["m"]).first()
    assert got["selected_model"] == "simple" and got["top_ranked_model"] == "top" and got["tie_break_used"]
    assert got["runner_up"] == "top" and not got["fallback_used_no_robust_survivor"]


def test_segmentation_reasons(spark):
    df = spark.createDataFrame(
        [("a", "Own", False), ("b", "s1", True), ("c", "none", False), ("d", "s1", False)],
        "company_id string, value_stream string, is_true_duplicate boolean",
    ).withColumn("is_shared_ch_anomaly", F.lit(False))
    mapping = spark.createDataFrame([("s1", "ACE"), ("Own", "ACE")], "value_stream string, mission string")
    out, log = segments.segment_missions(df, mapping, error_value="Own")
    got = {r["company_id"]: (r["mission"], r["training_eligible"], r["exclusion_reason"]) for r in out.collect()}
    assert got["a"] == (None, False, "data_entry_error: Value Stream is company's own name")
    assert got["b"] == ("ACE", False, "duplicate_company_record")
    assert got["c"] == (None, False, "unmapped_value_stream") and got["d"] == ("ACE", True, "")
    assert log.count() == 2


def test_commented_csv_keeps_notes_and_rows(spark, tmp_path):
    from ledgerline.sources.readers import read_commented_csv
    from ledgerline.sources.writers import write_commented_csv

    schema = "name string, weight double"
    rows = [(f"a, \"{i}\"", float(i)) for i in range(50)] + [(None, 1.5), ("plain", None)]
    for parts in (1, 4):
        path = str(tmp_path / f"weights-{parts}")
        write_commented_csv(spark.createDataFrame(rows, schema), path, ["first note\nsecond", "third"], parts)
        for file in spark.read.text(path, wholetext=True).collect():
            assert file["value"].startswith("# first note\n# second\n# third\n\"name\",\"weight\"\n")
        back = read_commented_csv(spark, path, schema).select("name", "weight").collect()
        assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)
    empty = str(tmp_path / "empty")
    write_commented_csv(spark.createDataFrame([], schema), empty, ["nothing"])
    assert read_commented_csv(spark, empty, schema).count() == 0


def test_growth_of_just_ten_or_twenty_percent_meets_its_cut(spark):
    """Equal ratios are equal growth, whatever their terms."""
    from pyspark.sql import Window

    from ledgerline.functions.numeric import log_growth
    from ledgerline.operators.reports import operational_scaling
    from ledgerline.settings import GAZELLE_CUTS

    pairs = [(k * top - 1, k * 10 - 1, tier) for k in range(1, 400) for top, tier in ((11, "10pct"), (12, "20pct"))]
    df = spark.createDataFrame([(float(a), float(b), t) for a, b, t in pairs], "now double, before double, tier string")
    growth = df.withColumn("g", log_growth(F.col("now"), F.col("before")))
    found = {r["tier"]: (r["low"], r["high"]) for r in growth.groupBy("tier").agg(F.min("g").alias("low"), F.max("g").alias("high")).collect()}
    for tier, (low, high) in found.items():
        assert low == high and low >= GAZELLE_CUTS[tier]

    heads = [999.0, 1199.0, 1439.0, 1727.0]  # 1,000 by a fifth a year, three times
    rows = spark.createDataFrame([("c", 2020 + i, h) for i, h in enumerate(heads)], "company_id string, accounting_year int, employees double")
    lag = F.lag("employees").over(Window.partitionBy("company_id").orderBy("accounting_year"))
    rows = rows.withColumn("employee_growth", log_growth(F.col("employees"), lag)).withColumn("asset_growth", F.lit(None).cast("double"))
    assert operational_scaling(rows).first()["employee_growth_20pct"]
    odd = spark.createDataFrame([(1.0, -1.0), (-1.0, 1.0), (-3.0, -2.0), (None, 1.0)], "now double, before double")
    assert [r[0] for r in odd.select(log_growth(F.col("now"), F.col("before"))).collect()] == [None] * 4


def test_weights_of_equal_features_rank_by_name(spark):
    """The last bits of a sum, which change with the partitions, don't decide the order."""
    weights = [("m", "a_count", 0.03932527631927676), ("m", "b_share", 0.03932527631927677), ("m", "c", 2.0e-9), ("m", "d", -2.00001e-9)]
    found = reports.top_features(spark.createDataFrame(weights, "mission string, feature string, weight double"))
    assert [r["engineered_feature"] for r in found.orderBy("place").collect()] == ["a_count", "b_share", "d", "c"]
