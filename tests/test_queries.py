"""Registered queries beside their SQL answers."""

import os

import pytest

import oracle
from lapsegrid import workload

SPREAD = [
    "entity_rollup", "window_changes", "presence_roll_call", "threshold_episodes", "state_bouts", "exposure_bouts", "track_summary",
    "cohort_filter_keep_unknown_exclude", "nearest_unique_match", "joint_intervals", "regime_transitions", "event_aligned_curve",
    "mask_turnover", "contact_summary", "nearest_edge", "pair_correlations", "robust_trend", "corrected_families", "permutation_test",
    "rhythm_screen", "lifecycle_rows", "robust_scaled_features", "declared_contrasts", "stream_presence_sessions",
]
NAMES = sorted(workload.callables()) if os.environ.get("LAPSEGRID_ALL") else SPREAD


@pytest.fixture(scope="module")
def duck():
    return oracle.make_duck(f"{oracle.DATA}/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ok, message, rows = oracle.compare(spark, duck, f"{oracle.DATA}/sf0.001", name)
    assert ok, message


def test_every_answer_belongs_to_a_query():
    assert set(workload.sql_texts()) <= set(workload.callables())


@pytest.mark.parametrize("name", ["entity_rollup", "threshold_episodes", "nearest_unique_match", "steps", "regime_classes", "percentile_positions", "corrected_families", "mann_whitney"])
def test_two_level_plans_on_whole_queries(spark, duck, name):
    """Every key counts as heavy: the same rows must come out."""
    from lapsegrid.plans.heavy import LIMIT_SETTING

    spark.conf.set(LIMIT_SETTING, "3")
    try:
        ok, message, _ = oracle.compare(spark, duck, f"{oracle.DATA}/sf0.001", name)
    finally:
        spark.conf.unset(LIMIT_SETTING)
    assert ok, message


@pytest.fixture
def odd_events(tmp_path):
    """A folder whose events are one entity's, with the values given."""
    import duckdb

    def make(values):
        rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL ({6 * k}) HOUR, 1, 'view', {v}::DOUBLE, '')" for k, v in enumerate(values))
        duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def test_log_histogram_leaves_out_what_has_no_logarithm(spark, odd_events):
    folder = odd_events([0, 0, 0, 0, 1, 1, 1, 1, 8, 8, 8, 8])
    ok, message, rows = oracle.compare(spark, oracle.make_duck(folder), folder, "log_histogram")
    assert ok and rows == 10, message


def test_a_mean_of_exactly_fifty_is_fifty_in_any_order(spark, odd_events):
    # summed as doubles, they give less than 150 in every order
    values = [0.48, 21.38, 128.14]
    folder = odd_events(values)
    row = workload.callables()["cohort_filter_keep_unknown_keep"](spark, folder).first()
    assert row["signal_mean"] == 50.0 and row["rule_4"]
    ok, message, _ = oracle.compare(spark, oracle.make_duck(folder), folder, "cohort_filter_keep_unknown_keep")
    assert ok, message
