"""Registered queries against DuckDB on the smallest data; `python -m tests.oracle` runs all of them."""

import os

import pytest

import __spark_entry__ as entry

from .oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "experiment_evaluation", "hash_bucket_compression", "metric_registry_totals", "ratio_t_test_per_user", "welch_t_test", "chi_square_two_by_two",
    "mann_whitney_rank_test", "bootstrap_cluster_ratio", "simulated_false_positive_rate", "aa_study_half_samples", "discount_experiment_evaluation",
    "breakdown_binomial_tests", "validity_range_join", "nth_event_aligned_join", "schedule_interval_join", "any_left_join_first_match",
    "row_number_per_user", "previous_and_next_state", "ladder_forward_fill", "supply_seconds_from_state_log", "price_view_funnel_slots",
    "points_to_hex_cells", "point_in_polygon_join", "daily_campaign_alerts", "classification_quality", "ladder_training_grid", "streamed_view_funnel",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
