"""Registered queries against DuckDB on the smallest tables; one from each family, streams and loads included."""

import math

import duckdb
import pytest

from quarryflow import queries

D = "/root/testdata/sf0.001"
NAMES = """priority_flags read_csv_typed write_partitioned filter_compound value_map join_full_outer join_interval_overlap join_asof_scd2 join_salted join_indicator fanout_check
agg_rollup agg_median agg_describe agg_group_filter leave_one_out_avg hierarchy_down win_rank_trio win_topn_per_group win_rank_pct_pandas win_range_days win_conditional_reset win_gap_islands
pivot_wide melt_long cast_safe ffill_bfill date_parse_multi tz_convert bin_quantile hash_key udf_pandas scd2_apply surrogate_key vault_current_view fact_periodic_snapshot mart_incremental_refresh
null_profile outlier_iqr validate_split assert_rules constraint_check watermark_incremental merge_upsert cdc_diff cdc_apply time_travel backfill_partition silver_events gold_entity_risk run_medallion
score_composite mrr_by_plan plan_changes time_intel read_jdbc_partitioned write_jdbc_batch write_coalesced sample_rows null_drop_fill_flag partition_profile udf_native_parity scd4_split analytical_dataset score_weighted_gold
win_running_hot_key win_lag_lead_hot_key win_reset_hot_key win_rank_hot_key ffill_bfill_hot_key win_gap_islands_hours win_ntile win_pct_rank join_salted_hot_keys hierarchy_up merge_buckets scd2_buckets history_log distinct_rollup backfill_rerun resample_period train_classifier
resolution_time stream_scorecard late_data_policy stream_tumbling_agg stream_upsert_sink""".split()


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["late_data_policy", "stream_tumbling_agg"])
def test_streams_over_slices_of_several_files(spark, duck, name, monkeypatch):
    monkeypatch.setattr("quarryflow.queries.products.FILE_ROWS", 60)
    test_query_equals_sql(spark, duck, name)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, D)
    columns = sorted(got.columns)
    cursor = duck.execute(queries.oracle_sql()[name])
    wanted = [x[0] for x in cursor.description]
    assert columns == sorted(wanted)
    rows = sorted(tuple(plain(r[wanted.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_every_query_is_registered_once():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert len(queries.queries()) > 180
