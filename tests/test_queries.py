"""Some registered queries against their DuckDB SQL, on the smallest tables; the driver compares all of them."""

import os

import duckdb
import pandas as pd
import pytest

from tidebook.plans import oracles, queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["level3_chain", "depth_changes", "depth_multi_era", "book_flags", "spread", "depth_summary_pivot", "queues_absolute", "trading_period_volume", "events_classified", "match_exact_fill", "crossed_books", "missing_fill_backprop", "lead_lag_corr", "chain_id", "match_sum_of_fill", "trades"]

NEWER = [
    "trading_strategy", "epsilon_drawupdowns", "top_spikes", "position_trellis", "depth_difference", "takers_checked", "starting_spread", "spread_by_episode", "books_by_episode", "maker_depth", "depth_summary_range",
    "spread_range", "depth_range_multi_era", "match_sequential", "match_rules", "coupling_candidates", "times_in_order", "revealed_episodes", "synthetic_creations", "deleted_events", "reconnected_chains", "queues_log", "raw_book_eras",
    "book_arrays", "tick_levels", "price_segments", "order_flow_without_trades", "renumbered_chains", "time_jumps", "event_times", "session_eras",
]


def value(v):
    if v is None or v is pd.NA or v != v:
        return "-"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ in ("numpy", "decimal") and not str(type(v)).count("bool") else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", [*NAMES, *NEWER])
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    c = duckdb.connect()
    for t in ("events", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    expected = c.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and len(got)
    rows = lambda df: sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(expected)


def test_every_oracle_has_its_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) == set(oracles.ORACLES)
