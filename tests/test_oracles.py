"""Every registered query with SQL gives the SQL's rows on the smallest scale."""

import pytest
from compare import rows_of, run_sql

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    frame = entry.queries()[name](spark, folder)
    columns, rows = run_sql(folder, ORACLES[name])
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, rows)


def test_entry_runs(spark):
    assert set(entry.entry(spark).columns) == {"advantage", "win_rate", "battles"}


def test_every_oracle_has_a_query():
    from contest_panel.plans.oracles import ORACLES as written

    assert set(written) <= set(entry.queries())
