"""Queries over entries of nothing (0.00), which the smallest tables do not hold, against their SQL."""

import os

import duckdb
import pytest

from tallyforge.plans import catalog
from tests.oracle import same


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    kinds = "(['signup', 'click', 'view', 'purchase', 'error'])[(i % 5 + 1)::int]"
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_hours(i::int) as ts, i % 3 as user_id, {kinds} as event_type, case when i % 4 = 0 then i + 0.25 else 0 end::double as value, '' as props from range(200) t(i)) to '{os.path.join(path, 'events.parquet')}'")
    return path


@pytest.mark.parametrize("name", ["balance_correction", "balance_inference", "validate_rows"])
def test_equals_sql(spark, folder, name):
    same(spark, folder, catalog.queries()[name], catalog.oracle_sql()[name])
