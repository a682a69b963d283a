"""Every registered query on the smallest tables, against its SQL."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "event_time"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, name):
    ok, text = compare(spark, SMALL, name)
    assert ok, text
