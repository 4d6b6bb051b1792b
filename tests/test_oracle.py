"""Every query that SQL can express gives the same rows as its SQL; the others run."""

import json

import pytest

from compare import connection, differences
from tidemark.catalogue import QUERIES
from tidemark.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_run_record_holds_what_the_sql_of_the_thresholds_gives(spark, con):
    found = con.sql(ORACLE_SQL["thresholds"])
    wanted = {row["series_id"]: row for row in (dict(zip(found.columns, r)) for r in found.fetchall())}
    got = {r.series_id: json.loads(r.json) for r in QUERIES["run_record_json"](spark, SF).collect()}
    assert got.keys() == wanted.keys()
    for series, record in got.items():
        assert list(record) == ["schema_version", "series_id", "noise", "detector"]
        assert record["series_id"] == series
        for name, value in (record["noise"] | record["detector"]).items():
            assert value == pytest.approx(wanted[series][name], abs=1e-6), name
        assert {*record["noise"], *record["detector"]} == {k for k, v in wanted[series].items() if v is not None} - {"series_id"}


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
