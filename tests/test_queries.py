import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_twin(spark, con, name):
    built = []

    def once(spark, sf_dir):
        built.append(entry.queries()[name](spark, sf_dir))
        return built[0]

    problems, n, _ = compare(spark, con, SF, once, entry.oracle_sql()[name])
    assert not problems and n > 0
    plan = built[0]._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "Pandas" not in plan


WITHOUT_TWIN = sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", WITHOUT_TWIN)
def test_query_without_a_twin_runs(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows and rows[0].asDict()


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["train_number", "station", "delay_min", "rolling_72hr_avg_delay", "is_maintenance_likely"]
    assert df.count() > 0


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["route_stats"](spark, SF)._jdf.queryExecution().toString()
    for unused in ("c_name", "s_name", "p_name", "p_retailprice", "o_totalprice", "l_shipdate", "c_acctbal"):
        assert f"{unused}:" not in plan
    weather = entry.queries()["daily_average"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in weather
