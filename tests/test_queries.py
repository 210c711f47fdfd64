"""Every registered query against its check SQL, on the smallest tables."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TICKLOOM_SF_DIR", "/root/testdata/sf0.001")
from tickloom.harness.queries import ORACLES as OWN_CHECKS  # noqa: E402
from tickloom.harness.queries import QUERIES as OWN  # noqa: E402

# The training-data operators have tests of their own.
QUERIES = {name: fn for name, fn in entry.queries().items() if name in OWN}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN_CHECKS}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 110


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ts", "a", "c5m", "rank"] and df.count() > 0


def shown(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture
def generated_code(spark):
    """What a cluster runs; the other tests leave compiling out."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["build_ticks", "parse_frames", "fanout_join_hot", "partition_lag", "sys_stats"])
def test_query_with_generated_code(spark, duck, generated_code, name):
    test_query(spark, duck, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([shown(r[c]) for c in columns] for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted([shown(r[i]) for i in order] for r in result.fetchall())
    assert got == want
