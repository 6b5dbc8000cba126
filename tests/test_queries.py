import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import conversion, layouts, printed, reports, statements

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted({**statements.ORACLE, **layouts.ORACLE, **printed.ORACLE, **reports.ORACLE, **conversion.ORACLE}))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_rate_limit_by_brute_force(spark):
    got = {r.event_id: r.allowed for r in statements.rate_limit(spark, SF).collect()}
    state, want = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id").collect():
        opened, n = state.get(r.user_id, (None, 0))
        if opened is None or (r.ts - opened).total_seconds() >= 86400:
            opened, n = r.ts, 0
        state[r.user_id] = (opened, n + 1)
        want[r.event_id] = n + 1 <= 2
    assert got == want
