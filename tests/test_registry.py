"""Every registered query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

from intake.plans.registry import ORACLES, QUERIES

SF = os.environ.get("INTAKE_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(got.columns)
    assert plain(got.select(*names).collect()) == plain(want)
    assert want
