"""Every registered query of the bridge library against DuckDB on the same tables."""

import math

import duckdb
import pytest

from tricklake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect())
    assert got
    if name in plans.ORACLES:
        r = con.sql(plans.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert all(a == b or (a[:1].isdigit() or a[:1] == "-") and b not in ("None", "True", "False") and math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=1e-6) for a, b in zip(g, w)), (g, w)
