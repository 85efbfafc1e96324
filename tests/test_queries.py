"""Every core query against DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import marquetry.plans.code_queries  # noqa: F401  registers its queries
import marquetry.plans.more_queries  # noqa: F401  registers its queries
from marquetry.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return f"{float(v):.6f}" if type(v).__name__ == "Decimal" and v != int(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) == want
