import duckdb
import pytest

from siltworks.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return out


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("key", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, key):
    found = db.execute(catalog.ORACLES[key])
    names = [c[0] for c in found.description]
    got = catalog.QUERIES[key](spark, AT)
    assert sorted(got.columns) == sorted(names)
    assert plain(got.select(*(f"`{n}`" for n in names)).collect()) == plain(found.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"ad_hoc_search", "recent_high_severity"}


def test_results_have_rows(db):
    empty = {k for k in catalog.ORACLES if not db.execute(catalog.ORACLES[k]).fetchone()}
    assert empty <= MAY_BE_EMPTY
