import os

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, canonical
from geoloom.functions import measures
from geoloom.plans import views
from geoloom.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got, want = canonical(QUERIES[name](spark, SF).toPandas()), canonical(con.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert (got[c].astype(str).values == want[c].astype(str).values).all(), c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_purify_lines_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {r["fid"]: r["vertices"] for r in QUERIES["purify_lines"](spark, d).collect()}
    rows = views.points(spark, d).select("fid", "lng", "lat").collect()
    # the lines are parallel: one gains vertices only where another begins or ends along it
    at = {r[0]: tuple(round(x * 1000) for x in r[1:]) for r in rows}
    assert got.keys() == at.keys() and len(got) == len(rows)
    beside = lambda p, q: (q[0] - p[0]) * 3 == (q[1] - p[1]) * 4 and abs(q[0] - p[0]) <= 400
    alone = [i for i, p in at.items() if not any(j != i and beside(p, q) for j, q in at.items())]
    assert len(alone) > 900 and all(got[i] == 2 for i in alone)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_antimeridian_polygons_of_all_cells(spark):
    got = {r["fid"]: r for r in QUERIES["antimeridian_polygons"](spark, SF).collect()}
    whole = {r[0]: r[1] for r in views.cells(spark, SF).select("fid", measures.area(F.col("geom"))).collect()}
    assert got.keys() == whole.keys() and len(got) == 25
    for k, r in got.items():  # every fifth cell reaches across; the others pass through whole
        assert r["type"] == ("MultiPolygon" if k % 5 == 4 else "Polygon") and r["area"] > 0
        assert k % 5 == 4 or r["area"] == pytest.approx(whole[k], rel=1e-9)
