import math

import duckdb
import pytest

from tessella.plans import builds, catalogue  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, db, name):
    got = catalogue.queries()[name](spark, DIR)
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(found.fetchall(), columns)


def test_stuck_by_plain_loop(spark):
    v = catalogue.Views(spark, DIR)
    ticks, want = {}, []
    for r in v.telemetry().orderBy("user_id", "event_id").collect():
        ticks.setdefault(r["user_id"], []).append(r)
    for user, own in ticks.items():
        n, seen = 0, set()
        for r in own:
            if r["pushing"]:
                n += 1
                seen.add(int(r["ang"] // 45))
            elif n < 0:
                n += 1
            else:
                n, seen = 0, set()
            if n >= 4 and len(seen) >= 3:
                want.append((user, r["event_id"], len(seen)))
                n, seen = -6, set()
    got = sorted(map(tuple, catalogue.queries()["stuck_reports"](spark, DIR).collect()))
    assert got == sorted(want) and got


def test_every_query_has_a_result_schema(spark):
    for name, q in catalogue.queries().items():
        assert q(spark, DIR).columns, name


def test_grid_of_degrees(spark):
    from tessella.functions import grid

    # A published worked point (Caister water tower), within the few metres that the series allows.
    frame = spark.createDataFrame([(1 + 42 / 60 + 57.8663 / 3600, 52 + 39 / 60 + 28.8282 / 3600)], "lon double, lat double")
    r = grid.with_osgb(frame).first()
    assert math.hypot(r["easting"] - 651409.903, r["northing"] - 313177.270) < 5
