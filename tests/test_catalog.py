"""Every named query against its SQL in DuckDB: over the smallest dataset, and over a larger one dealt to other partitions."""

import importlib
import pkgutil

import duckdb
import pytest

import gridloom.plans
from gridloom.plans.catalog import CATALOG

for _plan in pkgutil.iter_modules(gridloom.plans.__path__):
    importlib.import_module(f"gridloom.plans.{_plan.name}")

#: Datasets, and shuffle partitions that Spark doesn't merge again.
SETUPS = {"sf0.001": None, "sf0.01": "13"}
#: Queries whose many jobs are run over the smallest dataset alone; their operators have tests of their own.
LONG = {"penalised_rates", "heat_modes", "heat_polar", "heat_track", "heat_hexagons", "diffused_rates", "diffusion_transitions", "viewshed_all"}


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for name in SETUPS:
        found[name] = con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '/root/testdata/{name}/events.parquet'")
    return found


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("setup", SETUPS)
@pytest.mark.parametrize("name", CATALOG)
def test_query_against_sql(spark, ducks, name, setup):
    if SETUPS[setup]:
        if name in LONG:
            pytest.skip("many jobs")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", SETUPS[setup])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = CATALOG[name].query(spark, f"/root/testdata/{setup}")
        values = found.collect()
    finally:
        if SETUPS[setup]:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert values
    if CATALOG[name].sql:
        expected = ducks[setup].execute(CATALOG[name].sql)
        columns = [c[0] for c in expected.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows(found.columns, values) == rows(columns, expected.fetchall())
