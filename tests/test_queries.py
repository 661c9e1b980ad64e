import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import same
from conftest import DATA

from latticeflow.plans.registry import ORACLE_SQL, QUERIES

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    out = QUERIES[name](spark, str(SF)).toPandas()
    assert len(out)
    if name in ORACLE_SQL:
        same(out, db.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["fit_grid_udf", "bar_lattice"])
def test_equal_energies(spark, tmp_path, name):
    """Long tracks of runs of equal values, whose energies tie with the median."""
    users = [15, 627, 867, 969, 1197]
    values = np.concatenate([np.repeat(np.round(np.random.default_rng(u).gamma(1.0, 50.0, 66), 2), 30) for u in users])
    ts = np.datetime64("2024-01-01", "us") + np.arange(len(values)) * np.timedelta64(1, "s")
    pd.DataFrame({"event_id": np.arange(len(values)), "ts": ts, "user_id": np.repeat(users, 66 * 30), "event_type": "a", "value": values, "props": "{}"}).to_parquet(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(ORACLE_SQL[name]).df())
