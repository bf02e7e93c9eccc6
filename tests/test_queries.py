"""Every query with SQL gives what DuckDB gives on the same files; the others give rows."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lamella import image_queries, pair_queries  # noqa: F401  register their queries
from lamella import queries as Q

SF = "/root/testdata/sf0.001"
SLOW = {"gmm_diag", "forest_cross_validation"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool):
            return str(x)
        try:
            return f"{float(x) + 0.0:.6g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(value(x) for x in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES) - SLOW))
def test_query_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_learning_queries_run_at_the_reference_parameters(spark, monkeypatch):
    class Seen(Exception):
        pass

    def see(*args, **kw):
        raise Seen(*args, kw)

    monkeypatch.setattr(Q.learning.DiagonalMixture, "fit", see)
    with pytest.raises(Seen) as e:
        Q.QUERIES["gmm_diag"](spark, SF)
    mixture = e.value.args[0]
    assert (mixture.kind, mixture.starts, mixture.iterations, mixture.floor) == ("diag", 3, 500, 1e-5)
    monkeypatch.setattr(Q.learning, "forest", see)
    with pytest.raises(Seen) as e:
        Q.QUERIES["forest_cross_validation"](spark, SF)
    assert e.value.args[-1] == {}  # the defaults: 300 trees, depth 16, leaf 5
    assert Q.learning.cross_validate.__defaults__ == (5,)
