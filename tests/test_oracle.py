"""Every query of table access against its DuckDB SQL, as sorted values."""

from pathlib import Path

import pandas as pd
import pytest

from rowcraft.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def database():
    made = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def plain(value):
    """A value as both engines' drivers can be compared by it."""
    value = value.item() if hasattr(value, "item") else value
    if value is None or pd.isna(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 6)
    return str(value).removesuffix(" 00:00:00") if not isinstance(value, (bool, str)) else value


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, database, name):
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    expected = database.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
