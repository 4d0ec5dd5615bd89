"""Queries and their SQL on small tables where nulls or rounding decide."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__


def both(spark, folder, name: str, lines: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """What the query and its SQL return on a table of line items."""
    lines.to_parquet(folder / "lineitem.parquet", index=False)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    got, want = __spark_entry__.queries()[name](spark, str(folder)).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()[list(__spark_entry__.queries()[name](spark, str(folder)).columns)]
    plain = lambda df: sorted([tuple(None if pd.isna(v) else round(float(v), 4) for v in r) for r in df.itertuples(index=False)], key=str)
    return plain(got), plain(want)


def line_items(cells: list[tuple[int, int, int, float]]) -> pd.DataFrame:
    """A line item for each (channel, epoch, t, price), t of 1 to 7."""
    return pd.DataFrame([(e, 0, c, t, v) for c, e, t, v in cells], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])


def test_spearman_of_times_with_both_means(spark, tmp_path):
    """Time 3 has no even epoch, so no y; times 4 and 5 are tied but for rounding. Channels without any y, or with one pair or one rank, have no rho."""
    cells = [(0, e, t, 1000.0 * v) for t, v in ((1, 3.0), (2, 1.0), (6, 9.0)) for e in (0, 1)] + [(0, 1, 3, 5000.0)]
    cells += [(0, 0, 4, 2100.0), (0, 1, 4, 2100.0), (0, 2, 4, 2400.0), (0, 0, 5, 2200.0), (0, 1, 5, 2200.0), (0, 2, 5, 2200.0)]
    cells += [(1, 1, 1, 1000.0), (1, 3, 2, 4000.0), (2, 0, 1, 1000.0), (2, 1, 2, 1000.0), (3, 0, 1, 1000.0), (3, 0, 2, 1000.0), (3, 1, 2, 3000.0)]
    got, want = both(spark, tmp_path, "u15_spearman", line_items(cells))
    assert got == want
    # x is 3, 1, 2.2, 2.2, 9 and y 3, 1, 2.25, 2.2, 9 at times 1, 2, 4, 5, 6
    assert dict(got) == {0.0: pytest.approx(0.9747, abs=1e-4), 1.0: None, 2.0: None, 3.0: None}


def test_z_against_repeats_that_differ_by_rounding(spark, tmp_path):
    """Distances 0.3 - 0.1 and 0.5 - 0.3 differ in the last bit only: there is no spread, and so no z."""
    cells = [(0, 0, 1, 100.0), (0, 0, 2, 900.0), (1, 0, 1, 100.0), (1, 0, 2, 300.0), (2, 0, 1, 300.0), (2, 0, 2, 500.0)]
    got, want = both(spark, tmp_path, "d55_z_against_repeats", line_items(cells))
    assert got == want and len(got) == 4 and all(r[2] is None for r in got)
