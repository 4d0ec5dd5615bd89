"""Registered queries against their DuckDB form, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = {k: v for k, v in __spark_entry__.oracle_sql().items() if not k.startswith(("op", "pipeline"))}
#: A spread of shapes; the driver compares all of them.
PICKED = ["a9_last_restart", "b25_p_and_z", "c5_samples_in_intervals", "c9_saccades_outside_blinks", "c20_laplacian", "d1_subject_quality", "d2_d_prime", "d4_stats_by_combination", "d10_gaze_density", "d37_conjunctions", "e1_baseline_zscore", "e10_extended_blinks", "f1_decoding_roi", "g5_overlapping_regions", "u3_signed_rank", "u17_false_discovery", "u23_centroid_accuracy", "u24_train_test_generalisation", "u25_combined_features", "u30_permuted_decoding", "u32_group_cluster_test", "u35_theory_correlation"]


@pytest.fixture(scope="module")
def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df) -> list[tuple]:
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or x is getattr(np, "nan", None) or str(x) in ("<NA>", "NaT"):
            return ("", 0.0)
        return (str(bool(x)), 0.0) if isinstance(x, (bool, np.bool_)) else ("n", round(float(x), 4)) if isinstance(x, (int, float, np.number)) else (str(x), 0.0)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = __spark_entry__.queries()[name](spark, sf_dir).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names():
    assert set(ORACLE) <= set(__spark_entry__.queries())
