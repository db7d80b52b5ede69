"""Every query with SQL against DuckDB on the smallest tables; those on texts and paths on larger ones, too."""

import glob
import os

import duckdb
import pytest

from docloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


#: Queries whose inputs differ by row in texts and paths: small tables don't show every case.
LARGER = "ignored_paths blob_urls page_urls path_segments safe_names derived_titles dates_in_text search_with_mirrors escaped_urls png_images attribute_maps cleaned_bodies filled_images source_blocks highlighted_lines joined_lists tree_rows bm25_pairs".split()


@pytest.fixture(scope="module")
def oracle():
    made = {}
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        made[folder] = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            made[folder].execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def compare(spark, oracle, name, folder):
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = oracle[folder].sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    compare(spark, oracle, name, FOLDER)


@pytest.mark.parametrize("name", sorted(set(LARGER) & set(SQL)))
def test_query_equals_sql_on_more_rows(spark, oracle, name):
    compare(spark, oracle, name, "/root/testdata/sf0.01")


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
