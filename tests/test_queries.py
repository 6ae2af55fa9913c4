"""A cross-section of registered queries against DuckDB at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, connect

NAMES = [
    "cell_top2_barcodes", "reads_median_corrected", "histogram_cumulative_fraction", "interpolate", "adjust_bh", "delta_auc",
    "wasserstein_to_control", "barcode_clusters", "nearest_distance", "max_filter", "region_features", "guide_gene_rollup", "parse_oligos",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    folder = f"{DATA}/sf0.001"
    assert compare(spark, connect(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name]) == ""
