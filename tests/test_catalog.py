"""The registered queries agree with their SQL on the smallest test data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.check import TABLES, compare

SF = "/root/testdata/sf0.001"
CHECKED = [
    "session_features", "p6_column_roles", "d4_downsample_8", "j4_join_many_to_one", "g1_split_by_user_exact",
    "g4_stratified_validation", "f2_train_median_fill", "f10_mutual_information", "f16_padded_sequences",
    "j10_nearest_neighbours", "s13_b4_parse_answers", "b1_s7_prompts_long", "b3_b5_b6_scored_sessions",
    "e7_class_report", "e10_evaluate_all_models", "io13_io14_response_log",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    text, _, good = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good is True, text
