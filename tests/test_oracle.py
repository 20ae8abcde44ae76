"""Registered SQL queries agree with their DuckDB oracle on the smallest scale factor."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["id_list_parse", "batch_plan", "labelled_articles", "coverage", "assign_folds",
        "stratified_split", "tfidf", "term_rank_sum", "term_weights", "auc_by_fold",
        "roc_curve", "spec_at_sens", "ranked_list", "unnest_metrics", "model_select",
        "xml_articles", "csv_articles"]


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, key):
    import oracle_check as oc
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF)
    scols = df.columns
    srows = [tuple(r) for r in df.collect()]
    dcols, drows = oc.duck(SF, E.oracle_sql()[key])
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert oc.value_hash(srows, scols) == oc.value_hash(drows, dcols)
