"""The driver contract on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry_module

QUICK = (
    "a5_basic_clean", "a13_reddit_ingest", "b9_hash_dedupe", "b11_near_pairs", "c5_daily_mean",
    "e21_feature_build", "e6_running_ticks", "h16_summary_table", "i9_symbol_lookup",
    "d3_exact_search", "j3_streaming_daily",
)


def test_every_query_but_the_fits_has_sql():
    own = set(entry_module.queries()) - set(entry_module.LLM_QUERIES)
    without = own - set(entry_module.oracle_sql())
    assert without == {"g1_fit_models", "g2_select_model", "g4_batch_prediction", "g6_save_and_load"}
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_names_are_plain():
    for name in set(entry_module.queries()) - set(entry_module.LLM_QUERIES):
        assert re.fullmatch(r"[a-j]\d+_[a-z0-9_]+", name), name


def test_entry(spark):
    assert entry_module.entry(spark).count() == 25


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    from tools.check_oracle import compare, duck

    sf_dir = entry_module.SMOKE_DIR
    note, good = compare(
        spark, duck(sf_dir), sf_dir, name, entry_module.queries()[name],
        entry_module.oracle_sql()[name],
    )
    assert good or note.startswith("ok"), note


def test_task_functions_travel_by_value():
    from pyspark import cloudpickle

    from marketloom.operators import dedupe

    assert b"marketloom.operators.dedupe" not in cloudpickle.dumps(dedupe._advance)[:60]
    assert "marketloom" in cloudpickle.list_registry_pickle_by_value()
