"""Registered queries next to their SQL oracle on the small data set.

A sample runs by default; ALL_QUERIES=1 runs every query. ``python tests/oracle.py``
does the same on a larger set and prints one line per query.
"""

import os

import pytest

import oracle
from tierloom import plans  # noqa: F401
from tierloom.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["a05_annotation_documents", "a17_dictionary_entries", "b04_merge_short", "b17_merge_with_next", "c08_detect_segments",
          "c16_four_streams", "c22_speed_resample", "d07_resolve_gloss_input", "d15_source_of_stem", "e05_batch_eligibility",
          "f07_merge_suggestions", "f14_longest_suffix", "f24_cut_interval", "g11_per_class_metrics", "g15_retrain_trigger",
          "h02_neighbourhood", "i06_unified_variants", "j08_batch_inference", "k04_bulk_import", "l02_incremental_signs"]
NAMES = list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    state, detail = oracle.compare(spark, con, name, SF_DIR)
    assert state in ("ok", "rows"), detail


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("op") or n == "pipeline"]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["clip", "frame_start", "frame_end", "start_ms", "end_ms", "score"]
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().items() >= ORACLES.items()
