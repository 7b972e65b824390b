"""Queries over groups where documents have no text, no word, or marks alone, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from scriptorium.plans import registry
from tests.conftest import oracle, rows

# doc_id 8 and its like are reported by four annotators, others by one
_BLANK = r"CASE WHEN doc_id IN (8, 17) THEN NULL WHEN doc_id IN (24, 33) THEN '' WHEN doc_id IN (40, 50) THEN E' \t\n\x0b\x0c\r' WHEN doc_id IN (56, 67) THEN '--- !!!' ELSE text END"


@pytest.fixture(scope="module")
def blank_dir(sf_dir, tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("blank")
    duckdb.execute(f"COPY (SELECT * REPLACE ({_BLANK} AS text) FROM '{sf_dir}/documents.parquet') TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize(
    "name",
    [
        "consensus_conservative",
        "consensus_liberal",
        "consensus_longest",
        "consensus_moderate",
        "consensus_summary",
        "dataset_figures",
        "dataset_records",
        "further_annotations",
        "group_overview",
        "record_figures",
        "type_distribution",
    ],
)
def test_blank_documents(spark, blank_dir, name):
    got = rows(registry.queries()[name](spark, blank_dir))
    assert got
    assert got == oracle(blank_dir, registry.oracle_sql()[name])
