"""Registered queries against their SQL, and the contract of their columns."""

from __future__ import annotations

import pytest

from checks.compare import compare
from samebytes.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id n_shingles component_id kept",
    "op5": "doc_id held_out lang_pred score",
    "op6": "page_id host path rule verdict",
    "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "vec_id n_links component_id kept",
    "op11": "doc_id keep_id group_size kept text_sha256",
    "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    verdict = compare(spark, FOLDER, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


#: Table that a query returns a row for each row of.
WHOLE = {"op1": "documents", "op2": "documents", "op3": "documents", "op5": "documents", "op6": "pages", "op7": "documents",
         "op9": "embeddings", "op10": "documents", "op11": "documents", "op12": "documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agreed_columns_and_whole_tables(spark, name):
    result = QUERIES[name](spark, FOLDER)
    operator = name.split("_")[0]
    wanted = COLUMNS.get(operator, "").split()
    assert result.columns[: len(wanted)] == wanted
    rows = result.collect()
    if operator in WHOLE:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{WHOLE[operator]}.parquet").count()
    if "score" in wanted and operator != "op13":
        assert all(0 <= r.score <= 1 for r in rows)
