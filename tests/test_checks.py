"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_agrees_with_sql(spark, name):
    verdict = compare(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry_returns_a_page(spark):
    page = entry.entry(spark)
    assert page.columns[:3] == ["group_key", "hash_algorithm", "content_hash_hex"]
    assert page.count() > 0


def test_every_operator_of_the_inventory_has_a_query():
    ids = {name.split("_")[0] for name in entry.QUERIES}
    expected = {f"s{i}" for i in range(1, 7)} | {f"p{i}" for i in range(1, 11)}
    expected |= {f"f{i}" for i in range(1, 25)} - {"f14", "f20"}
    expected |= {f"j{i}" for i in range(1, 13)} | {f"a{i}" for i in range(1, 13)}
    expected |= {f"w{i}" for i in range(1, 9)} | {f"t{i}" for i in range(1, 8)}
    expected |= {"d1", "m1", "m2", "m3"} | {f"u{i}" for i in range(1, 5)}
    expected |= {f"x{i}" for i in range(1, 5)}
    assert expected == ids
