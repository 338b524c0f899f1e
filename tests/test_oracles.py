"""Every query that has SQL gives the same rows on the smallest tables; the others run and keep a schema."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

CORE = {n: s for n, s in entry.oracle_sql().items()}
OWN = [n for n in entry.queries() if n not in CORE and n[:2] not in ("p7", "p8", "p9")]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_as_sql(spark, con, sf, name):
    assert differences(spark, con, name, entry.queries()[name], CORE[name], sf) == ""


@pytest.mark.parametrize("name", sorted(OWN))
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.columns and df.limit(5).collect() is not None


def test_every_query_has_a_stable_schema(spark, sf):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.schema == entry.entry(spark).schema


def test_llm_is_not_imported_by_the_rest():
    root = Path(entry.__file__).parent / "slabworks"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "slabworks.llm" not in p.read_text(), p
