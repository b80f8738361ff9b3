"""Every query that has SQL gives DuckDB's rows; the rest of the library stands without the corpus operators."""

import pytest

from patternmill import catalog
from tests.parity import same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf_dir, duck, name):
    same(catalog.queries()[name](spark, sf_dir), duck, catalog.oracle_sql()[name])


def test_concepts_join_two_sources(spark, sf_dir):
    rows = catalog.queries()["concepts_of_items"](spark, sf_dir).collect()
    assert len(rows) == 12 and any(r.msg_df != r.card_df for r in rows)
    assert all(r.score == r.msg_df * r.card_df for r in rows)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["tok", "grp", "k", "df", "bits", "certified"]


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
