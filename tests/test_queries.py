"""Every query of the catalogue against its SQL, and those without SQL for rows; the entry query for its schema."""

import pytest

import __spark_entry__
import compare
from glyphlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    got, want, same = compare.same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLES[name], sf_dir)
    assert same, (name, got, want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["book_id", "chunk_no", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
