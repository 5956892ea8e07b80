import duckdb
import pytest

import __spark_entry__
from tests.oracle import TABLES, same
from turnweave.plans import catalog

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(spark, catalog.queries()[name], catalog.oracle_sql()[name], D)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 87
    assert catalog.queries().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_wav_decode_holds_samples_beyond_sixteen_bits(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 997 = 0 THEN 900.125 ELSE value END AS value) FROM '{D}/events.parquet') TO '{tmp_path}/events.parquet'")
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{D}/{t}.parquet")
    same(spark, catalog.queries()["wav_decode"], catalog.oracle_sql()["wav_decode"], str(tmp_path))
