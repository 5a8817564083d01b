import pytest

import __spark_entry__ as entry

from ..oracle import connect, differs

SQL = entry.oracle_sql()
OPS = sorted((k for k in entry.queries() if k.startswith("op")), key=lambda k: int(k[2:].split("_")[0]))


def test_all_are_there():
    assert [int(k[2:].split("_")[0]) for k in OPS] == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [k for k in OPS if k in SQL])
def test_agrees_with_sql(spark, sf_dir, name):
    assert differs(spark, connect(sf_dir), entry.queries()[name], SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", [k for k in OPS if k not in SQL])
def test_gives_rows_for_the_whole_table(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    if name not in ("op6_url_filter", "op8_decontamination"):
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert got.count() > 0
