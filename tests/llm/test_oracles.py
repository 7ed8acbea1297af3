import pytest

from mosaiq.llm import catalog
from tests.rows import check


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    check(catalog.QUERIES[name](spark, data), duck, catalog.ORACLES[name])


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in catalog.QUERIES}


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in ("op7_warc_archives", "op10_benchmark_decontamination", "op13_chat_formatting")])
def test_odd_rows_equal_sql(spark, odd, none, tmp_path, name):
    import duckdb

    for df, d in ((odd, "odd"), (none, "none")):
        df.select("doc_id", "text", "lang", "source", "n_chars", "fp", "key", "kept").coalesce(1).write.parquet(f"{tmp_path}/{d}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{d}/documents.parquet/*.parquet'")
        check(catalog.QUERIES[name](spark, f"{tmp_path}/{d}"), con, catalog.ORACLES[name])
