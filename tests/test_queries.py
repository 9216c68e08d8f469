import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_every_archive_query_has_its_columns_in_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in "customer documents events lineitem orders pages part conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    from solidframe.plans import queries as q

    for name in ("safe_path_urls", "substream_offsets", "solid_by_count", "volume_ranges", "edges", "filetime_roundtrip", "varints", "bytes_by_language"):
        got = entry.queries()[name](spark, sf_dir)
        want = con.execute(q.ORACLES[name]).fetchall()
        columns = [d[0] for d in con.description]
        plain = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
        assert plain(got.select(*columns).collect()) == plain(want), name


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    """Documents some of which are empty: single ones, a run of them, and the first."""
    folder = str(tmp_path_factory.mktemp("empty"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = (F.col("doc_id") % 23 == 0) | F.col("doc_id").between(100, 160) | F.col("doc_id").isin(1, 5, 7, 11, 15, 25, 31)
    docs.withColumn("text", F.when(empty, "").otherwise(F.col("text"))).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["block_groups", "raw_layout", "packed_first_only", "update_actions", "verify_blocks"])
def test_empty_documents(spark, empty_dir, name):
    """F2 to F6: what SQL says of documents without a text."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{empty_dir}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    plain = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert plain(entry.queries()[name](spark, empty_dir).select(*columns).collect()) == plain(want.fetchall())


def test_all_documents_are_extracted(spark, sf_dir):
    """every document is written with its whole text and found again, links as what they point to."""
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.path.split("/", 1)[1]: r for r in entry.queries()["extract_and_scan"](spark, sf_dir).collect() if "/" in r.path}
    files = {k: r.text for k, r in rows.items() if r.entry_type == "File"}
    assert files == {f"{k}.txt": x for k, x in want.items()} | {f"{k}.link": x for k, x in want.items() if k % 6 == 4}
    assert {k for k, r in rows.items() if r.entry_type == "Directory"} == {str(k) for k in want if k % 6 == 2}
