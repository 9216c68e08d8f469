import os

from solidframe.sources.tables import materialize, release, scratch


def files(df):
    return os.path.exists(df._own_files.removeprefix("file://"))


def test_tables_go_when_told(spark):
    one = materialize(spark.range(5))
    with scratch(spark):
        two = materialize(one.selectExpr("id * 2 AS id"))
        assert sorted(r.id for r in two.collect()) == [0, 2, 4, 6, 8] and files(two)
        with scratch(spark):
            three = materialize(two)
        assert files(two) and not files(three)
    assert files(one) and not files(two)
    release(one)
    assert not files(one)
    release(one)


def test_rows_of_many_bytes_go_in_small_groups(spark):
    """a task that writes or reads archives holds some of them, not the first hundred."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    made = spark.range(0, 48, 1, 1).select("id", F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 14)), lambda k: F.sha2(F.concat_ws("-", "id", k), 256)), "")).alias("content"))
    out = materialize(made)  # 48 rows of half a MB that don't get smaller
    name, = (x for x in os.listdir(out._own_files.removeprefix("file://")) if x.endswith(".parquet"))
    told = pq.ParquetFile(os.path.join(out._own_files.removeprefix("file://"), name)).metadata
    assert told.num_rows == 48 and max(told.row_group(k).total_byte_size for k in range(told.num_row_groups)) <= 18 << 20
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, made.collect()))
    release(out)
