"""The store of records and its data source against the plain Parquet reader."""

import pytest

from tessera.sources import patches, records

N = 2345


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records"))
    rows = spark.range(N).selectExpr("lpad(CAST(id * 3 AS STRING), 8, '0') AS key", "CAST(repeat(chr(CAST(65 + id % 20 AS INT)), 12) AS BINARY) AS image", "array(2, 2, 3) AS shape", "'uint8' AS dtype", "CAST(id % 2 AS INT) AS label", "IF(id % 7 = 0, NULL, concat('S', id % 5)) AS slide_id")
    rows.write.parquet(f"{path}/plain")
    records.write_store(spark.read.parquet(f"{path}/plain").repartition(5), f"{path}/store")
    return path


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("limit", [0, 1, 999, 1000, 1001, 3 * N, 99_999_999])
def test_rows_and_planned_ranges(spark, stored, limit):
    df = records.read_store(spark, f"{stored}/store", limit)
    assert df.rdd.getNumPartitions() == (8 if limit == 0 else min(8, -(-limit // records.RANGE)))
    assert same(df, patches.read_records(spark, f"{stored}/plain", limit)) and df.columns == patches.read_records(spark, f"{stored}/plain").columns


def test_uri_and_decoding(spark, stored):
    df = records.read_store(spark, f"file://{stored}/store", 50)
    assert df.count() == 17 and same(patches.decode_records(df), patches.decode_records(patches.read_records(spark, f"{stored}/plain", 50)))


BOUNDS = {"key < '00002000'": 2, "key >= '00006000'": 2, "key > '00001500' AND key <= '00003000'": 3, "key = '00004002'": 1, "key = '00004001'": 1, "label = 1 AND key < '00000010'": 1, "key LIKE '%9'": 8, "key < 'x'": 8, "key >= '00001000' AND key < '00001000'": 1}


@pytest.mark.parametrize("bound", BOUNDS)
def test_bounds_reach_the_source(spark, stored, bound):
    before = spark.conf.get(records.PUSHDOWN)
    spark.conf.set(records.PUSHDOWN, "true")
    try:
        df = records.read_store(spark, f"{stored}/store").where(bound)
        assert same(df, patches.read_records(spark, f"{stored}/plain").where(bound))
        if "AND key < '00001000'" not in bound:  # that one is empty before it is planned
            assert df.rdd.getNumPartitions() == BOUNDS[bound]
    finally:
        spark.conf.set(records.PUSHDOWN, before)


def test_wrong_keys_and_an_empty_store(spark, stored, tmp_path):
    wrong = patches.read_records(spark, f"{stored}/plain").limit(1).withColumn("key", records.F.lit("123"))
    with pytest.raises(Exception, match="not a key: 123"):
        records.write_store(wrong, str(tmp_path / "wrong"))
    records.write_store(wrong.limit(0), str(tmp_path / "none"))
    assert records.read_store(spark, str(tmp_path / "none")).collect() == []
