import pytest
from pyspark.sql import functions as F

from quarrylake import errors
from quarrylake.plans import recordings
from quarrylake.sources import zarr
from quarrylake.streaming.append import append_stream


def test_units(spark):
    flat = spark.createDataFrame(list(enumerate([1.0, 1.5, 2.0, 2.5, 3.0])), "pos long, value double")
    units = recordings.units_table(flat, spark.createDataFrame([(0, 2), (1, 5)], "row long, end long"), spark.createDataFrame([(0, 7), (1, 8)], "row long, id long"))
    assert sorted((r.id, r.spike_times) for r in units.collect()) == [(7, [1.0, 1.5]), (8, [2.0, 2.5, 3.0])]
    assert recordings.flat_spike_times(units).count() == 5


def test_time_series(spark):
    data = spark.createDataFrame([(0, 100.0), (1, 200.0)], "idx long, value double")
    assert [r.t for r in recordings.time_series(data, start=5.0, rate=1000.0).orderBy("idx").collect()] == [5.0, 5.001]
    times = spark.createDataFrame([(0, 0.5)], "idx long, t double")
    assert [r.t for r in recordings.time_series(data, times).orderBy("idx").collect()] == [0.5, None]
    assert recordings.length_violations(data, times).collect()[0].violation == "no timestamp"
    for bad in ({}, {"rate": 0.0}, {"timestamps": times, "rate": 1.0}):
        with pytest.raises(errors.InvalidFormat):
            recordings.time_series(data, **bad)


def test_dynamic_table(spark):
    col = lambda *v: spark.createDataFrame(list(enumerate(v)), "row long, value string")
    tags = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, value string")
    table = recordings.dynamic_table({"location": col("CA1", "CA2"), "tags": tags}, {"tags": spark.createDataFrame([(0, 2), (1, 3)], "row long, end long")})
    assert sorted(map(tuple, table.collect())) == [(0, "CA1", ["a", "b"]), (1, "CA2", ["c"])]


def test_stream_appends(spark, tmp_path):
    meta = zarr.ArrayMeta(3, (0,), (4,), "<f8", 0.0)
    for k, (lo, hi) in enumerate([(0, 6), (6, 11)]):
        spark.range(lo, hi).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("i0 long, value double").parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "a"), meta, str(tmp_path / "check")).awaitTermination(120)
    rows = zarr.read_array(spark, str(tmp_path / "a")).orderBy("i0").collect()
    assert [r.value for r in rows] == [float(i) for i in range(11)]


def test_embedded_tables(spark, tmp_path):
    from quarrylake.plans import hybrid

    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    made = hybrid.embed(df, str(tmp_path), "t", "index", ["k"])
    assert made == hybrid.descriptor(spark, str(tmp_path), "t") == hybrid.Descriptor("index", ("k",), 20) and made.embedded
    assert hybrid.read_embedded(spark, str(tmp_path), "t").where("k = 1").count() == 7
    assert not hybrid.Descriptor("cache").embedded
    with pytest.raises(errors.NotFound):
        hybrid.embed(df, str(tmp_path), "u", keys=["zz"])


def test_root_check(spark):
    from quarrylake.operators import validate

    good = [("/", "neurodata_type", "NWBFile"), ("/", "nwb_version", "2.6.0")]
    validate.require_root(spark.createDataFrame(good, "path string, name string, value string"))
    with pytest.raises(errors.InvalidFormat):
        validate.require_root(spark.createDataFrame(good[1:], "path string, name string, value string"))
