import functools
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylake import errors
from quarrylake.functions import codecs, dtypes
from quarrylake.operators import catalog, chunks, ragged, selection
from quarrylake.operators.selection import ALL, NONE, Dim, Hyperslab, Points, select
from quarrylake.plans import queries
from quarrylake.sources import files, zarr

dims = st.builds(Dim, st.integers(0, 6), st.integers(1, 5), st.integers(0, 5), st.integers(0, 4))


@settings(max_examples=60, deadline=None)
@given(dims)
def test_dimension_arithmetic(d):
    picked = [d.start + k * d.stride + b for k in range(d.count) for b in range(d.block)]
    assert d.size == len(picked) and d.last == (max(picked) if picked else None)


@pytest.mark.parametrize("d", [Dim(1, 3, 4, 2), Dim(0, 2, 5, 4), Dim(3, 1, 1, 7), Dim(2, 5, 0, 1), Dim(0, 1, 20, 1)])
def test_select_equals_indexing(spark, d):
    picked = [d.start + k * d.stride + b for k in range(d.count) for b in range(d.block)]
    got = select(spark.range(24).withColumnRenamed("id", "i"), ["i"], Hyperslab((d,)), output=True).collect()
    assert sorted(r.i for r in got) == sorted(picked)
    assert sorted((r.o0, r.i) for r in got) == list(enumerate(picked))


def test_selection_checks():
    shape = [4, 6]
    assert selection.num_elements(ALL, shape) == 24 and selection.num_elements(NONE, shape) == 0
    assert selection.num_elements(ALL, []) == 1 and Hyperslab(()).num_elements == 0
    assert selection.byte_length(Hyperslab.contiguous([0, 0], [2, 3]), shape, 8) == 48
    selection.validate(Hyperslab.contiguous([4, 0], [0, 6]), shape)
    for bad, error in [
        (Hyperslab.contiguous([0], [1]), errors.ShapeError), (Hyperslab.contiguous([3, 0], [2, 1]), errors.SelectionOutOfBounds),
        (Points(((4, 0),)), errors.SelectionOutOfBounds), (Points(((0,),)), errors.ShapeError), (Hyperslab((Dim(0, 0), Dim())), errors.SelectionOutOfBounds),
    ]:
        with pytest.raises(error):
            selection.validate(bad, shape)
    with pytest.raises(errors.SelectionOutOfBounds):
        selection.validate(Hyperslab.contiguous([0, 0], [0, 1]), shape, empty_is_error=True)
    with pytest.raises(errors.UnsupportedFeature):
        selection.byte_length(ALL, shape, None)


@pytest.mark.parametrize("d, n, c", [(Dim(3, 9, 11), 120, 7), (Dim(0, 1, 40), 40, 16), (Dim(5, 4, 6, 3), 64, 10), (Dim(2, 30, 3), 100, 8)])
def test_pruning_keeps_exactly_the_touched_chunks(spark, d, n, c):
    picked = [d.start + k * d.stride + b for k in range(d.count) for b in range(d.block)]
    rows = chunks.prune(chunks.chunk_table(spark, [n], [c]), Hyperslab((d,)), [c]).collect()
    assert sorted(r.c0 for r in rows) == sorted({i // c for i in picked})


@pytest.mark.parametrize("d, n, c", [(Dim(5, 11, 9, 4), 120, 9), (Dim(0, 3, 20, 3), 64, 10), (Dim(2, 30, 3, 1), 100, 8), (Dim(7, 1, 1, 50), 90, 16)])
def test_slices_rebuild_the_selection(spark, d, n, c):
    picked = [d.start + k * d.stride + b for k in range(d.count) for b in range(d.block)]
    rows = chunks.chunk_plan(spark, [n], [c], Hyperslab((d,))).collect()
    got = sorted((r.t0 + j, r.o0 + r.s0 + j * r.d0) for r in rows for j in range(r.n0))
    assert got == list(enumerate(picked))
    assert {r.c0 for r in rows} == {i // c for i in picked}
    assert chunks.touched(Hyperslab((d,)), [n], [c])[0] in (None, sorted({i // c for i in picked}))


def test_untouched_objects_are_not_opened(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("i0"), F.lit(0).cast("long").alias("i1"), F.col("id").cast("double").alias("value"))
    for version, sep in ((2, "."), (2, "/"), (3, "/"), (3, ".")):
        path = str(tmp_path / f"a{version}{ord(sep)}")
        zarr.write_array(df, path, zarr.ArrayMeta(version, (100, 1), (10, 1), "<f8", "NaN", "C", sep))
        got = zarr.read_array(spark, path, Hyperslab((Dim(15, 40, 2, 3), Dim(0, 1, 1))))
        assert sorted(r.i0 for r in got.collect()) == [15, 16, 17, 55, 56, 57]
        opened = {p.split(path)[1].strip("/").removeprefix("c").strip("./")[0] for p in got.inputFiles()}
        assert opened == {"1", "5"}
        for k in (0, 2, 9):  # what is not touched may be broken
            name = sep.join((["c"] if version == 3 else []) + [str(k), "0"])
            (tmp_path / f"a{version}{ord(sep)}" / name).write_bytes(b"x")
        assert got.count() == 6


def test_append_survives_a_failed_write(spark, tmp_path, monkeypatch):
    from quarrylake.streaming import append

    meta, path = zarr.ArrayMeta(3, (0,), (4,), "<f8", -1.0), str(tmp_path / "a")
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("value"))
    append.append_rows(rows(0, 6), path, meta)
    whole, calls = zarr.put_objects, []

    def fail(objects, at):
        calls.append(at)
        whole(objects.where("key = 'c/1'"), at)  # a part of the objects is there
        raise RuntimeError("lost")

    monkeypatch.setattr(zarr, "put_objects", fail)
    with pytest.raises(RuntimeError):
        append.append_rows(rows(6, 11), path, meta)
    monkeypatch.setattr(zarr, "put_objects", whole)
    assert [r.value for r in zarr.read_array(spark, path).orderBy("i0").collect()] == [float(i) for i in range(6)]
    append.append_rows(rows(6, 11), path, meta)  # the batch again
    assert [r.value for r in zarr.read_array(spark, path).orderBy("i0").collect()] == [float(i) for i in range(11)]
    assert not list((tmp_path / "a").rglob(".c*")) and not list((tmp_path / "a").rglob(".1*"))


def test_grid(spark):
    rows = chunks.chunk_table(spark, [5, 4], [2, 3]).orderBy("linear").collect()
    assert [(r.c0, r.c1) for r in rows] == [(a, b) for a in range(3) for b in range(2)]
    assert [(r.e0, r.e1) for r in rows] == [(2, 3), (2, 1), (2, 3), (2, 1), (1, 3), (1, 1)]
    assert chunks.total_chunks([5, 4], [2, 3]) == 6
    with pytest.raises(errors.ShapeError):
        chunks.grid_shape([5], [0])
    with pytest.raises(errors.ShapeError):
        chunks.resize([5, 3], [False, True], [6, 3])
    ranges = chunks.byte_ranges(spark, 10, 4).orderBy("part").collect()
    assert [(r.begin, r.length) for r in ranges] == [(0, 3), (3, 3), (6, 2), (8, 2)]


def test_range_bounds_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    plan = select(df, ["event_id"], Hyperslab((Dim(10, 7, 20, 2),)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,10)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


# --- ragged -----------------------------------------------------------------


def test_ragged_round_trip_over_ranges(spark):
    lists = [(k * 3, [float(k)] * (k % 4)) for k in range(50)]
    df = spark.createDataFrame(lists, "k long, v array<double>")
    index, flat = ragged.encode(df, "k", "v", width=7), ragged.flat_positions(df, "k", "v", width=7)
    assert [r.end for r in index.orderBy("k").collect()] == np.cumsum([len(v) for _, v in lists]).tolist()
    back = ragged.decode(index, flat, "k", width=5)
    assert sorted((r.k, r.values) for r in back.collect()) == lists
    assert ragged.index_violations(index, "k", "end", 74).count() == 0 or sum(len(v) for _, v in lists) != 74
    assert ragged.max_levels(2, 1) == (1, 3)


def test_bare_repeated_levels(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, [])], "k long, v array<long>")
    rows = sorted((r.k, r.pos, r.rep, r["def"], r.value) for r in ragged.levels(df, "k", "v", nullable=False).collect())
    assert rows == [(1, 0, 0, 1, 5), (1, 1, 1, 1, 6), (2, 0, 0, 0, None)]


# --- codecs -----------------------------------------------------------------


def test_checksums():
    assert codecs.lookup3(b"") == 0xDEADBEEF and codecs.lookup3(b"Four score and seven years ago") == 0x17770551
    assert codecs.crc32c(b"123456789") == 0xE3069283 and codecs.crc32c(b"") == 0
    plain = lambda data: functools.reduce(lambda c, b: int(codecs._crc_table()[(c ^ b) & 0xFF]) ^ (c >> 8), data, 0xFFFFFFFF) ^ 0xFFFFFFFF
    for n in (8191, 8192, 10_000, 65_536):
        data = np.random.default_rng(n).bytes(n)
        assert codecs.crc32c(data) == plain(data)
        w = np.frombuffer(data + b"\0" * (n % 2), "<u2").tolist()
        assert codecs.fletcher32(data) == (sum(x * (len(w) - i) for i, x in enumerate(w)) % 65535) << 16 | sum(w) % 65535
    for data, want in [(b"", 0), (b"\1\2", 0x02010201), (b"\1\2\3\4", 0x08050604), (b"\1\2\3", 0x04050204), (b"\xff", 0x00FF00FF)]:
        assert codecs.fletcher32(data) == want


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=200), st.sampled_from(["zlib", "gzip", "zstd", "lz4", "snappy"]), st.integers(1, 8))
def test_pipelines(data, name, size):
    steps = [{"name": "shuffle", "elementsize": size}, {"name": name}, {"name": "crc32c"}]
    assert codecs.apply(codecs.apply(data, steps, True), steps, False, len(data)) == data
    assert codecs.unshuffle(codecs.shuffle(data, size), size) == data


def test_bit_packing_and_errors():
    v = np.arange(37) % 8
    assert codecs.unpack_bits(codecs.pack_bits(v, 3), 3, 37).tolist() == v.tolist()
    with pytest.raises(errors.InvalidFormat):
        codecs.apply(b"abcdefgh", [{"name": "crc32c"}], False)
    with pytest.raises(errors.UnsupportedFeature):
        codecs.codec("nope")
    with pytest.raises(errors.InvalidFormat):
        codecs.swap(b"abc", 2)
    assert codecs.swap(b"abcd", 2) == b"badc"
    assert dtypes.parse("uint64")[1].simpleString() == "decimal(20,0)" and dtypes.element_size(">i2") == 2


# --- stores -----------------------------------------------------------------

GOLDEN = [
    (2, "<i4", (4, 6), (2, 3), np.arange(24).reshape(4, 6), (), [((1, 1, 3), (2, 1, 4)), ((0, 2, 2), (1, 2, 3))]),
    (2, "<f8", (5, 4), (2, 2), np.arange(-7, 3, 0.5).reshape(5, 4), ({"name": "gzip", "level": 1},), [((1, 2, 2), (0, 2, 2))]),
    (3, "<i4", (3, 5), (2, 2), np.arange(15).reshape(3, 5), (), [((0, 1, 3), (1, 1, 4)), ((0, 2, 2), (0, 2, 3))]),
    (3, ">f8", (4, 4), (2, 2), np.arange(-7, 1, 0.5).reshape(4, 4), ({"name": "gzip"},), [((1, 1, 3), (1, 1, 3)), ((0, 2, 2), (0, 2, 2))]),
]


@pytest.mark.parametrize("version, dtype, shape, chunk, values, steps, picks", GOLDEN)
@pytest.mark.parametrize("order", ["C", "F"])
def test_stores_against_numpy(spark, tmp_path, version, dtype, shape, chunk, values, steps, picks, order):
    at = np.indices(shape).reshape(2, -1).T.tolist()
    kind = "double" if "f" in dtype else "int"
    df = spark.createDataFrame([(*p, values[tuple(p)].item()) for p in at], f"i0 long, i1 long, value {kind}")
    meta = zarr.ArrayMeta(version, shape, chunk, dtype, 0, order, "/" if version == 3 else ".", steps)
    zarr.write_array(df, str(tmp_path / "a"), meta)
    assert zarr.read_meta(spark, str(tmp_path / "a")) == meta
    whole = {(r.i0, r.i1): r.value for r in zarr.read_array(spark, str(tmp_path / "a")).collect()}
    assert whole == {tuple(p): values[tuple(p)].item() for p in at}
    for (s0, t0, n0), (s1, t1, n1) in picks:
        slab = Hyperslab((Dim(s0, t0, n0), Dim(s1, t1, n1)))
        got = zarr.read_array(spark, str(tmp_path / "a"), slab).orderBy("i0", "i1").collect()
        assert [r.value for r in got] == values[s0 : s0 + t0 * n0 : t0, s1 : s1 + t1 * n1 : t1].ravel().tolist()


def test_partial_write(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("value"))
    meta = zarr.ArrayMeta(3, (10,), (4,), "<f8", "NaN")
    zarr.write_array(df.where("i0 < 6"), str(tmp_path / "a"), meta)
    patch = df.where("i0 = 5").withColumn("value", F.lit(-1.0))
    zarr.write_array(zarr.update_selection(spark, str(tmp_path / "a"), patch), str(tmp_path / "a"), meta)
    got = [r.value for r in zarr.read_array(spark, str(tmp_path / "a")).orderBy("i0").collect()]
    assert got[:6] == [0, 1, 2, 3, 4, -1] and all(map(math.isnan, got[6:]))
    with pytest.raises(errors.NotFound):
        zarr.read_meta(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("checksum", [False, True])
def test_shards(spark, tmp_path, checksum):
    df = spark.range(70).select(F.floor(F.col("id") / 10).alias("i0"), (F.col("id") % 10).alias("i1"), F.col("id").cast("int").alias("value"))
    meta = zarr.ArrayMeta(3, (7, 10), (4, 6), "<i4", 0, "C", "/", ({"name": "zstd"},), (2, 3), checksum)
    zarr.write_array(df, str(tmp_path / "a"), meta)
    assert zarr.read_meta(spark, str(tmp_path / "a")) == meta
    slab = Hyperslab((Dim(1, 2, 3), Dim(5, 1, 4)))
    got = zarr.read_array(spark, str(tmp_path / "a"), slab).orderBy("i0", "i1").collect()
    assert [r.value for r in got] == np.arange(70).reshape(7, 10)[1:7:2, 5:9].ravel().tolist()
    with pytest.raises(errors.UnsupportedFeature):
        zarr.update_selection(spark, str(tmp_path / "a"), df)


def test_consolidated_metadata():
    v2 = json.dumps({"metadata": {".zgroup": {}, "a/.zarray": {"shape": [1]}, "a/.zattrs": {}}})
    assert {p: x["kind"] for p, x in zarr.consolidated(v2).items()} == {"/": "group", "/a": "array"}
    v3 = json.dumps({"consolidated_metadata": {"metadata": {"g": {"node_type": "group"}, "g/a": {"node_type": "array"}}}})
    assert {p: x["kind"] for p, x in zarr.consolidated(v3).items()} == {"/g": "group", "/g/a": "array"}


def test_fits(spark, tmp_path):
    import pandas as pd

    data = pd.DataFrame({"X": [10, 20, 30], "Y": [11.5, 21.5, -1.0]})
    (tmp_path / "t.fits").write_bytes(files.fits_table_bytes([("X", "I"), ("Y", "D")], data))
    cards = files.read_fits_cards(spark, str(tmp_path / "t.fits"))
    assert {r.keyword: r.value for r in cards.where("hdu = 1").collect()}["TTYPE2"] == "Y"
    rows = files.read_fits_table(spark, str(tmp_path / "t.fits"), rows=(1, 9), columns=["Y"]).collect()
    assert [(r.row, r.Y) for r in rows] == [(1, 21.5), (2, -1.0)]


def test_npy(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(a))
    got = files.read_npy(spark, str(tmp_path), "<f8", 2).collect()
    assert len(got) == 24 and all(r.value == a[r.i0, r.i1] for r in got)
    with pytest.raises(errors.UnsupportedFeature):
        files.read_npy(spark, str(tmp_path), "<i2", 2)


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(4.0), y=np.arange(3, dtype="i4"))
    np.savez(tmp_path / "b.npz", y=np.arange(2, dtype="i4"))
    assert sorted(r.value for r in files.read_npz(spark, str(tmp_path), "y", "<i4", 1).collect()) == [0, 0, 1, 1, 2]
    assert files.read_npz(spark, str(tmp_path), "x", "<f8", 1).count() == 4


def test_open_dataset(spark, tmp_path):
    from quarrylake.plans.facade import open_dataset

    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 4))
    slab = Hyperslab.contiguous([1, 2], [2, 2])
    assert sorted(r.value for r in open_dataset(spark, str(tmp_path / "a.npy"), dtype="<f8", shape=(3, 4)).read(slab).collect()) == [6, 7, 10, 11]
    spark.range(9).withColumnRenamed("id", "row").write.parquet(str(tmp_path / "t.parquet"))
    assert open_dataset(spark, str(tmp_path / "t.parquet")).read(Hyperslab.contiguous([2], [3])).count() == 3
    with pytest.raises(errors.UnsupportedFeature):
        open_dataset(spark, "x", kind="hdf5")


def test_fits_image(spark, tmp_path):
    a = np.arange(8, dtype=">i2").reshape(2, 4)
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    2", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880)
    (tmp_path / "i.fits").write_bytes(head.encode() + a.tobytes().ljust(2880, b"\0"))
    got = files.read_fits_image(spark, str(tmp_path / "i.fits"), selection=Hyperslab.contiguous([1, 1], [1, 2])).collect()
    assert sorted((r.i0, r.i1, r.value) for r in got) == [(1, 1, 5), (1, 2, 6)]


def test_footers_without_contents(spark, sf_dir, tmp_path):
    spark.range(50_000).selectExpr("id", "array(id, id + 1) as v").repartition(2).write.parquet(str(tmp_path / "a b%20"))
    facts = files.parquet_facts(spark, str(tmp_path / "a b%20"))
    assert "ReadSchema: struct<path:string>" in facts._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.column, r.row_group, r.rows, r["values"], r.bytes, r.codec) for r in facts.collect())
    assert [(c, g, n) for c, g, n, *_ in want] == [("id", 0, 25_000)] * 2 + [("v.list.element", 0, 25_000)] * 2
    # a store that only Spark reads
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.footers.link./in", f"file://{tmp_path}")
    far = files.parquet_facts(spark, "viewfs://footers/in/a b%20")
    assert sorted((r.column, r.row_group, r.rows, r["values"], r.bytes, r.codec) for r in far.collect()) == want


def test_axes_without_a_scale_are_not_joined(spark):
    rows = spark.range(0, 4000, 1, 4).selectExpr("concat('v', id) as variable", "cast(id % 2 as int) as axis", "if(id % 2 = 0, id % 6, null) as scale")
    scales = spark.createDataFrame([(0, "x"), (2, "y")], "scale long, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = catalog.dimension_names(rows, scales).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {f"v{k}": f"d{k % 2}" if k % 2 or k % 6 == 4 else {0: "x", 2: "y"}[k % 6] for k in range(4000)}
    assert {r.variable: r.name for r in named} == want and len(named) == 4000
    # they do not meet in the task of one key
    assert len({r.task for r in named if r.axis == 1}) == 4


def test_decode_meets_no_pairs_within_a_range(spark):
    df = spark.range(6000).selectExpr("id as k", "array(id, -id) as v")
    index = ragged.encode(df, "k", "v")
    back = ragged.decode(index, ragged.flat_positions(df, "k", "v", index=index), "k")
    # joins have no condition besides their keys: no list meets all flat rows of its range
    assert " pos#" not in "".join(x for x in back._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert sorted((r.k, r.values) for r in back.collect()) == [(k, [k, -k]) for k in range(6000)]


def test_decode_of_broken_columns(spark):
    """Gaps, repeated positions, ends that fall, lists beyond the flat rows."""
    flat = [(0, 10), (1, 11), (1, 12), (3, 13), (4, None), (5, 15), (6, 16), (7, 17), (8, 18), (9, 19), (21, 20)]
    ends = [(1, 2), (2, 2), (3, 7), (4, 5), (5, 9), (6, 12), (7, 20), (8, None), (9, 22)]
    want, start = {}, 0
    for k, e in ends:
        want[k] = [v for p, v in flat if e is not None and start <= p < e]
        start = e or 0
    index, rows = spark.createDataFrame(ends, "k long, end long"), spark.createDataFrame(flat, "pos long, value long")
    for width in (1, 3, 4, 4096):
        assert {r.k: r.values for r in ragged.decode(index, rows, "k", width=width).collect()} == want


@pytest.mark.parametrize("name", ["ragged_decode", "csc_to_coo", "units_spikes", "dynamic_table_rows"])
def test_lists_are_read_once_and_sliced(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the lists' table is in the plan once, and no list meets all flat rows of its range
    assert sum("Relation [" in x and "l_linenumber#" in x for x in plan) == 1
    assert not [x for x in plan if "Join" in x and " pos#" in x]


def test_equal_values_are_coded_once():
    import pyarrow as pa

    seen = []
    got = codecs.each_distinct(pa.array([b"a", None, b"bb", b"a", b""]), lambda x: seen.append(x) or x.decode() + "!")
    assert got.to_pylist() == ["a!", None, "bb!", "a!", "!"] and sorted(seen) == [b"", b"a", b"bb"]
    assert codecs.each_distinct(pa.array([], pa.binary()), len).cast(pa.int64()).to_pylist() == []
    assert codecs.each_distinct(pa.array([None], pa.binary()), len).cast(pa.int64()).to_pylist() == [None]


def test_short_strings_as_long_ones(monkeypatch):
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, n, np.uint8).tobytes() for n in range(140)] + [b"\xff" * n for n in range(63)]
    short = [(codecs.fletcher32(x), *(codecs.shuffle(x, k) for k in (1, 2, 3, 8))) for x in data]
    for x in data:
        assert all(codecs.unshuffle(codecs.shuffle(x, k), k) == x for k in (1, 2, 3, 8))
    monkeypatch.setattr(codecs, "_SHORT", 0)
    assert short == [(codecs.fletcher32(x), *(codecs.shuffle(x, k) for k in (1, 2, 3, 8))) for x in data]
