"""Queries over the driver tables for stores, codecs, nested levels, chunk plans and
recordings, with their DuckDB SQL.  They join the entries of ``queries.QUERIES``."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import chunks, ragged, validate
from ..operators.selection import ALL, NONE, Dim, Hyperslab, Points, select
from ..sources import files, zarr
from ..streaming.append import append_rows
from . import hybrid, recordings, schema
from .queries import _embeddings, _order_lists, _scratch, _vectors, query, table

# --- selections and chunk plans ----------------------------------------------


@query("SELECT vec_id AS i0, label FROM embeddings")
def sel_all_and_none(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), "label")
    return select(df, ["i0"], ALL).unionByName(select(df, ["i0"], NONE))


@query(
    """WITH e AS (SELECT k, b, 5 + k * 11 + b AS i FROM (SELECT unnest(range(0, 40)) AS k), (SELECT unnest(range(0, 4)) AS b))
       SELECT i // 9 AS c0, min(i) - (i // 9) * 9 AS s0, count(*) AS n0, 1::BIGINT AS d0, k * 4 + min(b) AS t0 FROM e GROUP BY k, i // 9"""
)
def chunk_block_slices(spark, sf_dir):
    slab = Hyperslab((Dim(5, 11, 40, 4),))
    return chunks.chunk_plan(spark, [500], [9], slab).select("c0", "s0", "n0", "d0", "t0")


@query(
    """SELECT ord, i // 50 AS c0, j // 16 AS c1, i % 50 AS p0, j % 16 AS p1
       FROM (SELECT unnest(range(0, 30)) AS ord), LATERAL (SELECT (ord * 7) % 100 AS i, (ord * 5) % 64 AS j)"""
)
def chunk_plan_points(spark, sf_dir):
    points = Points(tuple(((k * 7) % 100, (k * 5) % 64) for k in range(30)))
    return chunks.chunk_plan(spark, [100, 64], [50, 16], points)


@query(
    """SELECT vec_id AS i0, embedding[2] AS value FROM embeddings WHERE vec_id >= 40 AND vec_id < 60
       UNION ALL SELECT vec_id, embedding[2] FROM embeddings WHERE vec_id >= 90 AND vec_id < 91"""
)
def chunk_pruned_read(spark, sf_dir):
    """A stride longer than a chunk: only the chunks of two rows' groups are opened."""
    n, path = _vectors(spark, sf_dir), _scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.get("embedding", F.lit(1)).alias("value"))
    zarr.write_array(rows, path, zarr.ArrayMeta(3, (n,), (10,), "<f4", "NaN"))
    near = zarr.read_array(spark, path, Hyperslab.contiguous([40], [20]))
    return near.unionByName(zarr.read_array(spark, path, Hyperslab((Dim(90, 50, 1),))))


# --- stores -------------------------------------------------------------------


@query("SELECT vec_id AS i0, p AS i1, embedding[p + 1] AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS p) WHERE vec_id % 3 = 1 AND p >= 10 AND p < 50")
def sharded_roundtrip(spark, sf_dir):
    n, path = _vectors(spark, sf_dir), _scratch(spark)
    df = _embeddings(spark, sf_dir).withColumn("i1", F.col("i1").cast("long"))
    zarr.write_array(df, path, zarr.ArrayMeta(3, (n + 3, 64), (96, 32), "<f4", "NaN", steps=({"name": "zstd"},), inner=(24, 16), index_checksum=True))
    slab = Hyperslab((Dim(1, 3, (n + 2) // 3, 1), Dim(10, 1, 40, 1)))
    return zarr.read_array(spark, path, slab).where(F.col("i0") < n)


@query("SELECT vec_id AS i0, CASE WHEN vec_id % 50 = 7 AND vec_id < 400 THEN label + 1000 ELSE label END AS value FROM embeddings")
def partial_write(spark, sf_dir):
    n, path = _vectors(spark, sf_dir), _scratch(spark)
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.col("label").alias("value"))
    meta = zarr.ArrayMeta(3, (n,), (64,), "<i4", 0, steps=({"name": "gzip"}, {"name": "fletcher32"}))
    zarr.write_array(df, path, meta)
    patch = df.where("i0 % 50 = 7 and i0 < 400").withColumn("value", F.col("value") + 1000)
    zarr.write_array(zarr.update_selection(spark, path, patch), path, meta)
    return zarr.read_array(spark, path)


@query("SELECT vec_id AS i0, label::DOUBLE AS value FROM embeddings")
def append_unlimited(spark, sf_dir):
    """Batches of growing row numbers, each merged with the chunk that the last one left."""
    path, n = _scratch(spark), _vectors(spark, sf_dir)
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.col("label").cast("double").alias("value"))
    meta = zarr.ArrayMeta(3, (0,), (100,), "<f8", "NaN")
    for lo, hi in ((0, n // 3), (n // 3, n // 3 + 1), (n // 3 + 1, n)):
        append_rows(df.where((F.col("i0") >= lo) & (F.col("i0") < hi)), path, meta)
    return zarr.read_array(spark, path)


@query(
    """SELECT '/' || n_regionkey || '/' || n_nationkey AS path, 'array' AS kind, n_nationkey::BIGINT AS n FROM nation
       UNION ALL SELECT '/' || r_regionkey, 'group', NULL FROM region"""
)
def consolidated_catalog(spark, sf_dir):
    # one metadata document for all nodes, as a store keeps it
    nodes = {f"{r.n_regionkey}/{r.n_nationkey}/.zarray": {"shape": [r.n_nationkey]} for r in table(spark, sf_dir, "nation").collect()}
    nodes |= {f"{r.r_regionkey}/.zgroup": {} for r in table(spark, sf_dir, "region").collect()}
    found = zarr.consolidated(json.dumps({"metadata": nodes}))
    rows = [(p, x["kind"], x["meta"].get("shape", [None])[0]) for p, x in found.items()]
    return spark.createDataFrame(rows, "path string, kind string, n long")


@query("SELECT vec_id AS i0, label::DOUBLE AS value FROM embeddings")
def npz_roundtrip(spark, sf_dir):
    rows, path = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("value")), _scratch(spark)

    def pack(frame):
        import pandas as pd

        frame = frame.sort_values("i")
        content = files.npz_bytes({"at": frame["i"].to_numpy(), "value": frame["value"].to_numpy()})
        return pd.DataFrame({"key": [f"part-{frame['i'].iloc[0] // 256}.npz"], "content": [content]})

    zarr.put_objects(rows.groupBy(F.floor(F.col("i") / 256)).applyInPandas(pack, "key string, content binary"), path)
    at = files.read_npz(spark, path, "at", "<i8", 1).select("file", "i0", F.col("value").alias("at"))
    value = files.read_npz(spark, path, "value", "<f8", 1)
    return at.join(value, ["file", "i0"]).select(F.col("at").alias("i0"), "value")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def embedded_table(spark, sf_dir):
    path = _scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    hybrid.embed(orders, path, "orders", "primary", ["o_orderstatus"])
    assert hybrid.descriptor(spark, path, "orders").keys == ("o_orderstatus",)
    return hybrid.read_embedded(spark, path, "orders").where("o_orderstatus = 'F'").drop("o_orderstatus")


# --- codecs -------------------------------------------------------------------

_CODECS = ("zlib", "gzip", "zstd", "lz4", "snappy")


@query(f"SELECT o_orderkey, c AS codec, o_orderstatus || '-' || o_orderpriority AS text FROM orders, (SELECT unnest({list(_CODECS)}) AS c)")
def codecs_one_by_one(spark, sf_dir):
    """Each codec after a byte shuffle and before both checksums, and back."""
    text = F.concat("o_orderstatus", F.lit("-"), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(c) for c in _CODECS])).alias("codec"), text.cast("binary").alias("data"))

    def there_and_back(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def once(name, raw):
            steps = [{"name": "shuffle", "elementsize": 2}, {"name": name}, {"name": "fletcher32"}, {"name": "crc32c"}]
            return codecs.apply(codecs.apply(raw, steps, True), steps, False, len(raw)).decode()

        for b in batches:
            for name in _CODECS:
                own = b.filter(pc.equal(b.column("codec"), name))
                text = codecs.each_distinct(own.column("data"), lambda raw, name=name: once(name, raw)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([own.column("o_orderkey"), own.column("codec"), text], ["o_orderkey", "codec", "text"])

    return rows.mapInArrow(there_and_back, "o_orderkey long, codec string, text string")


@query(
    """WITH w AS (SELECT n_nationkey, r, i, n, (ascii(r[2 * i - 1]) + 256 * CASE WHEN 2 * i <= length(r) THEN ascii(r[2 * i]) ELSE 0 END)::HUGEINT AS w
                  FROM (SELECT n_nationkey, repeat(n_name || '/', 700) AS r, (length(repeat(n_name || '/', 700)) + 1) // 2 AS n FROM nation), LATERAL (SELECT unnest(range(1, n + 1)) AS i))
       SELECT n_nationkey, ((sum(w * (n - i + 1)) % 65535) * 65536 + sum(w) % 65535)::BIGINT AS fletcher32 FROM w GROUP BY n_nationkey"""
)
def fletcher_over_rows(spark, sf_dir):
    text = F.expr("repeat(concat(n_name, '/'), 700)").cast("binary")
    return table(spark, sf_dir, "nation").select("n_nationkey", codecs.checksum(text, "fletcher32").alias("fletcher32"))


# --- nested levels and ragged columns -------------------------------------------


@query(
    """WITH t AS (SELECT conv_id, list(turn ORDER BY turn) FILTER (turn % 2 = 0) AS a, list(turn ORDER BY turn) FILTER (turn % 2 = 1) AS b FROM conversations GROUP BY conv_id),
            v AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN []
                    ELSE [CASE WHEN conv_id % 3 = 0 THEN NULL ELSE list_transform(a, lambda x: CASE WHEN x = 2 THEN NULL ELSE x END) END, coalesce(b, [])] END AS v FROM t),
            o AS (SELECT conv_id, v, unnest(range(0, greatest(1, coalesce(len(v), 1))))::INT AS p FROM v),
            i AS (SELECT conv_id, v, v[p + 1] AS w, p, unnest(range(0, greatest(1, coalesce(len(v[p + 1]), 1))))::INT AS q FROM o)
       SELECT conv_id, p || '.' || q AS pos, CASE WHEN q > 0 THEN 2 WHEN p > 0 THEN 1 ELSE 0 END AS rep,
              CASE WHEN v IS NULL THEN 0 WHEN len(v) = 0 THEN 1 WHEN w IS NULL THEN 2 WHEN len(w) = 0 THEN 3 WHEN w[q + 1] IS NULL THEN 4 ELSE 5 END AS def, w[q + 1] AS value FROM i"""
)
def dremel_nested_levels(spark, sf_dir):
    turn = lambda k: F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == k, F.col("turn"))))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn(0).alias("a"), turn(1).alias("b"))
    first = F.when(F.col("conv_id") % 3 != 0, F.transform("a", lambda x: F.when(x != 2, x)))
    v = F.when(F.col("conv_id") % 5 == 1, F.expr("cast(array() as array<array<long>>)")).when(F.col("conv_id") % 5 != 0, F.array(first, F.col("b")))
    rows = ragged.nested_levels(lists.select("conv_id", v.alias("v")), "conv_id", "v", 2)
    return rows.withColumn("pos", F.concat_ws(".", F.transform("pos", lambda p: p.cast("string"))))


@query(
    """WITH l AS (SELECT user_id, list(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END ORDER BY event_id) AS v FROM events GROUP BY user_id),
            p AS (SELECT user_id, v, unnest(range(0, len(v)))::INT AS pos FROM l)
       SELECT user_id, pos, CASE WHEN pos = 0 THEN 0 ELSE 1 END AS rep, CASE WHEN v[pos + 1] IS NULL THEN 2 ELSE 3 END AS def, v[pos + 1] AS value FROM p"""
)
def dremel_null_items(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    v = F.transform("v", lambda x: F.when(x % 4 != 0, x))
    return ragged.levels(lists.select("user_id", v.alias("v")), "user_id", "v", nullable_items=True)


@query("""SELECT l_orderkey, count(*) AS "count", (sum(count(*)) OVER (ORDER BY l_orderkey) - count(*))::BIGINT AS "offset" FROM lineitem GROUP BY l_orderkey""")
def ragged_descriptors(spark, sf_dir):
    return ragged.descriptors(_order_lists(spark, sf_dir), "l_orderkey", "parts").select("l_orderkey", "descriptor.count", "descriptor.offset")


@query(
    """SELECT NULL::BIGINT AS col, 'row outside the matrix' AS violation FROM lineitem WHERE l_linenumber >= 6
       UNION ALL SELECT max(l_orderkey), 'last end differs from the flat length' FROM lineitem"""
)
def csc_checks(spark, sf_dir):
    lists = _order_lists(spark, sf_dir).withColumnRenamed("l_orderkey", "col")
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("row"))
    ends = ragged.encode(lists, "col", "parts")
    last = ends.agg(F.max("col").alias("col"), F.lit(1).alias("more"))
    longer = ends.join(F.broadcast(last), "col", "left").select("col", (F.col("end") + F.coalesce("more", F.lit(0))).alias("end"))
    return ragged.csc_violations(longer, entries, 6)


# --- recordings -----------------------------------------------------------------


@query("SELECT l_orderkey * 10 AS id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS spikes FROM lineitem GROUP BY l_orderkey")
def units_spikes(spark, sf_dir):
    lists = _order_lists(spark, sf_dir).withColumnRenamed("l_orderkey", "row")
    index = ragged.encode(lists, "row", "parts")
    flat = ragged.flat_positions(lists, "row", "parts", index=index)
    units = recordings.units_table(flat, index, index.select("row", (F.col("row") * 10).alias("id")))
    return units.select("id", F.array_join(F.col("spike_times").cast("array<string>"), ",").alias("spikes"))


@query(
    """SELECT o_orderkey AS "row", o_orderstatus AS status, p.parts FROM orders
       LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey) AS p ON l_orderkey = o_orderkey"""
)
def dynamic_table_rows(spark, sf_dir):
    lists = _order_lists(spark, sf_dir).withColumnRenamed("l_orderkey", "row")
    lists = lists.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row")), "row", "left_semi")
    index = ragged.encode(lists, "row", "parts")
    columns = {
        "status": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("value")),
        "parts": ragged.flat_positions(lists, "row", "parts", index=index),
    }
    rows = recordings.dynamic_table(columns, {"parts": index})
    return rows.select("row", "status", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


@query(
    """SELECT event_id AS idx, 2.0 + event_id / 250.0 AS t, value FROM events
       UNION ALL SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 0.5 END, value FROM events"""
)
def time_series_rows(spark, sf_dir):
    data = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value")
    times = data.where("idx % 2 = 0").select("idx", (F.col("idx") * F.lit(0.5)).alias("t"))
    return recordings.time_series(data, start=2.0, rate=250.0).unionByName(recordings.time_series(data, times))


@query("SELECT event_id AS idx, 'no timestamp' AS violation FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id + 10000000, 'no sample' FROM events WHERE event_id % 3 = 2")
def series_length_checks(spark, sf_dir):
    data = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), "value")
    shift = F.when(F.col("idx") % 3 == 2, F.col("idx") + 10000000).otherwise(F.col("idx"))
    times = data.where("idx % 3 <> 1").select(shift.alias("idx"), F.lit(0.0).alias("t"))
    samples = data.where("idx % 3 <> 2")
    return recordings.length_violations(samples, times)


@query(
    """SELECT 'o' || o_orderkey AS path, 'unequal_lengths' AS kind, least(n, 3) || '..' || greatest(n, 3) AS detail
       FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) WHERE n <> 3"""
)
def equal_length_checks(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = n.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    name = F.concat(F.lit("o"), "l_orderkey")
    columns = n.select(name.alias("table"), F.lit("a").alias("column"), "n").union(n.select(name, F.lit("b"), F.lit(3).cast("long")))
    return validate.equal_lengths(columns)


_SERIES = ["TimeSeries", "ElectricalSeries", "SpikeEventSeries", "LFP", "ImageMaskSeries", "Subject", "Units", "Other"]


@query(
    f"""SELECT '/e' || event_id AS path, CASE event_id % 8 WHEN 0 THEN 'TimeSeries' WHEN 1 THEN 'ElectricalSeries' WHEN 2 THEN 'SpikeEventSeries'
              WHEN 3 THEN 'LFP' ELSE 'ImageMaskSeries' END AS type FROM events WHERE event_id % 8 < 5"""
)
def listed_series(spark, sf_dir):
    path = F.concat(F.lit("/e"), "event_id")
    nodes = table(spark, sf_dir, "events").select(path.alias("path"))
    kind = F.element_at(F.array(*[F.lit(x) for x in _SERIES]), (F.col("event_id") % 8 + 1).cast("int"))
    attributes = table(spark, sf_dir, "events").select(path.alias("path"), F.lit("neurodata_type").alias("name"), kind.alias("value"))
    return recordings.list_time_series(nodes, attributes)


# --- schemas and keywords --------------------------------------------------------


@query(
    """SELECT table_name AS "table", count(*) AS fields, count(*) FILTER (data_type LIKE '%[]') AS nested
       FROM duckdb_columns() WHERE table_name IN ('orders', 'embeddings', 'documents', 'events') AND NOT internal GROUP BY table_name"""
)
def schema_counts(spark, sf_dir):
    names = ["orders", "embeddings", "documents", "events"]
    counts = [(n, schema.counts(table(spark, sf_dir, n).schema)) for n in names]
    return spark.createDataFrame([(n, c["fields"], c["nested"]) for n, c in counts], "table string, fields long, nested long")


@query("""SELECT column_name AS name, column_index - 1 AS at FROM duckdb_columns() WHERE table_name = 'lineitem' AND NOT internal""")
def schema_pairs(spark, sf_dir):
    found = schema.pairs(table(spark, sf_dir, "lineitem").schema)
    return spark.createDataFrame([(n, i) for i, (n, _, _) in enumerate(found)], "name string, at int")


@query(
    """SELECT 'keep' AS kind, column_name AS name FROM duckdb_columns() WHERE table_name = 'orders' AND NOT internal AND column_name <> 'o_custkey'
       UNION ALL SELECT 'update', 'o_custkey' UNION ALL SELECT 'add', 'c_name'"""
)
def schema_merge_steps(spark, sf_dir):
    old = table(spark, sf_dir, "orders")
    new = old.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("c_name", F.lit(""))
    return spark.createDataFrame([(s.kind, s.name) for s in schema.merge_schemas(old.schema, new.schema)[1]], "kind string, name string")


@query(
    """SELECT k, CASE WHEN k IN ('SIMPLE', 'BITPIX', 'NAXIS', 'EXTEND', 'END') OR regexp_full_match(k, 'NAXIS[1-9][0-9]*') THEN 'mandatory'
              WHEN regexp_full_match(k, 'T(TYPE|FORM|UNIT|NULL|SCAL|ZERO|DIM|DISP|BCOL)[1-9][0-9]*') THEN 'table'
              WHEN regexp_full_match(k, 'C(TYPE|RPIX|RVAL|DELT|ROTA)[1-9][0-9]*') THEN 'axis' WHEN k IN ('COMMENT', 'HISTORY', '') THEN 'commentary' ELSE 'other' END AS class
       FROM (SELECT unnest(['NAXIS', 'NAXIS', 'TFORM', 'CRPIX', 'HISTORY', 'OBJECT']) || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_nationkey::VARCHAR END AS k FROM nation)"""
)
def fits_keyword_classes(spark, sf_dir):
    tail = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_nationkey").cast("string"))
    heads = F.array(*[F.lit(x) for x in ("NAXIS", "NAXIS", "TFORM", "CRPIX", "HISTORY", "OBJECT")])
    rows = table(spark, sf_dir, "nation").select(F.explode(heads).alias("h"), tail.alias("t")).select(F.concat("h", "t").alias("k"))
    return rows.select("k", scalars.fits_keyword_class(F.col("k")).alias("class"))
