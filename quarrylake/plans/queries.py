"""Queries over the driver tables, one per operator family, with their DuckDB SQL.

Each entry of ``QUERIES`` runs over whole tables; where an operator works on a
hierarchy or a grid, the query builds a small literal catalog for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, scalars
from ..operators import catalog, chunks, ragged, validate
from ..operators.selection import Dim, Hyperslab, Points, matrix_elements, points_frame, select, select_points
from ..sources import files, zarr
from . import schema
from .cut import scratch_folder

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> int:
    """Extent of the vector dimension."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or -1) + 1


def _embeddings(spark, sf_dir, columns: Dim | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return matrix_elements(rows, "vec_id", "embedding", columns)


# --- selections -------------------------------------------------------------


@query(
    """SELECT vec_id AS i0, p AS i1, embedding[p + 1] AS value FROM embeddings, (SELECT unnest([1, 4, 7, 10]) AS p)
       WHERE vec_id >= 3 AND vec_id <= 19 AND (vec_id - 3) % 5 < 2"""
)
def sel_hyperslab_strided(spark, sf_dir):
    rows, cols = Dim(3, 5, 4, 2), Dim(1, 3, 4, 1)
    df = _embeddings(spark, sf_dir, cols)
    return select(df, ["i0", "i1"], Hyperslab((rows, cols)))


@query(
    """SELECT vec_id AS i0, p AS i1, embedding[p + 1] AS value FROM embeddings, (SELECT unnest(range(8, 24))::INT AS p)
       WHERE vec_id >= 10 AND vec_id < 110"""
)
def sel_contiguous(spark, sf_dir):
    slab = Hyperslab.contiguous([10, 8], [100, 16])
    return select(_embeddings(spark, sf_dir, slab.dims[1]), ["i0", "i1"], slab)


_POINTS = ((5, 3), (0, 0), (5, 3), (17, 63), (499, 32))


@query(
    """SELECT ord, i0, i1, embedding[i1 + 1] AS value
       FROM (VALUES (0::BIGINT, 5::BIGINT, 3::BIGINT), (1, 0, 0), (2, 5, 3), (3, 17, 63), (4, 499, 32)) AS p(ord, i0, i1)
       JOIN embeddings ON vec_id = i0"""
)
def sel_points(spark, sf_dir):
    # rows meet the points first; each point then takes its element
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), "embedding")
    met = select_points(rows, ["i0"], points_frame(spark, Points(_POINTS), ["i0", "i1"]))
    return met.select("ord", "i0", "i1", F.get("embedding", F.col("i1").cast("int")).alias("value"))


@query(
    """SELECT k * 3 + b AS i0, k * 4 + b AS o0, label FROM (SELECT unnest(range(0, 5)) AS k), (SELECT unnest(range(0, 4)) AS b)
       JOIN embeddings ON vec_id = k * 3 + b"""
)
def sel_overlapping_blocks(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), "label")
    return select(df, ["i0"], Hyperslab((Dim(0, 3, 5, 4),))).select("i0", "o0", "label")


@query(
    """SELECT vec_id AS i0, ((vec_id - 2) // 7) * 3 + (vec_id - 2) % 7 AS o0, label FROM embeddings
       WHERE vec_id >= 2 AND vec_id <= 2 + 39 * 7 + 2 AND (vec_id - 2) % 7 < 3"""
)
def sel_output_coords(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), "label")
    return select(df, ["i0"], Hyperslab((Dim(2, 7, 40, 3),)), output=True)


@query("SELECT event_id, event_type FROM events WHERE event_id >= 100 AND event_id < 350")
def sel_table_rows(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return select(df, ["event_id"], Hyperslab.contiguous([100], [250]))


# --- chunk grids ------------------------------------------------------------


@query(
    """SELECT c0 * 4 + c1 AS linear, c0, c1, c0 * 100 AS o0, c1 * 20 AS o1, least(100, 450 - c0 * 100) AS e0, least(20, 64 - c1 * 20) AS e1
       FROM (SELECT unnest(range(0, 5)) AS c0), (SELECT unnest(range(0, 4)) AS c1)"""
)
def chunk_grid_ranges(spark, sf_dir):
    return chunks.chunk_table(spark, [450, 64], [100, 20])


@query(
    """WITH e AS (SELECT i, i // 7 AS c FROM (SELECT unnest(range(3, 100, 9)) AS i)),
            g AS (SELECT c, min(i) - c * 7 AS s0, count(*) AS n0, (min(i) - 3) // 9 AS t0 FROM e GROUP BY c)
       SELECT c AS c0, s0, n0, t0 FROM g"""
)
def chunk_prune(spark, sf_dir):
    slab = Hyperslab((Dim(3, 9, 11, 1),))
    return chunks.chunk_slices(chunks.chunk_table(spark, [120], [7]), slab, [7]).select("c0", "s0", "n0", "t0")


@query(
    """SELECT vec_id AS i0, p AS i1, CASE WHEN (vec_id // 50 + p // 16) % 3 = 0 THEN -1::FLOAT ELSE embedding[p + 1] END AS value
       FROM embeddings, (SELECT unnest(range(0, 64)) AS p)"""
)
def chunk_fill_missing(spark, sf_dir):
    df = _embeddings(spark, sf_dir).withColumn("i1", F.col("i1").cast("long"))
    stored = chunks.of_elements(df, ["i0", "i1"], [50, 16]).where("(c0 + c1) % 3 <> 0")
    return chunks.fill_missing(stored, spark, [_vectors(spark, sf_dir), 64], ["i0", "i1"], "value", -1.0, [50, 16])


@query(
    """SELECT DISTINCT vec_id // 50 AS c0, (p // 16)::BIGINT AS c1, (vec_id // 50) * 4 + p // 16 AS linear FROM embeddings, (SELECT unnest([1, 17, 33]) AS p)"""
)
def points_to_chunks(spark, sf_dir):
    df = _embeddings(spark, sf_dir, Dim(1, 16, 3, 1))
    at = chunks.of_elements(df, ["i0", "i1"], [50, 16])
    grid = chunks.grid_shape([_vectors(spark, sf_dir), 64], [50, 16])
    return at.select("c0", "c1", chunks.linear([F.col("c0"), F.col("c1")], grid).alias("linear")).distinct()


@query(
    """SELECT n AS linear, n // 12 AS r0, (n // 4) % 3 AS r1, n % 4 AS r2, n % 5 AS f0, (n // 5) % 3 AS f1, n // 15 AS f2
       FROM (SELECT unnest(range(0, 60)) AS n)"""
)
def linear_orders(spark, sf_dir):
    rows = spark.range(60).withColumnRenamed("id", "linear")
    row_major, col_major = chunks.delinear(F.col("linear"), [5, 3, 4]), chunks.delinear(F.col("linear"), [5, 3, 4], "F")
    return rows.select("linear", *[c.alias(f"r{k}") for k, c in enumerate(row_major)], *[c.alias(f"f{k}") for k, c in enumerate(col_major)])


@query("SELECT k AS part, k * 142857 + least(k, 1) AS begin, (142857 + CASE WHEN k < 1 THEN 1 ELSE 0 END)::BIGINT AS length FROM (SELECT unnest(range(0, 7)) AS k)")
def byte_partition(spark, sf_dir):
    return chunks.byte_ranges(spark, 1_000_000, 7)


@query("SELECT k AS linear, 'c/' || (k // 3) || '/' || (k % 3) AS v3, (k // 3) || '.' || (k % 3) AS v2 FROM (SELECT unnest(range(0, 12)) AS k)")
def chunk_keys(spark, sf_dir):
    rows = chunks.chunk_table(spark, [40, 30], [10, 10])
    at = [F.col("c0"), F.col("c1")]
    return rows.select("linear", chunks.chunk_key(at).alias("v3"), chunks.chunk_key(at, 2).alias("v2"))


@query(
    """SELECT i AS i0, coalesce(label, -9) AS value FROM (SELECT unnest(range(0, (SELECT max(vec_id) + 201 FROM embeddings))) AS i)
       LEFT JOIN embeddings ON vec_id = i"""
)
def unlimited_append_fill(spark, sf_dir):
    n = _vectors(spark, sf_dir)
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.col("label").alias("value"))
    return chunks.fill_missing(df, spark, chunks.resize([n], [True], [n + 200]), ["i0"], "value", -9)


@query("SELECT vec_id, CASE WHEN 60 + 3 <= len(embedding) THEN embedding[61:63] END AS head, NULL::FLOAT[] AS beyond FROM embeddings")
def array_slice_bounds(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", scalars.slice_within(F.col("embedding"), 60, 3).alias("head"), scalars.slice_within(F.col("embedding"), 62, 3).alias("beyond"))


@query(
    """SELECT event_type, count(*) AS total, count(CASE WHEN event_id % 7 <> 0 THEN value END) AS present,
              count(*) - count(CASE WHEN event_id % 7 <> 0 THEN value END) AS nulls,
              count(*) = count(CASE WHEN event_id % 7 <> 0 THEN value END) AS all_valid
       FROM events GROUP BY event_type"""
)
def validity_stats(spark, sf_dir):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count(v).alias("present"), F.count_if(v.isNull()).alias("nulls"), F.bool_and(v.isNotNull()).alias("all_valid")
    )


# --- schemas ----------------------------------------------------------------


@query("SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def project_source_order(spark, sf_dir):
    return schema.project_source_order(table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_orderkey", "l_quantity"])


@query("SELECT p_type, p_partkey, p_size FROM part")
def project_request_order(spark, sf_dir):
    return schema.project_request_order(table(spark, sf_dir, "part"), ["p_type", "p_partkey", "p_size"])


@query(
    """SELECT n_nationkey, n_name, n_regionkey, NULL::INT AS r_regionkey, NULL::VARCHAR AS r_name FROM nation
       UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region"""
)
def schema_merge_union(spark, sf_dir):
    return schema.union_merged(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))


@query("SELECT p_partkey AS part, p_name, p_brand, p_type, p_size::BIGINT AS p_size, NULL::VARCHAR AS note FROM part")
def schema_evolve_widen_rename(spark, sf_dir):
    return schema.evolve(table(spark, sf_dir, "part"), {"p_partkey": "part"}, {"p_size": "long"}, {"note": "string"}, ["p_retailprice"])


_CASTS = "('int',32,true,'int',64,true),('int',64,true,'int',32,true),('int',32,false,'int',64,true),('int',64,false,'int',64,true),('float',32,true,'float',64,true),('float',64,true,'float',32,true),('int',32,true,'float',64,true),('utf8',0,true,'int',32,true),('utf8',0,true,'utf8',0,true)"


@query(
    f"""SELECT ka, ba, kb, bb, CASE WHEN ka = kb AND ba = bb AND sa = sb THEN 'exact'
          WHEN ka = 'int' AND kb = 'int' AND sa = sb AND bb > ba THEN 'lossless'
          WHEN ka = 'float' AND kb = 'float' THEN CASE WHEN bb > ba THEN 'lossless' ELSE 'lossy' END ELSE 'incompatible' END AS verdict
        FROM (VALUES {_CASTS}) AS t(ka, ba, sa, kb, bb, sb)"""
)
def cast_verdicts(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM VALUES {_CASTS} AS t(ka, ba, sa, kb, bb, sb)")
    return rows.select("ka", "ba", "kb", "bb", schema.cast_verdict_column(*[F.col(c) for c in ("ka", "ba", "sa", "kb", "bb", "sb")]).alias("verdict"))


# --- ragged -----------------------------------------------------------------


def _order_lists(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return rows.select("l_orderkey", F.col("x")["l_partkey"].alias("parts"))


@query(
    """SELECT l_orderkey, CAST(sum(count(*)) OVER (ORDER BY l_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
       FROM lineitem GROUP BY l_orderkey"""
)
def ragged_encode(spark, sf_dir):
    return ragged.encode(_order_lists(spark, sf_dir), "l_orderkey", "parts")


@query(
    """SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey"""
)
def ragged_decode(spark, sf_dir):
    lists = _order_lists(spark, sf_dir)
    index = ragged.encode(lists, "l_orderkey", "parts")
    back = ragged.decode(index, ragged.flat_positions(lists, "l_orderkey", "parts", index=index), "l_orderkey")
    return back.select("l_orderkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding) AS value FROM embeddings")
def ragged_flatten(spark, sf_dir):
    return ragged.flatten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(
    """WITH l AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN [] ELSE list(turn ORDER BY turn) END AS v
                  FROM conversations GROUP BY conv_id),
            p AS (SELECT conv_id, v, unnest(range(0, greatest(1, coalesce(len(v), 1))))::INT AS pos FROM l)
       SELECT conv_id, pos, CASE WHEN pos = 0 THEN 0 ELSE 1 END AS rep, CASE WHEN v IS NULL THEN 0 WHEN len(v) = 0 THEN 1 ELSE 2 END AS def,
              v[pos + 1] AS value FROM p"""
)
def dremel_levels(spark, sf_dir):
    turns = F.array_sort(F.collect_list("turn"))
    none, empty = F.lit(None).cast("array<long>"), F.expr("cast(array() as array<long>)")
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    v = F.when(F.col("conv_id") % 5 == 0, none).when(F.col("conv_id") % 5 == 1, empty).otherwise(F.col("t"))
    return ragged.levels(lists.select("conv_id", v.alias("v")), "conv_id", "v")


@query("""SELECT l_linenumber AS "row", l_orderkey AS col, l_quantity AS value FROM lineitem""")
def csc_to_coo(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("col"), "l_linenumber", "l_quantity")
    lists = lines.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    index = ragged.encode(lists, "col", "v")
    entries = ragged.flat_positions(lists, "col", "v", index=index).select("pos", F.col("value.l_linenumber").alias("row"), F.col("value.l_quantity").alias("value"))
    return ragged.csc_to_coo(index, entries)


# --- scalars ----------------------------------------------------------------


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE 5.0 + (event_id) / 1000.0::DOUBLE END AS t FROM events"""
)
def timeseries_axis(spark, sf_dir):
    explicit = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", scalars.sample_time(explicit, F.lit(5.0), F.lit(1000.0), F.col("event_id")).alias("t"))


_TIMES = "('2023-01-15T10:00:00Z'),('2023-01-15T10:00:00+00:00'),('2023-01-15T10:00:00.000000+00:00'),('2023-1-15T10:00:00Z'),('2023-01-15 10:00:00Z'),('9999-99-99T99:99:99-99:99'),('')"


@query(
    f"""SELECT s, regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})') AS valid
        FROM (VALUES {_TIMES}) AS t(s)"""
)
def iso8601_valid(spark, sf_dir):
    return spark.sql(f"SELECT * FROM VALUES {_TIMES} AS t(s)").select("s", scalars.iso8601_valid(F.col("s")).alias("valid"))


_VERSIONS = "('2.0b'),(' 2.6.0'),('2.8.0-alpha'),('1.0'),('2.9'),('')"


@query(f"SELECT s, CASE WHEN regexp_matches(trim(s), '^2\\.[0-8]') THEN left(trim(s), 3) END AS family FROM (VALUES {_VERSIONS}) AS t(s)")
def nwb_version_class(spark, sf_dir):
    return spark.sql(f"SELECT * FROM VALUES {_VERSIONS} AS t(s)").select("s", scalars.nwb_version(F.col("s")).alias("family"))


_NAMES = "('units'),('_FillValue'),('my_note'),('scale_factor'),('9lives'),('long_name')"


@query(
    f"""SELECT s, s IN ('units', '_FillValue', 'scale_factor', 'long_name') AS cf, regexp_full_match(s, '[A-Za-z][A-Za-z0-9_]*') AS name_ok
        FROM (VALUES {_NAMES}) AS t(s)"""
)
def cf_attribute_class(spark, sf_dir):
    s = F.col("s")
    return spark.sql(f"SELECT * FROM VALUES {_NAMES} AS t(s)").select("s", scalars.cf_attribute(s).alias("cf"), scalars.cf_name_valid(s).alias("name_ok"))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_quantity::BIGINT AS quantity FROM lineitem"""
)
def fits_ascii_cell(spark, sf_dir):
    # numbers as they stand in ASCII tables: padded, with D exponents
    text = F.concat(F.lit("  "), F.regexp_replace(F.col("l_extendedprice").cast("string"), "E", "D"), F.when(~F.col("l_extendedprice").cast("string").contains("E"), "D0").otherwise(""), F.lit(" "))
    count = F.lpad(F.col("l_quantity").cast("long").cast("string"), 8, " ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.fits_ascii_number(text).alias("price"), scalars.fits_ascii_integer(count).alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END AS flag FROM lineitem")
def dictionary_decode(spark, sf_dir):
    index = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(9)
    words = F.array(F.lit("accepted"), F.lit("none"), F.lit("returned"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.dictionary_value(words, index).alias("flag"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE (c_nationkey * 0.5 + 10)::DOUBLE END AS physical FROM customer")
def physical_scaling(spark, sf_dir):
    raw = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.scaled(raw, F.lit(0.5), F.lit(10.0), F.lit(3)).alias("physical"))


_TYPES = "('TimeSeries','NWBDataInterface'),('ElectricalSeries','TimeSeries'),('SpikeSeries','ElectricalSeries'),('A','B'),('B','A'),('NWBDataInterface',NULL)"


@query(
    """SELECT * FROM (VALUES ('TimeSeries', 0), ('ElectricalSeries', 1), ('SpikeSeries', 2)) AS t(name, depth)"""
)
def type_ancestor(spark, sf_dir):
    types = spark.sql(f"SELECT * FROM VALUES {_TYPES} AS t(name, parent)")
    return scalars.descends_from(types, "TimeSeries")


# --- catalogs ---------------------------------------------------------------


def _nodes(spark, sf_dir) -> DataFrame:
    """Regions hold nations, which hold customers; every order is a soft link, most to
    its customer, some to another order, to nowhere or to an external node."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("/r"), "r_regionkey").alias("path"), F.lit("/").alias("parent"), F.lit("group").alias("node_type"))
    nation = table(spark, sf_dir, "nation")
    home = nation.select("n_nationkey", F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("home"), F.concat(F.lit("/r"), "n_regionkey").alias("up"))
    customer = table(spark, sf_dir, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    at = customer.select("c_custkey", F.concat("home", F.lit("/c"), "c_custkey").alias("at"), "home")
    nodes = region.union(home.select("home", "up", F.lit("group"))).union(at.select("at", "home", F.lit("dataset")))
    nodes = nodes.select("path", "parent", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "node_type", F.lit("hard").alias("link_type"), F.lit(None).cast("string").alias("target"))
    orders = table(spark, sf_dir, "orders").join(at, F.col("o_custkey") == F.col("c_custkey"), "left")
    key = F.col("o_orderkey")
    to = F.when(key % 10 == 0, "/nowhere").when(key % 10 == 1, "ext").when(key % 10 == 2, F.concat(F.lit("o"), key)).otherwise(F.col("at"))
    links = orders.select(F.concat(F.lit("/o"), key).alias("path"), F.lit("/").alias("parent"), F.concat(F.lit("o"), key).alias("name"), F.lit("link"), F.lit("soft"), to)
    fixed = spark.createDataFrame([("/", None, "", "group", "hard", None), ("/ext", "/", "ext", "link", "external", "other.h5")], nodes.schema)
    return fixed.union(nodes).union(links)


@query(
    """SELECT '/o' || o_orderkey AS path, CASE WHEN o_orderkey % 10 = 1 THEN '/ext' WHEN o_orderkey % 10 IN (0, 2) OR c_custkey IS NULL THEN NULL
              ELSE '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey END AS resolved,
            (CASE WHEN o_orderkey % 10 = 2 THEN 40 WHEN o_orderkey % 10 > 2 AND c_custkey IS NULL THEN 0 ELSE 1 END)::BIGINT AS hops,
            CASE WHEN o_orderkey % 10 = 0 THEN 'dangling' WHEN o_orderkey % 10 = 1 THEN 'external' WHEN o_orderkey % 10 = 2 THEN 'too_long'
              WHEN c_custkey IS NULL THEN 'too_long' ELSE 'ok' END AS status
       FROM orders LEFT JOIN (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) ON o_custkey = c_custkey"""
)
def soft_link_resolve(spark, sf_dir):
    return catalog.resolve_links(_nodes(spark, sf_dir))


@query(
    """SELECT '/' AS path, (SELECT count(*) FROM region) + (SELECT count(*) FROM orders) + 1 AS n
       UNION ALL SELECT '/r' || r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) FROM region
       UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) FROM nation"""
)
def group_children(spark, sf_dir):
    return catalog.child_counts(_nodes(spark, sf_dir)).select("path", F.col("n").cast("long").alias("n"))


@query(
    """SELECT 'v' || c_custkey AS variable, '/r' || n_regionkey || '/n' || n_nationkey AS "group", d AS dim,
            CASE WHEN d = 'z' THEN NULL WHEN d = 'y' AND n_nationkey % 2 = 0 THEN '/r' || n_regionkey || '/n' || n_nationkey
              WHEN d = 'x' AND n_regionkey % 2 = 0 THEN '/r' || n_regionkey WHEN d = 'y' THEN NULL ELSE '/' END AS scope,
            CASE WHEN d = 'z' THEN NULL WHEN d = 'y' AND n_nationkey % 2 = 0 THEN 1000 + n_nationkey
              WHEN d = 'x' AND n_regionkey % 2 = 0 THEN 100 + n_regionkey WHEN d = 'y' THEN NULL ELSE 7 END::BIGINT AS size
       FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT unnest(['x', 'y', 'z']) AS d)"""
)
def dimension_scope(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("group", F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey"))
    region = table(spark, sf_dir, "region").where("r_regionkey % 2 = 0")
    dims = spark.createDataFrame([("/", "x", 7)], "group string, name string, size long")
    dims = dims.union(region.select(F.concat(F.lit("/r"), "r_regionkey"), F.lit("x"), F.col("r_regionkey").cast("long") + 100))
    dims = dims.union(nation.where("n_nationkey % 2 = 0").select("group", F.lit("y"), F.col("n_nationkey").cast("long") + 1000))
    uses = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    uses = uses.select(F.concat(F.lit("v"), "c_custkey").alias("variable"), "group", F.explode(F.array(*[F.lit(d) for d in "xyz"])).alias("dim"))
    return catalog.dimension_scope(uses, dims)


@query("SELECT 'v' || o_orderkey AS variable, k::INT AS axis, CASE WHEN k = 1 OR o_custkey % 4 = 0 THEN 'd' || k ELSE 'c' || o_custkey END AS name FROM orders, (SELECT unnest([0, 1]) AS k)")
def dimension_scale_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), "o_orderkey").alias("variable"), "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("axis"))
    uses = orders.select("variable", "axis", F.when(F.col("axis") == 0, F.col("o_custkey")).alias("scale"))
    scales = table(spark, sf_dir, "orders").where("o_custkey % 4 <> 0").select(F.col("o_custkey").alias("scale"), F.concat(F.lit("c"), "o_custkey").alias("name")).distinct()
    return catalog.dimension_names(uses, scales)


@query(
    """SELECT * FROM (VALUES ('/', 'missing_attribute', 'identifier'), ('/', 'empty_attribute', 'session_description'),
         ('/', 'invalid_time', '2023-01-15 10:00:00'), ('/analysis', 'missing_group', '/analysis'), ('/stimulus', 'missing_group', '/stimulus'),
         ('/acquisition/bare', 'missing_type', '/acquisition/bare'), ('/acquisition/ts', 'missing_data', '/acquisition/ts'),
         ('/general/t', 'missing_column', 'b')) AS t(path, kind, detail)"""
)
def nwb_violations(spark, sf_dir):
    groups = ["/acquisition", "/processing", "/general", "/acquisition/bare", "/acquisition/ts", "/general/t"]
    rows = [(g, g.rpartition("/")[0] or "/", g.rpartition("/")[2], "group") for g in groups] + [("/general/t/a", "/general/t", "a", "dataset")]
    nodes = spark.createDataFrame(rows, "path string, parent string, name string, node_type string")
    attributes = spark.createDataFrame(
        [
            ("/", "session_description", ""), ("/", "session_start_time", "2023-01-15 10:00:00"),
            ("/acquisition/ts", "neurodata_type", "TimeSeries"), ("/general/t", "neurodata_type", "DynamicTable"), ("/general/t", "colnames", "a, b"),
        ],
        "path string, name string, value string",
    )
    return validate.session_file(nodes, attributes)


@query(
    """SELECT * FROM (VALUES ('/g', 'duplicate_dimension', 'x'), ('v2', 'rank_mismatch', '2'), ('v3', 'unresolved_dimension', 'q')) AS t(path, kind, detail)"""
)
def netcdf_model_violations(spark, sf_dir):
    dims = spark.createDataFrame([("/", "t", 3), ("/g", "x", 1), ("/g", "x", 2)], "group string, name string, size long")
    uses = spark.createDataFrame([("v1", "/g", 2, ["t", "x"]), ("v2", "/g", 2, ["t"]), ("v3", "/", 1, ["q"])], "variable string, group string, rank int, dims array<string>")
    return validate.dimension_model(dims, uses)


@query(
    """WITH i AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
            e AS (SELECT o_custkey, sum(n) OVER (ORDER BY o_custkey) - CASE WHEN o_custkey % 50 = 0 THEN 1000000 ELSE 0 END AS e FROM i),
            p AS (SELECT o_custkey, e, lag(e, 1, 0) OVER (ORDER BY o_custkey) AS q FROM e)
       SELECT o_custkey, 'not monotone' AS violation FROM p WHERE e < q
       UNION ALL SELECT arg_max(o_custkey, o_custkey), 'last end differs from the flat length' FROM e
       HAVING arg_max(e, o_custkey) <> (SELECT count(*) FROM orders)"""
)
def table_invariants(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    index = ragged.prefix_sum(counts, "o_custkey", F.col("n"), "end")
    broken = index.select("o_custkey", (F.col("end") - F.when(F.col("o_custkey") % 50 == 0, 1000000).otherwise(0)).alias("end"))
    return ragged.index_violations(broken, "o_custkey", "end", table(spark, sf_dir, "orders").count())


_HEADERS = "('f',0,0,'SIMPLE','T'),('f',0,1,'BITPIX','8'),('f',0,2,'NAXIS','0'),('f',0,3,'END',NULL),('f',1,0,'XTENSION','BINTABLE'),('f',1,1,'BITPIX','7'),('f',1,2,'NAXIS','2'),('f',1,3,'NAXIS1','4'),('f',1,4,'END',NULL),('g',0,0,'BITPIX','16'),('g',0,1,'NAXIS','0')"


@query(
    """SELECT * FROM (VALUES ('f#1', 'bitpix', '7'), ('f#1', 'axes', '1'), ('g#0', 'first_card', 'BITPIX'), ('g#0', 'no_end', 'NAXIS')) AS t(path, kind, detail)"""
)
def fits_header_violations(spark, sf_dir):
    return validate.header_cards(spark.sql(f"SELECT * FROM VALUES {_HEADERS} AS t(file, hdu, ord, keyword, value)"))


_VALUES = "('42'),('-1.5D2'),('(1.5, -2)'),('T'),('abc'),('')"


@query(
    """SELECT * FROM (VALUES ('42', 42::BIGINT, 42.0::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN), ('-1.5D2', NULL, -150.0, NULL, NULL), ('(1.5, -2)', NULL, NULL, -2.0, NULL),
         ('T', NULL, NULL, NULL, TRUE), ('abc', NULL, NULL, NULL, NULL), ('', NULL, NULL, NULL, NULL)) AS t(s, i, f, im, b)"""
)
def fits_header_values(spark, sf_dir):
    s = F.col("s")
    rows = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(s)")
    return rows.select("s", scalars.header_integer(s).alias("i"), scalars.header_float(s).alias("f"), scalars.header_complex(s)["im"].alias("im"), scalars.header_logical(s).alias("b"))


@query("SELECT 0::BIGINT AS violations, count(*) AS n_rows FROM lineitem")
def parquet_row_group_checks(spark, sf_dir):
    facts = files.parquet_facts(spark, f"{sf_dir}/lineitem.parquet")
    bad = validate.row_groups(facts).groupBy().agg(F.count("*").alias("violations"))
    total = facts.where(F.col("column") == "l_orderkey").agg(F.sum("rows").alias("n_rows"))
    return bad.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k").drop("k")


# --- stores and codecs ------------------------------------------------------


def _scratch(spark) -> str:
    return f"{scratch_folder(spark)}/array-{uuid.uuid4().hex}"


@query("SELECT vec_id AS i0, p AS i1, embedding[p + 1] AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS p) WHERE vec_id % 7 < 3 AND p >= 5 AND p < 45")
def zarr_roundtrip(spark, sf_dir):
    n = _vectors(spark, sf_dir)
    df, path = _embeddings(spark, sf_dir).withColumn("i1", F.col("i1").cast("long")), _scratch(spark)
    zarr.write_array(df, path, zarr.ArrayMeta(3, (n + 7, 64), (128, 24), "<f4", "NaN", steps=({"name": "zstd"},)))
    slab = Hyperslab((Dim(0, 7, n // 7 + 1, 3), Dim(5, 1, 40, 1)))
    return zarr.read_array(spark, path, slab).where(F.col("i0") < n)


@query("SELECT vec_id AS i0, CASE WHEN vec_id // 64 % 3 = 2 THEN -1 ELSE label END AS value FROM embeddings")
def zarr_missing_chunks(spark, sf_dir):
    n, path = _vectors(spark, sf_dir), _scratch(spark)
    df = table(spark, sf_dir, "embeddings").where("vec_id div 64 % 3 <> 2").select(F.col("vec_id").alias("i0"), F.col("label").alias("value"))
    zarr.write_array(df, path, zarr.ArrayMeta(2, (n,), (64,), ">i4", -1, separator=".", steps=({"name": "shuffle", "elementsize": 4}, {"name": "zlib"})))
    return zarr.read_array(spark, path)


@query("SELECT o_orderkey, o_comment_bytes, ok FROM (SELECT o_orderkey, octet_length(encode(o_orderstatus || o_orderpriority)) AS o_comment_bytes, TRUE AS ok FROM orders)")
def codec_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", "o_orderpriority").cast("binary").alias("data"))

    def check(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        steps = [{"name": "shuffle", "elementsize": 4}, {"name": "zstd"}, {"name": "gzip"}, {"name": "crc32c"}]
        for b in batches:
            data = b.column("data")
            ok = codecs.each_distinct(data, lambda x: codecs.apply(codecs.apply(x, steps, True), steps, False) == x).cast(pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("o_orderkey"), pc.binary_length(data).cast(pa.int64()), ok], ["o_orderkey", "o_comment_bytes", "ok"])

    return rows.mapInArrow(check, "o_orderkey long, o_comment_bytes long, ok boolean")


@query("SELECT * FROM (VALUES ('123456789', 3421780262, 3808858755, 3741963529)) AS t(s, crc32, crc32c, fletcher32)")
def checksum_vectors(spark, sf_dir):
    s = F.col("s").cast("binary")
    rows = spark.sql("SELECT '123456789' AS s")
    return rows.select("s", *[codecs.checksum(s, k).alias(k) for k in ("crc32", "crc32c", "fletcher32")])


@query("SELECT vec_id AS i0, label::DOUBLE AS value FROM embeddings")
def npy_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("value"))
    rows, path = df.select(F.floor(F.col("i") / 256).alias("part"), (F.col("i") % 256).alias("i0"), "value"), _scratch(spark)

    def pack(frame):
        import pandas as pd

        content = files.npy_bytes(frame, (int(frame["i0"].max()) + 1,), "<f8")
        return pd.DataFrame({"key": [f"part-{frame['part'].iloc[0]}.npy"], "content": [content]})

    zarr.put_objects(rows.groupBy("part").applyInPandas(pack, "key string, content binary"), path)  # a file for every 256 values
    part = F.regexp_extract("file", r"part-([0-9]+)\.npy$", 1).cast("long")
    return files.read_npy(spark, path, "<f8", 1).select((part * 256 + F.col("i0")).alias("i0"), "value")


@query("SELECT n_nationkey::BIGINT AS \"row\", n_nationkey AS k, n_regionkey::DOUBLE AS v FROM nation WHERE n_nationkey BETWEEN 3 AND 11")
def fits_table_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("double").alias("v"))
    path = _scratch(spark)

    def pack(frame):
        import pandas as pd

        return pd.DataFrame({"key": ["nation.fits"], "content": [files.fits_table_bytes([("k", "J"), ("v", "D")], frame.sort_values("k"))]})

    zarr.put_objects(rows.groupBy().applyInPandas(pack, "key string, content binary"), path)  # the nation table has 25 rows
    return files.read_fits_table(spark, f"{path}/nation.fits", rows=(3, 12))


@query("SELECT 'nation' AS name, count(*) AS n_rows, 3::BIGINT AS n_columns FROM nation")
def parquet_footer_facts(spark, sf_dir):
    facts = files.parquet_facts(spark, f"{sf_dir}/nation.parquet")
    per_group = facts.groupBy("file", "row_group").agg(F.first("rows").alias("rows"), F.count("*").alias("n"))
    return per_group.agg(F.lit("nation").alias("name"), F.sum("rows").alias("n_rows"), F.max("n").alias("n_columns"))


from . import store_queries  # noqa: E402, F401  (registers its queries here)
