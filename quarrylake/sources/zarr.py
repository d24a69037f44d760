"""Chunked array stores (Zarr versions 2 and 3) as DataFrames.

One object holds one chunk, so a store maps onto Spark's own file source: array
metadata is read with ``spark.read`` (any path Spark can open), chunks with
``binaryFile``, and decoding is a per-row step in Arrow batches.  A selection
becomes a path pattern of the chunks that it touches, so no other object is opened.  Missing chunks are filled from the
grid, and writing is one task per group of chunks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat, NotFound, UnsupportedFeature
from ..functions import codecs, dtypes
from ..operators import chunks as grid
from ..operators.selection import ALL, Hyperslab, Points, Selection, select, validate
from ..plans.cut import checkpointed


@dataclass(frozen=True)
class ArrayMeta:
    """What a store says about one array."""

    version: int
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    fill: object = 0
    order: str = "C"
    separator: str = "/"
    steps: tuple[dict, ...] = field(default=())
    #: Shape of the inner chunks where one object (shard) holds several; ``chunk`` is then
    #: the shard's shape and ``steps`` are the inner chunks'.
    inner: tuple[int, ...] | None = None
    index_checksum: bool = False

    @property
    def coords(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]


def parse_v2(text: str) -> ArrayMeta:
    m = json.loads(text)
    if m.get("zarr_format") != 2:
        raise InvalidFormat("not version 2")
    # filters run before the compressor
    found = [*(m.get("filters") or []), *([m["compressor"]] if m.get("compressor") else [])]
    steps = [{"name": f["id"], **{k: v for k, v in f.items() if k != "id"}} for f in found]
    return ArrayMeta(2, tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], m.get("fill_value"), m.get("order", "C"), m.get("dimension_separator", "."), tuple(steps))


def parse_v3(text: str) -> ArrayMeta:
    m = json.loads(text)
    if m.get("zarr_format") != 3 or m.get("node_type") != "array":
        raise InvalidFormat("not a version 3 array")
    dtype, steps, order, inner, checksum = dtypes.parse(m["data_type"])[0], [], "C", None, False
    listed = m.get("codecs", [])
    if any(c["name"] == "sharding_indexed" for c in listed):
        if len(listed) != 1 or listed[0]["configuration"].get("index_location", "end") != "end":
            raise UnsupportedFeature("codecs around shards, or an index at the start")
        conf = listed[0]["configuration"]
        inner, listed = tuple(conf["chunk_shape"]), conf.get("codecs", [])
        checksum = any(c["name"] == "crc32c" for c in conf.get("index_codecs", []))
    for c in listed:
        name, conf = c["name"], c.get("configuration", {})
        if name == "bytes":
            endian = conf.get("endian", "little")
            if endian not in ("little", "big"):
                raise UnsupportedFeature(f"endian {endian!r}")
            dtype = (">" if endian == "big" else "<") + dtype[1:] if dtype[0] != "|" else dtype
        elif name == "transpose":
            if list(conf["order"]) == list(range(len(m["shape"])))[::-1]:
                order = "F"
            elif list(conf["order"]) != list(range(len(m["shape"]))):
                raise UnsupportedFeature("general transpose")
        else:
            steps.append({**conf, "name": name})
    key = m.get("chunk_key_encoding", {"name": "default"})
    separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
    version = 3 if key["name"] == "default" else 2
    return ArrayMeta(version, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), dtype, m.get("fill_value"), order, separator, tuple(steps), inner, checksum)


def _read_text(spark: SparkSession, path: str) -> str | None:
    """One small file through Hadoop's file systems, as Spark's own sources skip names
    that begin with a dot; None if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_meta(spark: SparkSession, path: str) -> ArrayMeta:
    """Metadata of the array at ``path``; works wherever Spark can read."""
    for name, parse in (("zarr.json", parse_v3), (".zarray", parse_v2)):
        if (text := _read_text(spark, f"{path}/{name}")) is not None:
            return parse(text)
    raise NotFound(f"no array at {path}")


def consolidated(text: str) -> dict[str, dict]:
    """path -> {"kind": array | group, "meta": ...} of consolidated metadata."""
    m = json.loads(text)
    out: dict[str, dict] = {}
    if "consolidated_metadata" in m:  # version 3
        for p, x in m["consolidated_metadata"]["metadata"].items():
            out["/" + p.strip("/")] = {"kind": x["node_type"], "meta": x}
        return out
    for key, x in m.get("metadata", {}).items():
        p, _, name = key.rpartition("/")
        if name in (".zarray", ".zgroup"):
            out["/" + p] = {"kind": "array" if name == ".zarray" else "group", "meta": x}
    return out


def _fill(meta: ArrayMeta):
    value = meta.fill
    if isinstance(value, str):
        named = {"NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
        return named.get(value, float("nan") if "f" in meta.dtype else 0)
    return 0 if value is None else value


def _block(raw, meta, shape, edge):
    """Values of one stored chunk; chunks at the edge are whole, or clipped by some writers."""
    import numpy as np

    kind = np.dtype(meta.dtype)
    values = np.frombuffer(codecs.apply(raw, list(meta.steps), False, prod(shape) * kind.itemsize), kind)
    return values.reshape(shape if len(values) == prod(shape) else edge, order=meta.order)


def _shard(raw, meta):
    """Values of one shard: inner chunks found by the (offset, length) pairs at its end,
    where all ones mean that a chunk is not stored."""
    import numpy as np

    n = [s // c for s, c in zip(meta.chunk, meta.inner, strict=True)]
    tail = 16 * prod(n) + 4 * meta.index_checksum
    index = raw[-tail:]
    if meta.index_checksum:
        index = codecs.apply(index, [{"name": "crc32c"}], False)
    pairs = np.frombuffer(index, "<u8").reshape(-1, 2)
    out = np.full(meta.chunk, _fill(meta), np.dtype(meta.dtype))
    for k, (at, length) in enumerate(pairs.tolist()):
        if at != 2**64 - 1:
            place = np.unravel_index(k, n)
            out[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, meta.inner, strict=True))] = _block(raw[at : at + length], meta, meta.inner, meta.inner)
    return out


def _decode(batches, meta, known):
    import numpy as np
    import pyarrow as pa

    kind = np.dtype(meta.dtype)
    for b in batches:
        for row in b.to_pylist():
            edge = [row[f"e{k}"] for k in range(len(meta.chunk))]
            raw = bytes(row["content"])
            block = (_shard(raw, meta) if meta.inner else _block(raw, meta, meta.chunk, edge))[tuple(slice(0, e) for e in edge)]
            at = np.indices(edge).reshape(len(edge), -1)
            cols = [pa.array(at[k] + row[f"o{k}"], pa.int64()) for k in range(len(edge))]
            data = block.reshape(-1).astype(kind.newbyteorder("="))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(data).cast(known.field("value").type)], names=[*meta.coords, "value"])


#: Chunk coordinates of a dimension are listed in a read's pattern up to so many.
MAX_LISTED = 4096


def _objects(spark: SparkSession, path: str, meta: ArrayMeta, selection: Selection) -> DataFrame:
    """(key, content) of the stored objects that a selection can touch.

    The pattern names the touched chunk coordinates of each dimension, so other objects
    are neither listed as input nor opened.
    """
    parts = []
    for at in grid.touched(selection, meta.shape, meta.chunk):
        if at is not None and not at:
            return spark.createDataFrame([], "key string, content binary")
        parts.append("*" if at is None or len(at) > MAX_LISTED else str(at[0]) if len(at) == 1 else "{" + ",".join(map(str, at)) + "}")
    prefix = ["c"] if meta.version == 3 else []
    pattern = meta.separator.join([*prefix, *parts]) or "0"
    try:
        files = spark.read.format("binaryFile").load(f"{path}/{pattern}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, content binary")
    digits = r"[0-9]+(?:[./][0-9]+)*" if parts else "0?"
    key = "c(?:[./]" + digits + ")?" if meta.version == 3 else digits
    tail = F.regexp_extract("path", re.escape(path.rstrip("/").rsplit("/", 1)[-1]) + "/(" + key + ")$", 1)
    return files.withColumn("key", tail).where("key <> ''").select("key", "content")


def read_array(spark: SparkSession, path: str, selection: Selection = ALL, fill_missing: bool = True) -> DataFrame:
    """Long form (i0..iN, value) of the selected elements.

    Only touched chunks are read.  Elements of missing chunks get the fill value, or no
    row where ``fill_missing`` is off.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    meta = read_meta(spark, path)
    validate(selection, meta.shape)
    table = grid.chunk_table(spark, meta.shape, meta.chunk)
    if isinstance(selection, Hyperslab):
        table = grid.prune(table, selection, meta.chunk)
    for k, at in enumerate(grid.touched(selection, meta.shape, meta.chunk) if isinstance(selection, Points) else []):
        table = table.where(F.col(f"c{k}").isin(at))
    key = grid.chunk_key([F.col(f"c{k}") for k in range(len(meta.shape))], meta.version, meta.separator)
    table = table.withColumn("key", key)
    files = _objects(spark, path, meta, selection)
    schema = StructType()
    for c in meta.coords:
        schema = schema.add(c, LongType())
    schema = schema.add("value", dtypes.parse(meta.dtype)[1])
    known = to_arrow_schema(schema)
    found = table.join(files, "key")
    out = found.drop("key", "linear", *[f"c{k}" for k in range(len(meta.shape))]).mapInArrow(lambda it: _decode(it, meta, known), schema)
    if fill_missing:
        # generate elements only for chunks that are not stored
        lost = table.join(files.select("key"), "key", "left_anti")
        for k in range(len(meta.shape)):
            lost = lost.withColumn(f"i{k}", F.explode(F.sequence(F.col(f"o{k}"), F.col(f"o{k}") + F.col(f"e{k}") - 1)))
        out = out.union(lost.select(*meta.coords, F.lit(_fill(meta)).cast(schema["value"].dataType).alias("value")))
    return select(out, meta.coords, selection)


def _metadata_json(meta: ArrayMeta) -> tuple[str, str]:
    if meta.version == 2:
        filters = [{"id": s["name"], **{k: v for k, v in s.items() if k != "name"}} for s in meta.steps]
        shuffles = [f for f in filters if f["id"] == "shuffle"]
        packers = [f for f in filters if f["id"] != "shuffle"]
        return ".zarray", json.dumps({
            "zarr_format": 2, "shape": list(meta.shape), "chunks": list(meta.chunk), "dtype": meta.dtype, "fill_value": meta.fill,
            "order": meta.order, "dimension_separator": meta.separator, "filters": shuffles or None, "compressor": packers[0] if packers else None,
        })
    name = dtypes.CODES[meta.dtype[1:]][0]
    order = [{"name": "transpose", "configuration": {"order": list(range(len(meta.shape)))[::-1]}}] if meta.order == "F" else []
    steps = [{"name": s["name"], "configuration": {k: v for k, v in s.items() if k != "name"}} for s in meta.steps]
    endian = {"name": "bytes", "configuration": {"endian": "big" if meta.dtype[0] == ">" else "little"}}
    listed = [*order, endian, *steps]
    if meta.inner:
        index = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": "crc32c"}] if meta.index_checksum else [])]
        listed = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(meta.inner), "codecs": listed, "index_codecs": index, "index_location": "end"}}]
    return "zarr.json", json.dumps({
        "zarr_format": 3, "node_type": "array", "shape": list(meta.shape), "data_type": name, "fill_value": meta.fill,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(meta.chunk)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": meta.separator}}, "codecs": listed, "attributes": {},
    })


def _encode(frame, meta):
    import numpy as np

    values = np.full(meta.chunk, _fill(meta), np.dtype(meta.dtype))
    at = tuple(frame[f"p{k}"].to_numpy() for k in range(len(meta.chunk)))
    values[at] = frame["value"].to_numpy()
    if meta.inner:
        return _encode_shard(values, meta)
    return codecs.apply(values.tobytes(order=meta.order), list(meta.steps), True)


def _encode_shard(values, meta):
    import numpy as np

    n = [s // c for s, c in zip(meta.chunk, meta.inner, strict=True)]
    body, pairs = b"", []
    for place in np.ndindex(*n):
        part = values[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, meta.inner, strict=True))]
        data = codecs.apply(part.tobytes(order=meta.order), list(meta.steps), True)
        pairs.append((len(body), len(data)))
        body += data
    index = np.array(pairs, "<u8").tobytes()
    return body + (codecs.apply(index, [{"name": "crc32c"}], True) if meta.index_checksum else index)


def encode_chunks(df: DataFrame, meta: ArrayMeta) -> DataFrame:
    """One row (key, content) per chunk that has at least one element.

    Elements are grouped by chunk; a chunk's elements are bounded by the chunk shape.
    """
    n = len(meta.shape)
    rows = grid.of_elements(df.select(*meta.coords, "value"), meta.coords, meta.chunk)
    key = grid.chunk_key([F.col(f"c{k}") for k in range(n)], meta.version, meta.separator)
    rows = rows.select(key.alias("key"), *[f"p{k}" for k in range(n)], "value")

    def pack(frame):
        import pandas as pd

        return pd.DataFrame({"key": [frame["key"].iloc[0]], "content": [_encode(frame, meta)]})

    return rows.groupBy("key").applyInPandas(pack, "key string, content binary")


def _put(batches, path):
    """Writes (key, content) rows as objects of a store: each under a hidden name first,
    then renamed, so that a reader or a task that runs again never sees half an object."""
    import uuid

    from pyarrow import fs

    local = path.removeprefix("file://").removeprefix("file:")
    store, root = fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)
    for b in batches:
        for row in b.to_pylist():
            target = f"{root}/{row['key']}"
            folder, _, name = target.rpartition("/")
            store.create_dir(folder, recursive=True)
            hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as f:
                f.write(row["content"])
            try:
                store.move(hidden, target)
            except OSError:  # some stores do not replace
                store.delete_file(target)
                store.move(hidden, target)
        yield b.select(["key"])


def put_objects(objects: DataFrame, path: str) -> int:
    """Writes rows (key, content) as files below ``path``, by the tasks; their number."""
    return objects.select("key", "content").mapInArrow(lambda it: _put(it, path), "key string").count()


def write_array(df: DataFrame, path: str, meta: ArrayMeta) -> None:
    """Writes a long-form array as one object per chunk, and then its metadata.

    Objects are written by the tasks through pyarrow's file systems (local paths and
    the URIs they know).  The metadata comes last, so that a shape never promises
    chunks that are still to be written.
    """
    put_objects(encode_chunks(df, meta), path)
    name, text = _metadata_json(meta)
    put_objects(df.sparkSession.createDataFrame([(name, bytearray(text.encode()))], "key string, content binary"), path)


def update_selection(spark: SparkSession, path: str, patch: DataFrame) -> DataFrame:
    """Read-modify-write: all elements of the chunks that ``patch`` touches, with the
    patch's values where it has any, also beyond the stored shape.

    Only objects in the patch's bounding box of chunks are read.  The rows are stored
    in the checkpoint folder before they are returned, so they do not change when
    ``write_array`` replaces those objects.
    """
    meta = read_meta(spark, path)
    if meta.inner:
        raise UnsupportedFeature("partial writes into shards")
    at = [f"c{k}" for k in range(len(meta.shape))]
    rows = grid.of_elements(patch.select(*meta.coords, "value"), meta.coords, meta.chunk)
    ends = rows.agg(*[f(c) for c in at for f in (F.min, F.max)]).first()
    new = patch.select(*meta.coords, F.col("value").alias("_new"))
    if ends[0] is None:
        return patch.select(*meta.coords, "value")
    start = [lo * c for lo, c in zip(ends[::2], meta.chunk, strict=True)]
    stop = [min((hi + 1) * c, n) for hi, c, n in zip(ends[1::2], meta.chunk, meta.shape, strict=True)]
    if any(a >= b for a, b in zip(start, stop, strict=True)):
        return checkpointed(patch.select(*meta.coords, "value"))
    old = read_array(spark, path, Hyperslab.contiguous(start, [b - a for a, b in zip(start, stop, strict=True)]))
    old = grid.of_elements(old, meta.coords, meta.chunk).join(rows.select(*at).distinct(), at, "left_semi")
    return checkpointed(old.select(*meta.coords, "value").join(new, meta.coords, "full").select(*meta.coords, F.coalesce("_new", "value").alias("value")))
