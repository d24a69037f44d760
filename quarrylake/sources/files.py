"""Small binary files as DataFrames: NPY arrays, FITS headers and tables, and the
facts of Parquet footers.

Files are listed and read by Spark's ``binaryFile`` source; a decoder turns each
file's bytes into Arrow batches inside a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat, UnsupportedFeature
from ..functions import dtypes
from ..operators.selection import ALL, Selection, select, validate

BLOCK, CARD = 2880, 80
NPY_TYPES = ("<f4", "<f8", "<i4", "<i8")


# --- NPY --------------------------------------------------------------------


def read_npy(spark: SparkSession, path: str, dtype: str, ndim: int) -> DataFrame:
    """Rows (file, i0..iN, value) of NPY files with the declared type and rank."""
    if dtype not in NPY_TYPES:
        raise UnsupportedFeature(f"NPY type {dtype}")
    value = dtypes.parse(dtype)[1].simpleString()
    coords = [f"i{k}" for k in range(ndim)]

    def decode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                a = np.load(io.BytesIO(bytes(row["content"])), allow_pickle=False)
                if a.dtype.str != dtype or a.ndim != ndim:
                    raise InvalidFormat(f"{row['path']}: {a.dtype.str} of rank {a.ndim}")
                at = np.indices(a.shape).reshape(ndim, -1)
                cols = [pa.array(at[k], pa.int64()) for k in range(ndim)]
                names = pa.array([row["path"]] * a.size, pa.string())
                yield pa.RecordBatch.from_arrays([names, *cols, pa.array(np.ascontiguousarray(a).reshape(-1))], ["file", *coords, "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, " + "".join(f"{c} long, " for c in coords) + f"value {value}")


def read_npz(spark: SparkSession, path: str, name: str, dtype: str, ndim: int) -> DataFrame:
    """Rows (file, i0..iN, value) of one named array of NPZ archives; archives without it
    give no rows."""
    value = dtypes.parse(dtype)[1].simpleString()
    coords = [f"i{k}" for k in range(ndim)]

    def decode(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                with np.load(io.BytesIO(bytes(row["content"])), allow_pickle=False) as z:
                    if name not in z.files:
                        continue
                    a = z[name]
                if a.dtype.str != dtype or a.ndim != ndim:
                    raise InvalidFormat(f"{row['path']}: {a.dtype.str} of rank {a.ndim}")
                at = np.indices(a.shape).reshape(ndim, -1)
                names = pa.array([row["path"]] * a.size, pa.string())
                values = pa.array(np.ascontiguousarray(a).reshape(-1))
                yield pa.RecordBatch.from_arrays([names, *[pa.array(at[k], pa.int64()) for k in range(ndim)], values], ["file", *coords, "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, " + "".join(f"{c} long, " for c in coords) + f"value {value}")


def npy_bytes(frame, shape, dtype):
    """NPY content (row-major) of long-form rows held in pandas."""
    import io

    import numpy as np

    a = np.zeros(shape, dtype)
    a[tuple(frame[f"i{k}"].to_numpy() for k in range(len(shape)))] = frame["value"].to_numpy()
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def npz_bytes(arrays: dict) -> bytes:
    """NPZ content of named numpy arrays."""
    import io

    import numpy as np

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


# --- FITS -------------------------------------------------------------------


def read_fits_cards(spark: SparkSession, path: str) -> DataFrame:
    """Header cards (file, hdu, ord, keyword, value, comment, data_at) of FITS files.

    Bytes are cut to 80-character cards in tasks; the value grammar is SQL.
    """

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                raw, rows = bytes(row["content"]), []
                at = hdu = 0
                while at < len(raw):
                    start, cards = at, []
                    while True:
                        card = raw[at : at + CARD]
                        if len(card) < CARD:
                            raise InvalidFormat(f"{row['path']}: header without END")
                        at += CARD
                        cards.append(card.decode("ascii"))
                        if card[:8].rstrip() == b"END":
                            break
                    at = start + -(-(at - start) // BLOCK) * BLOCK
                    rows += [(row["path"], hdu, k, c, at) for k, c in enumerate(cards)]
                    at += _padded(_data_bytes(cards))
                    hdu += 1
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["file", "hdu", "ord", "card", "data_at"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cards = files.mapInArrow(cut, "file string, hdu long, ord long, card string, data_at long")
    quoted = F.regexp_extract("card", r"^.{8}= *'((?:[^']|'')*)'", 1)
    plain = F.regexp_extract("card", r"^.{8}= *([^' /][^/]*)", 1)
    value = F.when(F.col("card").rlike("^.{8}= *'"), F.rtrim(F.regexp_replace(quoted, "''", "'"))).otherwise(F.nullif(F.trim(plain), F.lit("")))
    comment = F.regexp_extract("card", r"^.{8}= *(?:'(?:[^']|'')*'|[^'/]*) */ ?(.*)$", 1)
    keyword = F.rtrim(F.substring("card", 1, 8))
    return cards.select("file", "hdu", "ord", keyword.alias("keyword"), value.alias("value"), F.nullif(F.rtrim(comment), F.lit("")).alias("comment"), "data_at")


def _card_int(cards, name, default=0):
    for c in cards:
        if c[:8].rstrip() == name and c[8:10] == "= ":
            return int(c[10:].split("/")[0])
    return default


def _data_bytes(cards) -> int:
    axes = [_card_int(cards, f"NAXIS{k + 1}") for k in range(_card_int(cards, "NAXIS"))]
    n = 1 if axes else 0
    for a in axes:
        n *= a
    return (n + _card_int(cards, "PCOUNT")) * _card_int(cards, "GCOUNT", 1) * abs(_card_int(cards, "BITPIX", 8)) // 8


def _padded(n: int) -> int:
    return -(-n // BLOCK) * BLOCK


def read_fits_table(spark: SparkSession, path: str, hdu: int = 1, rows: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a binary table with fixed scalar columns, ``row`` first.

    The layout is read from the header once; tasks then decode whole columns with numpy.
    ``rows`` is a half-open range, ``columns`` a projection in source order.
    """
    cards = {r["keyword"]: r["value"] for r in read_fits_cards(spark, path).where(F.col("hdu") == hdu).collect()}
    at = read_fits_cards(spark, path).where(F.col("hdu") == hdu).first()["data_at"]
    fields = []
    for k in range(int(cards["TFIELDS"])):
        form = cards[f"TFORM{k + 1}"].strip()
        code, repeat = form[-1], form[:-1] or "1"
        name = cards.get(f"TTYPE{k + 1}", f"col{k + 1}")
        if code == "A":
            fields.append((name, f"S{repeat}", "string"))
        elif code in dtypes.TFORM and repeat == "1":
            kind = dtypes.TFORM[code]
            fields.append((name, (">" if kind[1] != "1" else "|") + kind, dtypes.CODES[kind][1].simpleString()))
        else:
            raise UnsupportedFeature(f"column format {form}")
    total = int(cards["NAXIS2"])
    first, until = (0, total) if rows is None else (rows[0], min(rows[1], total))
    kept = [f for f in fields if columns is None or f[0] in columns]

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        layout = np.dtype([(n, k) for n, k, _ in fields])
        for b in batches:
            for row in b.to_pylist():
                data = np.frombuffer(bytes(row["content"]), layout, until - first, at + first * layout.itemsize)
                cols = [pa.array(np.arange(first, until), pa.int64())]
                for n, k, spark_type in kept:
                    if spark_type == "string":
                        cols.append(pa.array([x.decode("ascii").rstrip(" \0") for x in data[n]], pa.string()))
                    elif k[1:] == "b1":
                        cols.append(pa.array((data[n].view(np.uint8) != 0) & (data[n].view(np.uint8) != ord("F"))))
                    else:
                        wide = {"u1": "i2", "u2": "i4", "u4": "i8"}.get(k[1:], k[1:])
                        cols.append(pa.array(data[n].astype(wide)))
                yield pa.RecordBatch.from_arrays(cols, ["row", *[n for n, _, _ in kept]])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, "row long" + "".join(f", `{n}` {t}" for n, _, t in kept))


def read_fits_image(spark: SparkSession, path: str, hdu: int = 0, selection: Selection = ALL) -> DataFrame:
    """Long form (i0..iN, value) of an image's stored values; i0 is the slowest axis, and
    scaling is left to ``scalars.scaled``."""
    cards = read_fits_cards(spark, path).where(F.col("hdu") == hdu).select("keyword", "value", "data_at").collect()
    facts, at = {r["keyword"]: r["value"] for r in cards}, cards[0]["data_at"] if cards else 0
    if not facts or int(facts["NAXIS"]) == 0:
        raise InvalidFormat(f"{path}: unit {hdu} has no image")
    shape = [int(facts[f"NAXIS{k}"]) for k in range(int(facts["NAXIS"]), 0, -1)]
    kind = dtypes.BITPIX[int(facts["BITPIX"])]
    validate(selection, shape)
    coords = [f"i{k}" for k in range(len(shape))]

    def decode(batches):
        import math

        import numpy as np
        import pyarrow as pa

        wide = {"u1": "i2"}.get(kind, kind)
        for b in batches:
            for row in b.to_pylist():
                a = np.frombuffer(bytes(row["content"]), ">" + kind if kind != "u1" else kind, math.prod(shape), at)
                place = np.indices(shape).reshape(len(shape), -1)
                yield pa.RecordBatch.from_arrays([*[pa.array(p, pa.int64()) for p in place], pa.array(a.astype(wide))], [*coords, "value"])

    schema = "".join(f"{c} long, " for c in coords) + f"value {dtypes.CODES[kind][1].simpleString()}"
    return select(spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema), coords, selection)


def fits_table_bytes(columns: list[tuple[str, str]], data) -> bytes:
    """A FITS file with an empty primary unit and one binary table, from pandas."""
    import numpy as np

    kinds = {c: (">" if k[1] != "1" else "|") + k for c, k in dtypes.TFORM.items()}
    table = np.zeros(len(data), np.dtype([(n, kinds[c]) for n, c in columns]))
    for n, _ in columns:
        table[n] = data[n].to_numpy()
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(CARD)
    text = lambda k, v: f"{k:<8}= '{v:<8}'".ljust(CARD)
    primary = [card("SIMPLE", "T"), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", "T"), "END".ljust(CARD)]
    unit = [
        text("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", table.dtype.itemsize), card("NAXIS2", len(table)),
        card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(columns)),
    ]
    for k, (n, c) in enumerate(columns):
        unit += [text(f"TTYPE{k + 1}", n), text(f"TFORM{k + 1}", f"1{c}")]
    head = ["".join(x).ljust(_padded(len("".join(x)))).encode("ascii") for x in (primary, [*unit, "END".ljust(CARD)])]
    raw = table.tobytes()
    return head[0] + head[1] + raw + b"\0" * (_padded(len(raw)) - len(raw))


# --- Parquet footers --------------------------------------------------------


#: Rows of facts that a task hands over at once, about.
FACTS = 4096


def parquet_facts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, row_group, column, rows, values, bytes, codec) from Parquet footers.

    Python gets footers only.  Files of the local or a mounted file system are opened
    where the task runs, so that nothing but the footer is read; in other stores Spark
    reads a file (of 2 GB at most, as ``binaryFile`` goes) and cuts its footer off.
    """

    def facts(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["file", "row_group", "column", "rows", "values", "bytes", "codec"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            for row in b.to_pylist():
                m = pq.read_metadata(_local_path(row["path"]) if row["footer"] is None else io.BytesIO(row["footer"]))
                out = []
                for g in range(m.num_row_groups):
                    group = m.row_group(g)
                    for c in (group.column(k) for k in range(m.num_columns)):
                        out.append((row["path"], g, c.path_in_schema, group.num_rows, c.num_values, c.total_compressed_size, c.compression))
                    if len(out) >= FACTS:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    files = spark.read.format("binaryFile").load(path)
    local = F.col("path").startswith("file:/")
    # one scan for each kind: where the content is not named, Spark doesn't read it
    near = files.where(local).select("path", F.lit(None).cast("binary").alias("footer"))
    far = files.where(~local).select("path", _footer(F.col("content")).alias("footer"))
    there = {x.partition(":")[0] for x in files.inputFiles()}
    rows = near if there == {"file"} else far if "file" not in there else near.union(far)
    return rows.mapInArrow(facts, "file string, row_group long, column string, rows long, values long, bytes long, codec string")


def _local_path(path: str) -> str:
    """The path behind ``file:/path`` or ``file:///path``."""
    return "/" + path.removeprefix("file:").lstrip("/")


def _footer(content: Column) -> Column:
    """The end of a Parquet file: footer, its length in four bytes from the lowest, magic."""
    end = F.substring(content, -8, 4)
    byte = lambda k: F.conv(F.hex(F.substring(end, k + 1, 1)), 16, 10).cast("int") * F.lit(1 << 8 * k)
    return F.substring(content, -(byte(0) + byte(1) + byte(2) + byte(3) + 8), F.length(content))
