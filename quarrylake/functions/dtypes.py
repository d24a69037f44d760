"""Element types of array files and their Spark types.

Spark has no unsigned types: they widen to the next signed type, 64-bit ones to
decimal(20, 0).  Byte order belongs to the stored bytes and is gone after decoding.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import UnsupportedFeature

# Element types by name, as (numpy code, Spark type).
NAMED = {
    "bool": ("b1", T.BooleanType()),
    "int8": ("i1", T.ByteType()),
    "int16": ("i2", T.ShortType()),
    "int32": ("i4", T.IntegerType()),
    "int64": ("i8", T.LongType()),
    "uint8": ("u1", T.ShortType()),
    "uint16": ("u2", T.IntegerType()),
    "uint32": ("u4", T.LongType()),
    "uint64": ("u8", T.DecimalType(20, 0)),
    "float16": ("f2", T.FloatType()),
    "float32": ("f4", T.FloatType()),
    "float64": ("f8", T.DoubleType()),
}
CODES = {code: (name, kind) for name, (code, kind) in NAMED.items()}
# Table column codes (code, bytes) and image element types of FITS.
TFORM = {"L": "b1", "B": "u1", "I": "i2", "J": "i4", "K": "i8", "E": "f4", "D": "f8"}
BITPIX = {8: "u1", 16: "i2", 32: "i4", 64: "i8", -32: "f4", -64: "f8"}


def parse(name: str) -> tuple[str, T.DataType]:
    """numpy dtype string and Spark type of ``float64``, ``<f8``, ``|u1``, ``>i2`` ..."""
    if name in NAMED:
        code, kind = NAMED[name]
        return ("|" if code in ("b1", "i1", "u1") else "<") + code, kind
    m = re.fullmatch(r"([<>|=]?)([biuf])(\d+)", name)
    if not m or m[2] + m[3] not in CODES:
        raise UnsupportedFeature(f"element type {name!r}")
    return (m[1] or "<") + m[2] + m[3], CODES[m[2] + m[3]][1]


def element_size(name: str) -> int:
    return int(re.sub(r"\D", "", parse(name)[0]))
