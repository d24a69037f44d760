"""Byte codecs, filters and checksums of array chunks.

Small helpers that run inside Spark tasks on one chunk at a time; the libraries
do the work.  CRC-32 is a Spark function; the others are Arrow-batched UDFs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MAX_CHUNK_BYTES, InvalidFormat, ResourceLimit, UnsupportedFeature

# --- codecs -----------------------------------------------------------------


def _arrow(name: str) -> tuple[Callable, Callable]:
    def encode(data: bytes, size: int | None = None) -> bytes:
        import pyarrow as pa

        return pa.Codec(name).compress(data, asbytes=True)

    def decode(data: bytes, size: int | None = None) -> bytes:
        import pyarrow as pa

        if size is None:
            raise UnsupportedFeature(f"{name} needs the decoded size")
        return pa.Codec(name).decompress(data, decompressed_size=size, asbytes=True)

    return encode, decode


def _gzip() -> tuple[Callable, Callable]:
    def encode(data, size=None):
        c = zlib.compressobj(wbits=31)
        return c.compress(data) + c.flush()

    return encode, lambda data, size=None: zlib.decompress(data, wbits=31)


def _zstd() -> tuple[Callable, Callable]:
    def encode(data, size=None):
        import zstandard

        return zstandard.compress(data)

    def decode(data, size=None):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)

    return encode, decode


#: name -> (encode, decode); both take (bytes, decoded size or None).
CODECS: dict[str, tuple[Callable, Callable]] = {
    "zlib": (lambda data, size=None: zlib.compress(data), lambda data, size=None: zlib.decompress(data)),
    "gzip": _gzip(),
    "zstd": _zstd(),
    "lz4": _arrow("lz4_raw"),
    "snappy": _arrow("snappy"),
}
CODECS["deflate"] = CODECS["zlib"]


def register(name: str, encode: Callable, decode: Callable) -> None:
    """Adds or replaces a codec."""
    CODECS[name] = (encode, decode)


def codec(name: str) -> tuple[Callable, Callable]:
    if name not in CODECS:
        raise UnsupportedFeature(f"codec {name!r}")
    return CODECS[name]


# --- filters ----------------------------------------------------------------


#: Strings shorter than this are handled in plain Python, as numpy costs more to call.
_SHORT = 64


def shuffle(data: bytes, size: int) -> bytes:
    """Groups the k-th bytes of all elements; a tail shorter than an element stays."""
    import numpy as np

    n = len(data) // size * size
    if n < _SHORT:
        return b"".join([data[k:n:size] for k in range(size)]) + data[n:]
    return np.frombuffer(data[:n], np.uint8).reshape(-1, size).T.tobytes() + data[n:]


def unshuffle(data: bytes, size: int) -> bytes:
    import numpy as np

    n = len(data) // size * size
    if n < _SHORT:
        out, each = bytearray(n), n // size
        for k in range(size):
            out[k::size] = data[k * each : (k + 1) * each]
        return bytes(out) + data[n:]
    return np.frombuffer(data[:n], np.uint8).reshape(size, -1).T.tobytes() + data[n:]


def pack_bits(values, bits: int) -> bytes:
    """Unsigned integers in ``bits`` bits each, least significant bit first."""
    import numpy as np

    v = np.asarray(values, np.uint64)
    return np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int):
    import numpy as np

    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count]
    return (flat.reshape(count, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1)


def swap(data: bytes, size: int) -> bytes:
    """Reverses the bytes of each element."""
    import numpy as np

    if len(data) % size:
        raise InvalidFormat("length is not a multiple of the element size")
    return np.frombuffer(data, np.uint8).reshape(-1, size)[:, ::-1].tobytes()


def apply(data: bytes, steps: list[dict], forward: bool, decoded: int | None = None) -> bytes:
    """Runs ``steps`` ({"name": ..., options}) in order to encode, reversed to decode."""
    for step in steps if forward else reversed(steps):
        name, size = step["name"], step.get("elementsize", 1)
        if name == "shuffle":
            data = shuffle(data, size) if forward else unshuffle(data, size)
        elif name == "swap":
            data = swap(data, size)
        elif name == "crc32c":
            data = data + crc32c(data).to_bytes(4, "little") if forward else _checked(data, crc32c)
        elif name == "fletcher32":
            data = data + fletcher32(data).to_bytes(4, "little") if forward else _checked(data, fletcher32)
        else:
            data = codec(name)[0 if forward else 1](data, decoded)
        if len(data) > MAX_CHUNK_BYTES:
            raise ResourceLimit(f"{len(data)} bytes after {name}")
    return data


def each_distinct(values, of: Callable):
    """Arrow array of ``of(value)`` for each value of an Arrow array, in order; null stays.

    Equal values of a batch are worked on once.
    """
    import pyarrow as pa

    coded = values.dictionary_encode()
    done = pa.array([of(v) for v in coded.dictionary.to_pylist()])
    return done.take(coded.indices)


def _checked(data: bytes, of) -> bytes:
    body, tail = data[:-4], data[-4:]
    if of(body).to_bytes(4, "little") != tail:
        raise InvalidFormat(f"{of.__name__} does not match")
    return body


# --- checksums --------------------------------------------------------------


#: Strings of at least so many bytes are cut into lanes that advance together.
_LANES = 1024


def crc32c(data: bytes) -> int:
    """Castagnoli CRC; a table of the 256 byte steps is built from the polynomial.

    A CRC is linear: lanes of a long string are advanced side by side, and neighbours
    are merged by moving the left one over as many zero bytes as the right one has.
    """
    import numpy as np

    if len(data) < 8 * _LANES:
        c, steps = 0xFFFFFFFF, _crc_steps()
        for b in data:
            c = steps[(c ^ b) & 0xFF] ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    table = _crc_table()
    # the start value is the same as flipping the first four bytes; zeros before it change nothing
    raw = np.frombuffer(data, np.uint8).copy()
    raw[:4] ^= 0xFF
    lanes = np.r_[np.zeros(-len(raw) % _LANES, np.uint8), raw].reshape(_LANES, -1)
    c = np.zeros(_LANES, np.uint32)
    for k in range(lanes.shape[1]):
        c = table[(c ^ lanes[:, k]) & 0xFF] ^ (c >> np.uint32(8))
    # what each bit of a register becomes after a lane of zeros
    moved = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(lanes.shape[1]):
        moved = table[moved & 0xFF] ^ (moved >> np.uint32(8))
    while len(c) > 1:
        c = _carry(c[::2], moved) ^ c[1::2]
        moved = _carry(moved, moved)
    return int(c[0]) ^ 0xFFFFFFFF


def _carry(c, moved):
    """Registers ``c`` under the linear map that sends bit k to ``moved[k]``."""
    import numpy as np

    bits = (c[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, moved[None, :], np.uint32(0)), axis=1)


@lru_cache
def _crc_table(polynomial: int = 0x82F63B78):
    import numpy as np

    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & 1, np.uint32(polynomial), np.uint32(0))
    return c


@lru_cache
def _crc_steps() -> list[int]:
    return _crc_table().tolist()


def fletcher32(data: bytes) -> int:
    """Sums of little-endian 16-bit words modulo 65535; an odd last byte is a low byte."""
    import numpy as np

    if len(data) < _SHORT:
        low = high = 0
        for k in range(0, len(data), 2):
            low += int.from_bytes(data[k : k + 2], "little")
            high += low
        return high % 65535 << 16 | low % 65535
    w = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2").astype(np.uint64)
    weight = np.arange(len(w), 0, -1, dtype=np.uint64) % np.uint64(65535)
    low, high = int(w.sum()) % 65535, int((w * weight).sum()) % 65535
    return high << 16 | low


# Rotations of the lookup3 rounds.
_MIX = (4, 6, 8, 16, 19, 4)
_FINAL = (14, 11, 25, 16, 4, 14, 24)


def lookup3(data: bytes, start: int = 0) -> int:
    """Bob Jenkins' public-domain lookup3 hash over little-endian words."""
    full = 0xFFFFFFFF
    turn = lambda x, k: ((x << k) | (x >> (32 - k))) & full
    v = [(0xDEADBEEF + len(data) + start) & full] * 3

    def take(block: bytes) -> None:
        for k in range(3):
            v[k] = (v[k] + int.from_bytes(block[4 * k : 4 * k + 4].ljust(4, b"\0"), "little")) & full

    at = 0
    while len(data) - at > 12:
        take(data[at : at + 12])
        for n, k in enumerate(_MIX):  # the three words take turns
            i, prev, after = n % 3, (n + 2) % 3, (n + 1) % 3
            v[i] = ((v[i] - v[prev]) & full) ^ turn(v[prev], k)
            v[prev] = (v[prev] + v[after]) & full
        at += 12
    if at == len(data):
        return v[2]
    take(data[at:])
    for n, k in enumerate(_FINAL):
        i, prev = (n + 2) % 3, (n + 1) % 3
        v[i] = ((v[i] ^ v[prev]) - turn(v[prev], k)) & full
    return v[2]


def checksum(data: Column, kind: str) -> Column:
    """Checksum column of a binary column: crc32, crc32c, fletcher32 or lookup3."""
    if kind == "crc32":
        return F.crc32(data)
    of = {"crc32c": crc32c, "fletcher32": fletcher32, "lookup3": lookup3}[kind]

    @F.pandas_udf("long")
    def batch(s):
        return s.map(lambda x: None if x is None else of(bytes(x)))

    return batch(data)
