"""Chunk grids: planning, pruning, linear order, fill values and growth.

Grids are generated by ``spark.range`` and integer arithmetic, so that a grid of
any size is planned in parallel; only shapes live on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ShapeError
from .selection import ALL, NONE, Dim, Hyperslab, Points, Selection, div, points_frame


def grid_shape(shape: Sequence[int], chunk: Sequence[int]) -> list[int]:
    """Chunks per dimension; the last may be partial."""
    if len(shape) != len(chunk) or any(c < 1 for c in chunk):
        raise ShapeError("chunk extents must be positive and as many as dimensions")
    return [-(-n // c) for n, c in zip(shape, chunk, strict=True)]


def total_chunks(shape: Sequence[int], chunk: Sequence[int]) -> int:
    return prod(grid_shape(shape, chunk))


def strides(shape: Sequence[int], order: str = "C") -> list[int]:
    """Elements between neighbours of each dimension: row-major "C" or column-major "F"."""
    out, step = [0] * len(shape), 1
    dims = range(len(shape)) if order == "F" else reversed(range(len(shape)))
    for k in dims:
        out[k] = step
        step *= shape[k]
    return out


def linear(coords: Sequence[Column], shape: Sequence[int], order: str = "C") -> Column:
    """Linear index of coordinates."""
    total = F.lit(0).cast("long")
    for c, s in zip(coords, strides(shape, order), strict=True):
        total = total + c.cast("long") * F.lit(s)
    return total


def delinear(index: Column, shape: Sequence[int], order: str = "C") -> list[Column]:
    """Coordinates of a linear index."""
    return [
        (div(index, s) % F.lit(n)).cast("long") if s > 1 else (index % F.lit(n)).cast("long")
        for s, n in zip(strides(shape, order), shape, strict=True)
    ]


def chunk_table(spark: SparkSession, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """One row per chunk: linear, coordinates c*, origin o* and clipped extent e*."""
    grid = grid_shape(shape, chunk)
    rows = spark.range(prod(grid)).withColumnRenamed("id", "linear")
    rows = rows.select("linear", *[c.alias(f"c{k}") for k, c in enumerate(delinear(F.col("linear"), grid))])
    return rows.select(
        "*",
        *[(F.col(f"c{k}") * c).alias(f"o{k}") for k, c in enumerate(chunk)],
        *[F.least(F.lit(c).cast("long"), F.lit(n) - F.col(f"c{k}") * c).alias(f"e{k}") for k, (n, c) in enumerate(zip(shape, chunk, strict=True))],
    )


def touched_range(d: Dim, chunk: int) -> tuple[int, int] | None:
    """First and last chunk that a selection of one dimension can touch."""
    return (d.start // chunk, d.last // chunk) if d.size else None


def _first_at(d: Dim, at: Column) -> Column:
    """Smallest selected index at or after ``at``."""
    k = div(F.greatest(F.lit(0), at - (d.start + d.block - d.stride)), d.stride)
    return F.when(k < d.count, F.greatest(at, d.start + k * d.stride))


def prune(chunks: DataFrame, slab: Hyperslab, chunk: Sequence[int]) -> DataFrame:
    """Chunks that hold at least one selected element.

    The touched range of each dimension is a plain comparison (pushed down to a
    chunk catalog); strides longer than a chunk need the exact test after it.
    """
    for k, (d, c) in enumerate(zip(slab.dims, chunk, strict=True)):
        hit = touched_range(d, c)
        if hit is None:
            return chunks.where(F.lit(False))
        chunks = chunks.where(F.col(f"c{k}").between(*hit))
        first = _first_at(d, F.col(f"o{k}"))
        chunks = chunks.where(first.isNotNull() & (first < F.col(f"o{k}") + F.col(f"e{k}")))
    return chunks


def chunk_slices(chunks: DataFrame, slab: Hyperslab, chunk: Sequence[int]) -> DataFrame:
    """Where each touched chunk's elements lie in it and in the output, as ``s*`` (first
    position in the chunk), ``n*`` (count), ``d*`` (step in the chunk) and ``t*`` (first
    output position).

    Single-element blocks give one row per chunk, which steps by the stride; longer
    blocks give a row per piece of a block in the chunk, which steps by one.
    """
    if any(d.overlaps for d in slab.dims):
        raise ShapeError("slices are defined for blocks that do not overlap")
    rows = prune(chunks, slab, chunk)
    for k, d in enumerate(slab.dims):
        origin, beyond = F.col(f"o{k}"), F.col(f"o{k}") + F.col(f"e{k}")
        if d.block == 1:
            first = _first_at(d, origin)
            until = F.least(beyond - 1, F.lit(d.last))
            rows = rows.withColumn(f"s{k}", first - origin).withColumn(f"n{k}", div(until - first, d.stride) + 1)
            rows = rows.withColumn(f"d{k}", F.lit(d.stride).cast("long")).withColumn(f"t{k}", div(first - d.start, d.stride))
            continue
        low = div(F.greatest(F.lit(0), origin - (d.start + d.block - d.stride)), d.stride)
        high = F.least(F.lit(d.count - 1).cast("long"), div(beyond - 1 - d.start, d.stride))
        rows = rows.withColumn("_k", F.explode(F.sequence(low, high)))
        begin = F.lit(d.start) + F.col("_k") * d.stride
        first, until = F.greatest(origin, begin), F.least(beyond, begin + d.block)
        rows = rows.withColumn(f"s{k}", first - origin).withColumn(f"n{k}", until - first).withColumn(f"d{k}", F.lit(1).cast("long"))
        rows = rows.withColumn(f"t{k}", F.col("_k") * d.block + first - begin).drop("_k")
    return rows


def chunk_plan(spark: SparkSession, shape: Sequence[int], chunk: Sequence[int], selection: Selection) -> DataFrame:
    """The chunks of any selection: slices for all, none and hyperslabs; for points, one
    row per point with its order, chunk coordinates c* and position p* in the chunk."""
    if isinstance(selection, Points):
        coords = [f"i{k}" for k in range(len(shape))]
        return of_elements(points_frame(spark, selection, coords), coords, chunk).drop(*coords)
    slab = selection if isinstance(selection, Hyperslab) else Hyperslab.contiguous([0] * len(shape), list(shape))
    rows = chunk_slices(chunk_table(spark, shape, chunk), slab, chunk)
    return rows.where(F.lit(False)) if selection == NONE else rows


def touched(selection: Selection, shape: Sequence[int], chunk: Sequence[int]) -> list[list[int] | None]:
    """Chunk coordinates that a selection can touch, by dimension; None for all of them.

    A hyperslab touches exactly the product of these, points touch a part of it.
    """
    if selection == ALL:
        return [None] * len(shape)
    if selection == NONE:
        return [[] for _ in shape]
    if isinstance(selection, Points):
        return [sorted({p[k] // c for p in selection.coords}) for k, c in enumerate(chunk)]
    out: list[list[int] | None] = []
    for d, n, c in zip(selection.dims, shape, chunk, strict=True):
        if not d.size:
            out.append([])
        elif d.start < c and d.last // c == (n - 1) // c and d.stride <= c:
            out.append(None)
        elif d.stride <= c:
            out.append(list(range(d.start // c, d.last // c + 1)))
        else:  # fewer blocks than chunks
            out.append(sorted({x for k in range(d.count) for x in range((d.start + k * d.stride) // c, (d.start + k * d.stride + d.block - 1) // c + 1)}))
    return out


def of_elements(df: DataFrame, coords: Sequence[str], chunk: Sequence[int]) -> DataFrame:
    """Adds each element's chunk coordinates c* and position p* in its chunk."""
    return df.select(
        "*",
        *[div(F.col(i), c).alias(f"c{k}") for k, (i, c) in enumerate(zip(coords, chunk, strict=True))],
        *[(F.col(i) % c).cast("long").alias(f"p{k}") for k, (i, c) in enumerate(zip(coords, chunk, strict=True))],
    )


def chunk_key(coords: Sequence[Column], version: int = 3, separator: str | None = None) -> Column:
    """Store key of a chunk: version 3 ``c/0/1``, version 2 ``0.1``; rank 0 is ``c`` or ``0``."""
    sep = separator or ("/" if version == 3 else ".")
    parts = [c.cast("string") for c in coords]
    if version == 3:
        return F.concat_ws(sep, F.lit("c"), *parts)
    return F.concat_ws(sep, *parts) if parts else F.lit("0")


def fill_missing(df: DataFrame, spark: SparkSession, shape: Sequence[int], coords: Sequence[str], value: str, fill, chunk: Sequence[int] | None = None) -> DataFrame:
    """Every element of the grid; elements without a row get the fill value.

    With ``chunk``, whole chunks are stored or missing: only the missing ones are found,
    by a join of chunks, and generated.  Otherwise single elements may be missing.
    """
    kind = df.schema[value].dataType
    if chunk is None:
        grid = spark.range(prod(shape)).select(*[c.alias(i) for i, c in zip(coords, delinear(F.col("id"), shape), strict=True)])
        return grid.join(df.select(*coords, value), list(coords), "left").select(*coords, F.coalesce(value, F.lit(fill).cast(kind)).alias(value))
    at = [f"c{k}" for k in range(len(shape))]
    lost = chunk_table(spark, shape, chunk).join(of_elements(df.select(*coords), coords, chunk).select(*at).distinct(), at, "left_anti")
    for k, i in enumerate(coords):
        lost = lost.withColumn(i, F.explode(F.sequence(F.col(f"o{k}"), F.col(f"o{k}") + F.col(f"e{k}") - 1)))
    return df.select(*coords, value).unionByName(lost.select(*coords, F.lit(fill).cast(kind).alias(value)))


def resize(shape: Sequence[int], unlimited: Sequence[bool], new: Sequence[int]) -> list[int]:
    """The new shape; only unlimited dimensions may change."""
    for n, free, m in zip(shape, unlimited, new, strict=True):
        if n != m and not free:
            raise ShapeError(f"a fixed dimension of {n} cannot become {m}")
    return list(new)


def byte_ranges(spark: SparkSession, total: int, parts: int) -> DataFrame:
    """Balanced partition of ``total`` bytes: the first ``total % parts`` get one more."""
    base, more = divmod(total, parts)
    rows = spark.range(parts).withColumnRenamed("id", "part")
    begin = F.col("part") * base + F.least(F.col("part"), F.lit(more).cast("long"))
    return rows.select("part", begin.alias("begin"), (F.lit(base).cast("long") + (F.col("part") < more).cast("long")).alias("length"))
