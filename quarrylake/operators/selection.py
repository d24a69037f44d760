"""Selections over N-dimensional arrays, as predicates on coordinate columns.

An array in long form has one row per element with a coordinate column per
dimension.  A selection turns into range bounds, which Catalyst pushes down to
scans, and a residual predicate for strides; nothing is enumerated on the
driver except the dimensions themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SelectionOutOfBounds, ShapeError, UnsupportedFeature


def div(a: Column, b: int) -> Column:
    """Integer quotient of longs, exact at any size (``/`` goes through doubles)."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


@dataclass(frozen=True)
class Dim:
    """``count`` blocks of ``block`` indices, block starts ``stride`` apart."""

    start: int = 0
    stride: int = 1
    count: int = 1
    block: int = 1

    @property
    def size(self) -> int:
        return self.count * self.block

    @property
    def last(self) -> int | None:
        """Largest index selected; None if nothing is."""
        return self.start + (self.count - 1) * self.stride + self.block - 1 if self.size else None

    @property
    def overlaps(self) -> bool:
        """Blocks longer than the stride select indices more than once."""
        return self.block > self.stride and self.count > 1

    def predicate(self, i: Column) -> Column:
        """Whether index ``i`` is selected.  Range bounds come first: they can be pushed
        down, and the modulo alone would accept indices before the start."""
        if not self.size:
            return F.lit(False)
        at = i - F.lit(self.start)
        inside = (i >= self.start) & (i <= self.last)
        return inside if self.stride == self.block or self.count == 1 else inside & (at % self.stride < self.block)

    def output(self, i: Column) -> Column:
        """Position of index ``i`` in the selected extent."""
        at = i - F.lit(self.start)
        if self.count == 1:
            return at
        return div(at, self.stride) * self.block + at % self.stride


@dataclass(frozen=True)
class Hyperslab:
    """One ``Dim`` per dimension."""

    dims: tuple[Dim, ...]

    @classmethod
    def contiguous(cls, start: Sequence[int], count: Sequence[int]) -> Hyperslab:
        if len(start) != len(count):
            raise ShapeError("start and count differ in rank")
        return cls(tuple(Dim(s, 1, c, 1) for s, c in zip(start, count, strict=True)))

    @classmethod
    def strided(cls, start: Sequence[int], count: Sequence[int], stride: Sequence[int]) -> Hyperslab:
        return cls(tuple(Dim(*d) for d in zip(start, stride, count, strict=True)))

    @property
    def num_elements(self) -> int:
        """Elements in the result; a selection of rank 0 has none."""
        return prod(d.size for d in self.dims) if self.dims else 0


@dataclass(frozen=True)
class Points:
    """Single elements in a given order; repeated points are repeated in the result."""

    coords: tuple[tuple[int, ...], ...]

    @property
    def num_elements(self) -> int:
        return len(self.coords)


ALL, NONE = "all", "none"
Selection = Hyperslab | Points | str


def num_elements(selection: Selection, shape: Sequence[int]) -> int:
    if selection == ALL:
        return prod(shape)
    return 0 if selection == NONE else selection.num_elements


def byte_length(selection: Selection, shape: Sequence[int], element_size: int | None) -> int:
    """Bytes of the selected elements; types of variable length have none."""
    if element_size is None:
        raise UnsupportedFeature("elements of variable length have no fixed byte size")
    return num_elements(selection, shape) * element_size


def validate(selection: Selection, shape: Sequence[int], empty_is_error: bool = False) -> None:
    """Check rank and bounds against ``shape``.  A count of 0 is an empty selection, or an
    error where a format asks for that (``empty_is_error``)."""
    if isinstance(selection, str):
        return
    if isinstance(selection, Points):
        for p in selection.coords:
            if len(p) != len(shape):
                raise ShapeError(f"point {p} has rank {len(p)}, the array {len(shape)}")
            if any(not 0 <= i < n for i, n in zip(p, shape, strict=True)):
                raise SelectionOutOfBounds(f"point {p} is outside {tuple(shape)}")
        return
    if len(selection.dims) != len(shape):
        raise ShapeError(f"selection has rank {len(selection.dims)}, the array {len(shape)}")
    for d, n in zip(selection.dims, shape, strict=True):
        if d.stride < 1 or d.start < 0 or d.count < 0 or d.block < 0 or (empty_is_error and not d.size):
            raise SelectionOutOfBounds(f"{d} is not a valid selection")
        if d.last is not None and d.last >= n:
            raise SelectionOutOfBounds(f"{d} reaches index {d.last} of {n}")


def select(df: DataFrame, coords: Sequence[str], selection: Selection, output: bool = False) -> DataFrame:
    """Rows of a long-form array that ``selection`` keeps.

    With ``output`` the positions in the result are added as ``o0..oN``.
    Overlapping blocks and points repeat rows by an equi-join on coordinates.
    """
    if selection == ALL:
        return df
    if selection == NONE:
        return df.where(F.lit(False))
    if isinstance(selection, Points):
        return select_points(df, coords, selection)
    if any(d.overlaps for d in selection.dims):
        return _select_overlapping(df, coords, selection)
    for c, d in zip(coords, selection.dims, strict=True):
        df = df.where(d.predicate(F.col(c)))
    if output:
        df = df.select("*", *[d.output(F.col(c)).alias(f"o{k}") for k, (c, d) in enumerate(zip(coords, selection.dims, strict=True))])
    return df


def _select_overlapping(df: DataFrame, coords: Sequence[str], slab: Hyperslab) -> DataFrame:
    # block b covers index i when start + b*stride <= i < start + b*stride + block
    for k, (c, d) in enumerate(zip(coords, slab.dims, strict=True)):
        at = F.col(c) - F.lit(d.start)
        first = div(F.greatest(F.lit(0), at - d.block + d.stride), d.stride)
        last = F.least(F.lit(d.count - 1), div(at, d.stride)).cast("long")
        df = df.where((at >= 0) & (F.col(c) <= F.lit(d.last if d.last is not None else -1)))
        df = df.where(first <= last).withColumn("_b", F.explode(F.sequence(first, last)))
        df = df.withColumn(f"o{k}", F.col("_b") * d.block + at - F.col("_b") * d.stride).drop("_b")
    return df


def points_frame(spark: SparkSession, points: Points, coords: Sequence[str]) -> DataFrame:
    """Points as rows ``(ord, coordinates)``; their number is fixed by the caller's list."""
    schema = ", ".join(["ord long", *[f"{c} long" for c in coords]])
    return spark.createDataFrame([(k, *p) for k, p in enumerate(points.coords)], schema)


def select_points(df: DataFrame, coords: Sequence[str], points: Points | DataFrame) -> DataFrame:
    """One row per point, in ``ord``; points may also be a frame of any size."""
    if isinstance(points, Points):
        points = points_frame(df.sparkSession, points, coords)
    return points.join(df, list(coords))


def matrix_elements(df: DataFrame, row: str, values: str, columns: Dim | None = None, names=("i0", "i1", "value")) -> DataFrame:
    """A matrix stored as one array per row, in long form.

    With ``columns`` only the selected positions are generated, so that a few columns
    of wide rows do not pass through every element.
    """
    if columns is None:
        return df.select(F.col(row).alias(names[0]), F.posexplode(values)).toDF(*names)
    if not columns.size:
        positions = F.expr("cast(array() as array<int>)")
    elif columns.block == 1:
        positions = F.sequence(F.lit(columns.start), F.lit(columns.last), F.lit(columns.stride))
    else:
        starts = F.sequence(F.lit(columns.start), F.lit(columns.start + (columns.count - 1) * columns.stride), F.lit(columns.stride))
        positions = F.flatten(F.transform(starts, lambda s: F.sequence(s, s + columns.block - 1)))
    positions = F.filter(positions, lambda p: p < F.size(values))
    rows = df.select(F.col(row).alias(names[0]), F.col(values).alias("_v"), F.explode(positions).alias(names[1]))
    return rows.select(names[0], names[1], F.get("_v", F.col(names[1])).alias(names[2]))
