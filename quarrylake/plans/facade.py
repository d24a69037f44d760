"""One way to open any dataset as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedFeature
from ..operators.selection import ALL, Selection, select, validate
from ..sources import files, zarr

#: Openers by name: (test of a path, reader).  ``register`` adds more.
_OPENERS: dict[str, tuple[Callable[[str], bool], Callable[..., DataFrame]]] = {}


@dataclass(frozen=True)
class Dataset:
    """A dataset that has been found but not read."""

    spark: SparkSession
    path: str
    kind: str
    options: dict

    def read(self, selection: Selection = ALL) -> DataFrame:
        """The selected elements or rows."""
        return _OPENERS[self.kind][1](self.spark, self.path, selection, **self.options)


def register(kind: str, test: Callable[[str], bool], reader: Callable[..., DataFrame]) -> None:
    """Adds a format: ``reader(spark, path, selection, **options)`` returns a frame."""
    _OPENERS[kind] = (test, reader)


def open_dataset(spark: SparkSession, path: str, kind: str | None = None, **options) -> Dataset:
    """Finds the format of ``path`` (or takes ``kind``); nothing is read yet."""
    found = kind or next((k for k, (test, _) in _OPENERS.items() if test(path)), None)
    if found not in _OPENERS:
        raise UnsupportedFeature(f"no format for {path}")
    return Dataset(spark, path, found, options)


def _rows(df: DataFrame, selection: Selection, key: str) -> DataFrame:
    return select(df, [key], selection)


def _npy(spark, path, selection, dtype="<f8", shape=()):
    validate(selection, shape)
    coords = [f"i{k}" for k in range(len(shape))]
    return select(files.read_npy(spark, path, dtype, len(shape)), coords, selection)


register("parquet", lambda p: p.rstrip("/").endswith(".parquet"), lambda spark, path, selection, key="row": _rows(spark.read.parquet(path), selection, key))
register("fits", lambda p: p.endswith((".fits", ".fit")), lambda spark, path, selection, **o: _rows(files.read_fits_table(spark, path, **o), selection, "row"))
register("npy", lambda p: p.endswith(".npy"), _npy)
register("array", lambda p: True, lambda spark, path, selection, **o: zarr.read_array(spark, path, selection, **o))
