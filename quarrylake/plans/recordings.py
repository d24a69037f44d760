"""Neurophysiology and tabular recordings as DataFrames: time series, spike units,
electrodes and dynamic tables, assembled from their stored columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFormat, ShapeError
from ..functions.scalars import TIME_SERIES_TYPES, sample_time
from ..operators import ragged


def time_series(data: DataFrame, timestamps: DataFrame | None = None, start: float | None = None, rate: float | None = None) -> DataFrame:
    """Rows (idx, t, value) of samples (idx, value), with explicit times (idx, t) or a
    start and a positive rate, not both."""
    if (timestamps is None) == (rate is None):
        raise InvalidFormat("a time series has either timestamps or a rate")
    if timestamps is not None:
        return data.join(timestamps, "idx", "left").select("idx", "t", "value")
    if rate <= 0:
        raise InvalidFormat("the rate must be positive")
    t = sample_time(F.lit(None).cast("double"), F.lit(float(start or 0.0)), F.lit(float(rate)), F.col("idx"))
    return data.select("idx", t.alias("t"), "value")


def length_violations(data: DataFrame, timestamps: DataFrame) -> DataFrame:
    """Samples without a time and times without a sample."""
    lone = data.join(timestamps, "idx", "left_anti").select("idx", F.lit("no timestamp").alias("violation"))
    return lone.union(timestamps.join(data, "idx", "left_anti").select("idx", F.lit("no sample").alias("violation")))


def units_table(spike_times: DataFrame, index: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, spike_times) from flat times (pos, value), ends (row, end) and ids (row, id)."""
    lists = ragged.decode(index, spike_times, "row")
    return ids.join(lists, "row").select("id", F.col("values").alias("spike_times"))


def flat_spike_times(units: DataFrame) -> DataFrame:
    """All spikes (id, pos, value)."""
    return ragged.flatten(units, "id", "spike_times")


def dynamic_table(columns: dict[str, DataFrame], indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per ``row`` from columns (row, value); a column with an index is ragged:
    it comes as (pos, value) with ends (row, end)."""
    if not columns:
        raise ShapeError("a table needs a column")
    parts = []
    for name, df in columns.items():
        if indexes and name in indexes:
            df = ragged.decode(indexes[name], df, "row").withColumnRenamed("values", "value")
        parts.append(df.select("row", F.col("value").alias(name)))
    return reduce(lambda a, b: a.join(b, "row", "full"), parts)


def list_time_series(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Paths of all nodes whose type is a time series."""
    types = attributes.where(F.col("name") == "neurodata_type").where(F.col("value").isin(TIME_SERIES_TYPES))
    return nodes.join(types.select("path", F.col("value").alias("type")), "path").select("path", "type")
