"""Appending a stream along the unlimited dimension of a chunked array.

Each micro-batch replaces the whole objects of the chunks that it touches.  Its rows are
first merged with those chunks' stored elements into a table in the checkpoint folder,
then written object by object under hidden names that are renamed, then the grown shape
is written.  A batch that is run again after a failure at any point merges the same
elements to the same objects, so the result is exactly once.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import NotFound
from ..sources import zarr


def append_rows(df: DataFrame, path: str, meta: zarr.ArrayMeta) -> None:
    """Merges rows (i0, ..., value) into the array, which grows along i0 as needed."""
    last = df.agg(F.max("i0")).first()[0]
    if last is None:
        return
    spark = df.sparkSession
    try:
        old = zarr.read_meta(spark, path)
    except NotFound:
        zarr.write_array(df, path, replace(meta, shape=(last + 1, *meta.shape[1:])))
        return
    grown = replace(old, shape=(max(old.shape[0], last + 1), *old.shape[1:]))
    zarr.write_array(zarr.update_selection(spark, path, df), path, grown)


def append_stream(stream: DataFrame, path: str, meta: zarr.ArrayMeta, checkpoint: str) -> StreamingQuery:
    """Starts the sink over all data available now."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch: append_rows(df, path, meta))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
