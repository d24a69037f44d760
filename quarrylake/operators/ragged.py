"""Ragged columns: lists as flat values with cumulative end offsets, and nested levels.

Prefix sums over a whole table are taken in two levels, so that no task sees all
rows: rows are dealt to ranges of their order key that hold about as many rows each
(quantiles are the bounds), range totals are summed up (one row per range), and each
range sums its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import stored
from .selection import div

#: Rows of a range of two-level prefix sums, about; more beyond ``RANGES`` ranges.
RANGE, RANGES = 1 << 16, 1024


def range_of(df: DataFrame, order: str, width: int = RANGE) -> Column:
    """Number of a row's range, ascending with ``order`` (an integer key)."""
    n = df.count()
    ranges = min(RANGES, -(-n // width))
    if ranges < 2:
        return F.lit(0)
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(df.agg(F.percentile_approx(F.col(order).cast("long"), shares, 16 * ranges)).first()[0] or []))
    known = F.split(F.lit(",".join(map(str, bounds)) or "0"), ",").cast("array<bigint>")
    # binary search: how many bounds are at most the key
    step = lambda a, j: F.when((a + j <= len(bounds)) & (F.get(known, a + j - 1) <= F.col(order)), a + j).otherwise(a)
    steps = [F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))] or [F.lit(1)]
    return F.aggregate(F.array(*steps), F.lit(0), step)


def prefix_sum(df: DataFrame, order: str, size: Column, name: str, width: int = RANGE) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over all rows up to and with this one, by
    ``order`` (a unique integer key)."""
    rows = df.withColumn("_n", size.cast("long")).withColumn("_r", range_of(df, order, width))
    totals = rows.groupBy("_r").agg(F.sum("_n").alias("_t"))  # at most RANGES rows
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_r", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(before), "_r").withColumn(name, F.col("_before") + F.sum("_n").over(own)).drop("_r", "_n", "_before")


def encode(df: DataFrame, order: str, values: str, width: int = RANGE) -> DataFrame:
    """Index rows (order, end): cumulative end offsets of each row's list.

    The lists are read once; sizes and ends are stored, as several passes read them.
    """
    sizes = stored(df.select(order, F.coalesce(F.size(values), F.lit(0)).cast("long").alias("_size")))
    return stored(prefix_sum(sizes, order, F.col("_size"), "end", width).select(order, "end"))


def flatten(df: DataFrame, order: str, values: str) -> DataFrame:
    """Flat rows (order, pos, value), in the order (order, pos)."""
    return df.select(order, F.posexplode(values).alias("pos", "value"))


def flat_positions(df: DataFrame, order: str, values: str, width: int = RANGE, index: DataFrame | None = None) -> DataFrame:
    """Flat rows (pos, value) numbered over the whole table; the ``index`` of the same
    rows by ``encode`` spares their prefix sums."""
    ends = prefix_sum(df, order, F.size(values), "end", width) if index is None else df.join(index, order)
    rows = ends.select((F.col("end") - F.size(values)).alias("_start"), F.posexplode(values).alias("_p", "value"))
    return rows.select((F.col("_start") + F.col("_p")).alias("pos"), "value")


def decode(index: DataFrame, flat: DataFrame, order: str, end: str = "end", width: int = 4096) -> DataFrame:
    """Lists (order, values) from end offsets and flat rows (pos, value).

    A row's start is the previous row's end.  The flat rows of a position range become
    one array, and each list that reaches into the range takes its slice of it: an
    equi-join of one row per list and range, whatever the lists' lengths.
    """
    previous = previous_value(index, order, end)
    spans = previous.select(order, F.coalesce("_previous", F.lit(0)).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    held = F.coalesce(F.col("_e") > F.col("_s"), F.lit(False))
    reach = F.sequence(div(F.col("_s"), width), div(F.col("_e") - 1, width))
    reached = spans.where(held).withColumn("_k", F.explode(reach))
    pieces = reached.join(_blocks(flat, width), "_k", "left").select(order, "_k", _slice().alias("_v"))
    parts = F.sort_array(F.collect_list(F.struct("_k", "_v")))["_v"]
    lists = pieces.groupBy(order).agg(F.flatten(F.filter(parts, lambda v: v.isNotNull())).alias("values"))
    return lists.union(spans.where(~held).select(order, F.array().cast(lists.schema["values"].dataType)))


def _blocks(flat: DataFrame, width: int) -> DataFrame:
    """Flat rows by position range: ``_k``, the first position ``_f``, and either ``_x``, the
    values of positions without gaps, or ``_y``, (pos, value) where some are missing or twice."""
    rows = flat.where("pos is not null").select(div(F.col("pos"), width).alias("_k"), F.struct(F.col("pos").cast("long").alias("pos"), "value").alias("_v"))
    rows = rows.groupBy("_k").agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    at = F.col("_v")["pos"]
    first = F.element_at(at, 1)
    whole = at == F.sequence(first, F.element_at(at, -1))
    return rows.select("_k", first.alias("_f"), F.when(whole, F.col("_v")["value"]).alias("_x"), F.when(~whole, F.col("_v")).alias("_y"))


def _slice() -> Column:
    """The values of positions ``_s`` to ``_e`` (exclusive) in a range of ``_blocks``."""
    begin = F.greatest(F.col("_s") - F.col("_f"), F.lit(0).cast("long"))
    n = F.greatest(F.least(F.col("_e") - F.col("_f"), F.size("_x").cast("long")) - begin, F.lit(0).cast("long"))
    some = F.filter("_y", lambda y: (y["pos"] >= F.col("_s")) & (y["pos"] < F.col("_e")))["value"]
    return F.when(F.col("_x").isNotNull(), F.slice("_x", (begin + 1).cast("int"), n.cast("int"))).otherwise(some)


def previous_value(df: DataFrame, order: str, value: str, width: int = RANGE) -> DataFrame:
    """Adds ``_previous``: ``value`` of the row before, by ``order``, without one window over all rows."""
    rows = df.withColumn("_r", range_of(df, order, width))
    lasts = rows.groupBy("_r").agg(F.max_by(value, order).alias("_last"))  # one row per range
    lasts = lasts.select("_r", F.lag("_last").over(Window.orderBy("_r")).alias("_carry"))
    own = Window.partitionBy("_r").orderBy(order)
    return rows.join(F.broadcast(lasts), "_r").withColumn("_previous", F.coalesce(F.lag(value).over(own), F.col("_carry"))).drop("_r", "_carry")


def index_violations(index: DataFrame, order: str, end: str, flat_length: int) -> DataFrame:
    """Rows (order, violation) of an index that does not fit its flat values."""
    rows = previous_value(index, order, end)
    falling = rows.where(F.col(end) < F.coalesce("_previous", F.lit(0))).select(order, F.lit("not monotone").alias("violation"))
    last = index.agg(F.max_by(order, order).alias(order), F.max_by(end, order).alias("_e"))
    wrong = last.where(F.coalesce("_e", F.lit(0)) != flat_length).select(order, F.lit("last end differs from the flat length").alias("violation"))
    return falling.union(wrong)


def levels(df: DataFrame, row: str, values: str, nullable: bool = True, nullable_items: bool = False) -> DataFrame:
    """Dremel levels (row, pos, rep, def, value) of a list column.

    A nullable list: null is 0, empty 1, an item 2; with nullable items a null item is 2
    and an item 3.  A bare repeated leaf: empty 0, item 1.  Only the first entry of a row
    has repetition level 0.
    """
    top = 1 if nullable else 0
    rows = df.select(row, F.col(values).isNull().alias("_null"), F.posexplode_outer(values).alias("pos", "value"))
    item = F.lit(top + 1) + (F.col("value").isNotNull().cast("int") if nullable_items else F.lit(0))
    definition = F.when(F.col("pos").isNotNull(), item).when(F.col("_null") & F.lit(nullable), F.lit(0)).otherwise(F.lit(top))
    repetition = F.when(F.coalesce("pos", F.lit(0)) == 0, F.lit(0)).otherwise(F.lit(1))
    return rows.select(row, F.coalesce("pos", F.lit(0)).alias("pos"), repetition.alias("rep"), definition.alias("def"), "value")


def nested_levels(df: DataFrame, row: str, values: str, depth: int) -> DataFrame:
    """Dremel levels (row, pos, rep, def, value) of ``depth`` nullable lists inside each
    other, with nullable items; ``pos`` holds the position at each depth.

    Each list adds two definition levels: 2d for a null list at depth d, one more for an
    empty one; a null leaf is 2 * depth and a value one more.  An entry repeats at the
    depth of the innermost list that it continues.
    """
    rows = df.select(row, F.col(values).alias("_v"), F.lit(0).alias("rep"), F.lit(None).cast("int").alias("def"), F.expr("cast(array() as array<int>)").alias("pos"))
    for d in range(depth):
        ended = F.when(F.col("def").isNotNull(), F.col("def")).when(F.col("_v").isNull(), 2 * d).when(F.size("_v") == 0, 2 * d + 1)
        rows = rows.select(row, "rep", ended.alias("def"), "pos", F.posexplode_outer("_v").alias("_p", "_v"))
        again = F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("rep")).otherwise(F.lit(d + 1))
        rows = rows.select(row, again.alias("rep"), "def", F.concat("pos", F.array(F.coalesce("_p", F.lit(0)))).alias("pos"), "_v")
    leaf = F.coalesce("def", F.lit(2 * depth) + F.col("_v").isNotNull().cast("int"))
    return rows.select(row, "pos", "rep", leaf.alias("def"), F.col("_v").alias("value"))


def descriptors(df: DataFrame, order: str, values: str) -> DataFrame:
    """Rows (order, descriptor) of lists kept apart from their values: struct<count,
    offset>, the offset being where the list begins among all values."""
    n = F.coalesce(F.size(values), F.lit(0)).cast("long")
    n = F.greatest(n, F.lit(0).cast("long"))
    ends = prefix_sum(df.select(order, n.alias("_c")), order, F.col("_c"), "_e")
    return ends.select(order, F.struct(F.col("_c").alias("count"), (F.col("_e") - F.col("_c")).alias("offset")).alias("descriptor"))


def csc_violations(pointers: DataFrame, entries: DataFrame, n_rows: int, column: str = "col") -> DataFrame:
    """Rows (col, violation) of a compressed-column matrix that is not one: ends that
    fall or miss the number of entries, and row numbers outside the matrix.

    ``pointers`` has (col, end), ``entries`` (pos, row, value).
    """
    nnz = entries.count()
    bad = entries.where((F.col("row") < 0) | (F.col("row") >= n_rows)).select(F.lit(None).cast("long").alias(column), F.lit("row outside the matrix").alias("violation"))
    return index_violations(pointers, column, "end", nnz).union(bad)


def max_levels(optional: int, repeated: int) -> tuple[int, int]:
    """Largest repetition and definition level of a leaf below so many optional and repeated fields."""
    return repeated, optional + repeated


def csc_to_coo(pointers: DataFrame, entries: DataFrame, column: str = "col") -> DataFrame:
    """Coordinate rows (row, col, value) of a compressed-column matrix.

    ``pointers`` has (col, end), ``entries`` (pos, row, value).
    """
    packed = entries.select("pos", F.struct("row", "value").alias("value"))
    lists = decode(pointers, packed, column)
    return lists.select(F.col(column).alias("col"), F.explode("values").alias("x")).select("x.row", "col", "x.value")
