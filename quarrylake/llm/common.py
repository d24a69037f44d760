"""Helpers shared by the training-data operators.

Nothing here collects rows.  ``stage_table`` cuts lineage with a Parquet table
in the shared folder that the cluster names in ``spark.checkpoint.dir``; such a
table survives lost executors, unlike a local checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, as a Java character class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, read by Spark, with only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder: the session's own, else a new one (single machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            folder = jvm_dir.get()
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="spark-quarrylake-")
            spark.sparkContext.setCheckpointDir(folder)
            folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return str(folder).rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    The files stay until the session's process ends, because frames that read
    them are lazy.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone at exit
        return


#: Rows of an Arrow batch that a task turns into Python values at once.
SLICE_ROWS = 256


def slices(batches):
    """All rows of Arrow batches in order, at most ``SLICE_ROWS`` at once: Python values of
    texts, and what is made of them, take several times the batch's bytes."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


#: Keys that hold at least one in so many of all rows are taken as frequent.
FREQUENT = 10_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per ``key`` and says in
    ``count`` how many rows hold the key.

    No task gets all rows of a frequent key: keys that hold 1 / ``FREQUENT`` of the
    counted rows or more number at most ``FREQUENT`` at any size of the input, so they
    are broadcast; the others are joined by shuffle.  Both frames are read more than
    once and should be stored tables or cheap.
    """
    total, keys = per_key.agg(F.sum(F.col(count).cast("double")), F.count("*")).first()
    if keys <= FREQUENT:
        return rows.join(F.broadcast(per_key), key)
    frequent = F.col(count) * FREQUENT >= total
    rest = per_key.where(~frequent)
    hot = F.broadcast(per_key.where(frequent))
    joined = rows.join(hot, key)
    if rest.isEmpty():
        return joined
    return joined.unionByName(rows.join(F.broadcast(per_key.where(frequent).select(key)), key, "left_anti").join(rest, key))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: inside higher-order
    functions Spark evaluates an expression again at each place that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words (runs of anything but white space) of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def code_point_spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Leftmost non-overlapping matches of a Java ``pattern`` as an array of
    ``struct<start, end, kind, value>`` (code points, end exclusive), kept where
    ``keep(value)`` holds.

    Spark has no function that gives match positions: the text is split at the
    matches, and the lengths of gaps and matches are added up in order.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(
        F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("spans"),
    )

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(keep(pair["value"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    folded = F.aggregate(pairs, zero, step, lambda acc: acc["spans"])
    return F.transform(
        folded,
        lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), s["value"]),
    )


NO_SPANS = "cast(array() as array<struct<start:int,end:int,kind:string,value:string>>)"


def spans_if(probe: Column, spans: Column) -> Column:
    """``spans`` where the cheap ``probe`` says that a match is possible, else none."""
    return F.when(probe, spans).otherwise(F.expr(NO_SPANS))


def join_spans(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then by the order of ``kinds``, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ranked = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    return F.array_join(
        F.transform(
            ranked,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
