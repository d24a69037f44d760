"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets are filled up by weight: no source is asked for more than ``max_repeat``
times its size, and what a full source cannot take is shared among the others.
A source's rows are dealt by hash to blocks; the blocks of a source have a fixed
random order.  A mix draws blocks in that order, first every block as often as
the target holds the whole source, then blocks until the rest of the target is
met; the last block is cut at the exact word.

The draws of a source are its quota.  A binary tree splits the quotas of all
sources among output shards: at each node the left half's share of draws comes
from one multivariate-hypergeometric draw, so that every shard is a uniform
sample of the mix and the quotas hold exactly.  Shards own consecutive draws, so
blocks are disjoint, and rows are put in a random order inside their shard.

Sources stay in Spark: their order, weights, targets and quotas are columns, and the
targets' water level is found in a few aggregates.  The driver's tree splits the quotas
of at most ``GROUPS`` groups of sources; each group's share is split among its own
sources in a task of its own.  Draws are settled on ids and sizes alone, and whole
documents are joined once, at the end.  No source is ever one task: blocks hold about
``BLOCK_ROWS`` rows, more for sources of over ``MAX_BLOCKS`` blocks.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own and sorts last; repeated rows are drawn separately, in a fixed
order; with no words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import SPACE, join_per_key, stage_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_ROWS = 256
#: A source's blocks are put in order by one task, which sees one short row of each.
MAX_BLOCKS = 65536
#: Output shards hold about so many words; the tree has 16 to 1024 of them, and
#: larger corpora cut each shard into parts by hash.  Shards are much smaller than
#: a task's share, so that tasks get several each and stay even.
SHARD_WORDS = 1_000_000
MIN_SHARDS, MAX_SHARDS = 16, 1024
#: Sources of a group, about; more where there would be over ``GROUPS`` groups.
GROUP_SOURCES, GROUPS = 64, 1024
SEED = 20240601


def text_size(text: Column) -> Column:
    """Number of words; null counts as 0."""
    # one more piece than separators, less the empty pieces at either end
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def split_quotas(quotas: list[int], shards: int | list[int], seed=SEED) -> list[list[int]]:
    """Draws per shard and source; columns add up to the quotas.

    ``shards`` is their number, and rows then differ by at most one draw, or the
    number of draws of each.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    pool = np.array(quotas, np.int64)
    if isinstance(shards, int):
        total = int(pool.sum())
        shards = np.diff([-(-total * i // shards) for i in range(shards + 1)])
    until = np.r_[0, np.cumsum(shards)]
    result = []

    def draw(pool, k):
        # one source at a time: the hypergeometric conditionals of the joint draw
        got, rest = np.zeros_like(pool), int(pool.sum())
        for i in np.flatnonzero(pool):
            n = int(pool[i])
            rest -= n
            got[i] = min(k, n if not rest else max(_hypergeometric(rng, n, rest, k), k - rest))
            k -= int(got[i])
        return got

    def node(pool, first, last):
        if last - first == 1:
            result.append(pool.tolist())
            return
        middle = (first + last) // 2
        left = draw(pool, int(until[middle] - until[first]))
        node(left, first, middle)
        node(pool - left, middle, last)

    node(pool, 0, len(shards))
    return result


def _hypergeometric(rng, good, bad, k):
    """A draw; above numpy's limit of 10**9 its normal limit, which is then within
    one draw's rounding of it in distribution."""
    if not k or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, k))
    n, p = good + bad, good / (good + bad)
    spread = (k * p * (1 - p) * ((n - k) / (n - 1))) ** 0.5
    return min(good, k, max(0, k - bad, round(rng.normal(k * p, spread))))


def in_order(sources: DataFrame) -> DataFrame:
    """``place`` of each source from 0, by code point, null last, without a sort in one task."""
    dealt = sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("at", F.spark_partition_id())
    dealt = stage_table(dealt, "mixing-order")
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    before = dealt.groupBy("at").agg(F.count("*").alias("n")).select("at", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("at").orderBy(F.asc_nulls_last("source")))
    return dealt.join(F.broadcast(before), "at").withColumn("place", F.col("before") + own - 1).drop("at", "before")


def with_targets(sources: DataFrame, weights, share: float, repeat: float) -> tuple[DataFrame, float, int]:
    """``sources`` (source, source_size, ...) with ``target``; also the words of the mix
    and the number of sources.

    By weight, none above ``repeat`` times its size; the excess goes on by weight.  So a
    target is the water level times the weight, or the limit; each round takes out the
    sources that the level of the round before fills.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage_table(in_order(sources).withColumn("weight", weight).drop("place"), "mixing-sources")
    words, n = sources.agg(F.sum("source_size"), F.count("*")).first()
    total, level, full = share * (words or 0), 0.0, -1
    limit = F.col("source_size") * float(repeat)
    while True:
        filled = F.lit(level) * F.col("weight") >= limit
        now, held, open_ = sources.agg(
            F.count_if(filled), F.sum(F.when(filled, limit).otherwise(0.0)), F.sum(F.when(filled, 0.0).otherwise(F.col("weight")))
        ).first()
        if now == full or not open_:
            break
        full, level = now, (total - held) / open_
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit)).drop("weight"), total, n


def with_shards(quotas: DataFrame, sources: int, shards: int, seed: int) -> DataFrame:
    """``quotas`` (key, draws) with ``until`` and ``shard``: the draws of a source below
    until[0] belong to shard[0], and so on."""
    groups = min(GROUPS, max(1, -(-sources // GROUP_SOURCES)))
    quotas = quotas.withColumn("group", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(groups)).cast("int"))
    totals = {r["group"]: r["n"] for r in quotas.groupBy("group").agg(F.sum("draws").alias("n")).collect()}  # <= GROUPS rows
    names = sorted(totals)
    # at most GROUPS x MAX_SHARDS numbers
    parts = dict(zip(names, map(list, zip(*split_quotas([totals[g] for g in names], shards, seed), strict=True)), strict=True))

    def split(frame):
        import pandas as pd

        frame = frame.sort_values("key")
        g = int(frame["group"].iloc[0])
        used = [0] * len(frame)
        until, owner = [[] for _ in used], [[] for _ in used]
        for shard, counts in enumerate(split_quotas(frame["draws"].tolist(), parts[g], [seed, g])):
            for i, n in enumerate(counts):
                if n:
                    used[i] += n
                    until[i].append(used[i])
                    owner[i].append(shard)
        return pd.DataFrame({"key": frame["key"].to_numpy(), "until": until, "shard": owner})

    return quotas.groupBy("group").applyInPandas(split, "key string, until array<long>, shard array<int>")


def draws(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, tie (a hash of the row), source, size,
    source_size, target and ``draws``, an array of (words to take from the start, shard,
    part of the shard, place in it)."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # nulls equal, and apart from ''
    rows = docs.select("doc_id", row_hash(docs).alias("tie"), key.alias("key"), "source", text_size(F.col("text")).alias("size"))
    rows = stage_table(rows, "mixing-sizes")
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources, words, n = with_targets(sources, weights, share, repeat)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.drop("source").withColumn("passes", passes)
    sources = sources.withColumn("rest", F.rint(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    sources = sources.withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int"))
    sources = stage_table(sources, "mixing-sources")
    block = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), "blocks").cast("int")
    rows = stage_table(join_per_key(rows, sources, "key", "rows").withColumn("block", block).drop("blocks", "rows"), "mixing-rows")

    sums = rows.groupBy("key", "block", "rest", "passes").agg(F.sum("size").alias("block_size"))
    order = Window.partitionBy("key").orderBy(F.xxhash64("key", "block", F.lit(seed + 1)), "block")
    before = F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("block_size")
    quota = F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("rest") - before))
    blocks = sums.select("key", "block", "passes", (F.row_number().over(order) - 1).alias("turn"), quota.alias("quota"))
    blocks = stage_table(blocks, "mixing-blocks")

    # quotas in draws: every block once per pass, then the blocks of the rest
    counted = blocks.groupBy("key", "passes").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("quota") > 0).alias("part"))
    counted = stage_table(counted.withColumn("draws", F.col("passes") * F.col("n_blocks") + F.col("part")), "mixing-quotas")
    shards = shards or int(min(MAX_SHARDS, max(MIN_SHARDS, words // SHARD_WORDS)))
    parts = max(1, int(words // (shards * SHARD_WORDS)))
    owners = with_shards(counted.select("key", "draws"), n, shards, seed)
    owners = stage_table(counted.select("key", "n_blocks").join(owners, "key"), "mixing-owners")
    each = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda p: F.struct(p.alias("pass"), (p * F.col("n_blocks") + F.col("turn")).alias("draw")))
    each = F.filter(each, lambda d: (d["pass"] < F.col("passes")) | (F.col("quota") > 0))
    first = lambda d: F.array_position(F.transform("until", lambda u: u > d["draw"]), True).cast("int")
    each = F.transform(each, lambda d: F.struct(d["pass"], d["draw"], F.element_at("shard", first(d)).alias("shard")))
    blocks = join_per_key(blocks, owners, "key", "n_blocks").select("key", "block", "quota", each.alias("each"))

    rows = rows.join(blocks, ["key", "block"])
    inside = Window.partitionBy("key", "block").orderBy(F.xxhash64("doc_id", "tie", F.lit(seed + 2)), "doc_id", "tie")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    copy = F.row_number().over(inside)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - (upto - F.col("size"))))
    rows = rows.withColumn("cut", part).withColumn("copy", copy)
    taken = F.transform(
        "each",
        lambda d: F.struct(
            F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("cut")).alias("words"), d["shard"].alias("shard"),
            F.pmod(F.xxhash64("doc_id", "tie", "copy", d["draw"], F.lit(seed + 4)), F.lit(parts)).cast("int").alias("part"),
            F.xxhash64("doc_id", "tie", "copy", d["draw"], F.lit(seed + 3)).alias("place"),
        ),
    )
    return rows.select("doc_id", "tie", "source", "size", "source_size", "target", F.filter(taken, lambda d: d["words"] > 0).alias("draws"))


def row_hash(docs: DataFrame) -> Column:
    """Hash of a whole row (maps have none and are left out)."""
    return F.xxhash64(*[f.name for f in docs.schema.fields if not isinstance(f.dataType, MapType)])


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``, one row per draw, dealt to
    output shards and ordered at random inside each; a document that is cut keeps
    the words taken from its start (and n_chars follows its text)."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = draws(docs, **options).where(F.size("draws") > 0).select(own.alias("own"), "tie", "size", "draws")
    # equal rows are one row here, with the draws of all
    drawn = drawn.groupBy("own", "tie").agg(F.first("size").alias("size"), F.flatten(F.collect_list("draws")).alias("draws"))
    whole = docs.select(own.alias("own"), row_hash(docs).alias("tie"), F.struct(*docs.columns).alias("doc"))
    whole = whole.withColumn("copy", F.row_number().over(Window.partitionBy("own", "tie").orderBy("own"))).where("copy = 1")
    rows = whole.join(drawn, ["own", "tie"]).select("size", "doc", F.explode("draws").alias("d"))
    # possessive, so that Java matches any number of words without recursion
    first_words = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("d.words").cast("string"), F.lit("}+"))
    kept = F.when(F.col("d.words") >= F.col("size"), F.col("doc.text")).otherwise(
        F.call_function("regexp_extract", F.col("doc.text"), first_words, F.lit(0))
    )
    rows = rows.select("d", "doc", kept.alias("kept"))
    columns = [
        F.col("kept").alias(c) if c == "text"
        else F.when(F.col("doc.n_chars").isNotNull(), F.length("kept")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return rows.repartition("d.shard", "d.part").sortWithinPartitions("d.shard", "d.part", "d.place").select(*columns)
