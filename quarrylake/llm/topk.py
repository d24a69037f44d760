"""Exact top-k by inner product through distributed histogram selection.

Queries and candidates are packed into blocks; every pair of blocks is scored as
one integer matrix product.  A pass counts, for each query, scores in equal bins
of a range that is sure to hold its kth best score; Spark adds the counts up and
narrows the range to the bin of the kth score.  A block reports only its bins
from the top down to its own kth score, at most k non-empty ones, since the
global kth score cannot lie lower.  Queries leave the loop when the bin's floor
lets few enough scores through, or when the bin is one integer wide.  A last pass
keeps the scores at or above each query's floor, at most k per block in final
order, so that even a floor shared by very many equal vectors gives k rows a
block; ranks break ties by the smaller vec_id.

Products are taken in float64, which is exact while |q|.|c| sums stay below 2**53
(checked from the data), and in Python integers beyond; scores are longs while they
surely fit, else decimal(38, 0).

A block of queries goes to every block of candidates and back, so what is moved is
rows / ``BLOCK`` + rows / ``QUERY_BLOCK`` times the input; a task holds one pair of
blocks, and scores ``STEP`` queries of it at a time.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part; components above ``LARGEST`` in size count as that; shorter vectors
count as padded with zeros; a candidate with the query's own vec_id is never its
answer; repeated rows of a vec_id are separate candidates, and one query; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

BLOCK, QUERY_BLOCK, STEP = 4096, 4096, 256
BINS = 512
#: A floor that lets through at most so many times k scores needs no finer bins.
ENOUGH = 8
#: Largest component: products of 65,536 of them stay below 10**38.
LARGEST = 1 << 55


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v = floor(64 x) as long, for vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fit)
    within = lambda e: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), e * 64))
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(within(e)).cast("long")).alias("v"))


def _packer(dim, kind, extra):
    def pack(frame):
        import numpy as np
        import pandas as pd

        m = np.zeros((len(frame), dim), kind)
        for i, v in enumerate(frame["v"]):
            m[i, : len(v)] = v
        row = {"b": frame["b"].iloc[:1].to_numpy(), "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "mat": [m.tobytes()]}
        for c in extra:
            row[c] = [",".join(str(int(x)) for x in frame[c])]
        return pd.DataFrame(row)

    return pack


def _blocks(rows, size, dim, kind, extra=()):
    n = max(1, -(-rows.count() // size))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    schema = "b int, ids binary, mat binary" + "".join(f", {c} string" for c in extra)
    return rows.groupBy("b").applyInPandas(_packer(dim, kind, extra), schema), n


def _scores(q, c, dim, kind, exact):
    """For ``STEP`` queries at a time of every block pair: their ids, low and width as
    columns, the candidates' ids, the scores, and which of them count."""
    import numpy as np

    wide = np.int64 if exact else object
    for q_ids, q_mat, *bins in zip(*(q.column(x).to_pylist() for x in ("q_ids", "q_mat", "low", "width")), strict=True):
        low, width = (np.array([int(x) for x in b.split(",")], wide)[:, None] for b in bins)
        q_ids, q_mat = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_mat, kind).reshape(-1, dim)
        for c_ids, c_mat in zip(c.column("ids").to_pylist(), c.column("mat").to_pylist(), strict=True):
            c_ids = np.frombuffer(c_ids, "<i8")
            right = np.frombuffer(c_mat, kind).reshape(-1, dim).astype(float if exact else object).T
            for a in range(0, len(q_ids), STEP):
                ids = q_ids[a : a + STEP]
                left = q_mat[a : a + STEP].astype(float if exact else object)
                s = (left @ right).astype(wide)
                yield ids, low[a : a + STEP], width[a : a + STEP], c_ids, s, ids[:, None] != c_ids[None, :]


def _histogram(q, c, dim, kind, exact, k):
    """Bins of one block pair from the top down to its own kth score, by query."""
    import numpy as np
    import pyarrow as pa

    out = [[np.empty(0, np.int64)] for _ in range(3)]
    for ids, low, width, _, s, ok in _scores(q, c, dim, kind, exact):
        at = np.where(ok & (s >= low), np.minimum((s - low) // width, BINS), -1).astype(np.int64) + 1
        flat = (at + np.arange(len(ids))[:, None] * (BINS + 2)).ravel()
        n = np.bincount(flat, minlength=len(ids) * (BINS + 2)).reshape(len(ids), -1)[:, :0:-1]
        i, b = np.nonzero((n > 0) & (np.cumsum(n, 1) - n < k))
        for o, x in zip(out, (ids[i], BINS - b, n[i, b]), strict=True):
            o.append(x)
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "bin", "n"])


def _survivors(q, c, dim, kind, exact, k):
    """The scores of one block pair at or above each query's floor, the k best at most."""
    import numpy as np
    import pyarrow as pa

    out = [[], [], []]
    for ids, low, _, c_ids, s, ok in _scores(q, c, dim, kind, exact):
        i, j = np.nonzero(ok & (s >= low))
        best = s[i, j]
        if exact:
            order = np.lexsort((c_ids[j], -best, i))
        else:
            order = np.array(sorted(range(len(i)), key=lambda t: (i[t], -best[t], c_ids[j[t]])), np.int64)
        i, j, best = i[order], j[order], best[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        for o, x in zip(out, (ids[i], c_ids[j], best), strict=True):
            o += x[place < k].tolist()
    kinds = [pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(x, t) for x, t in zip((out[0], out[1], map(str, out[2])), kinds, strict=True)], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates.

    Both sides are ``quantised`` frames.
    """
    def size(v):  # vectors' length, largest component, largest Euclidean norm
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
        return v.select(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(norm)).first()

    (c_dim, peak, reach), (q_dim, q_peak, _) = size(candidates), size(queries)
    dim, peak, q_peak = max(1, c_dim or 0, q_dim or 0), peak or 0, q_peak or 0
    bound = dim * peak * q_peak
    exact = bound < 1 << 53
    number = "long" if bound < 1 << 60 else "decimal(38,0)"
    kind = "<i2" if max(peak, q_peak) < 1 << 15 else "<i8"

    blocks, n_blocks = _blocks(candidates, BLOCK, dim, kind)
    blocks = stage_table(blocks, "topk-blocks")

    def pairs(asked, score, schema):
        # one group is one pair of blocks, so a task holds one pair at a time
        packed, n = _blocks(asked, QUERY_BLOCK, dim, kind, ("low", "width"))
        left = packed.toDF("qb", "q_ids", "q_mat", "low", "width").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        both = left.groupBy("qb", "b").cogroup(right.groupBy("qb", "b"))
        return both.applyInArrow(lambda x, y: score(x, y, dim, kind, exact, k), schema)

    # no score is larger than the product of the norms
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    most = (norm * F.lit(float(reach or 0)) * (1 + 1e-9) + 1).cast("decimal(38,0)")
    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", most.alias("most"))
    finer = lambda w: F.when(w < float(1 << 50), F.ceil(w / BINS).cast("double")).otherwise(w / BINS * (1 + 1e-9) + 1).cast("decimal(38,0)").cast(number)
    width = finer(2 * F.col("most").cast("double") + 1)
    asked = asked.select("vec_id", "v", (-F.col("most")).cast(number).alias("low"), width.alias("width"), F.lit(0).cast("long").alias("above"))
    asked, settled = stage_table(asked, "topk-queries"), []
    while True:
        counts = pairs(asked, _histogram, "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        # scores above the range are in the last bin, which stands for all of them
        cum = counts.withColumn("cum", F.sum("n").over(down))
        found = cum.where(F.col("cum") >= k).groupBy("query_id").agg(F.max(F.struct("bin", "cum")).alias("f"))
        found = found.select(F.col("query_id").alias("vec_id"), F.col("f.bin").alias("bin"), F.col("f.cum").alias("cum"))
        state = asked.join(found, "vec_id", "left")
        state = state.select(
            "vec_id", "v",
            F.when(F.col("bin").isNotNull(), F.col("low") + F.col("bin") * F.col("width")).otherwise(F.col("low")).cast(number).alias("low"),
            F.when(F.col("bin").isNotNull(), finer(F.col("width").cast("double"))).otherwise(F.lit(1).cast(number)).alias("width"),
            F.coalesce("cum", F.lit(0)).cast("long").alias("above"),
            (F.col("bin").isNull() | (F.col("width") == 1) | (F.col("cum") <= ENOUGH * k)).alias("done"),
        )
        state = stage_table(state, "topk-queries")
        settled.append(state.where("done").drop("done"))
        asked = state.where("not done").drop("done")
        if asked.isEmpty():
            break
    ready = settled[0]
    for s in settled[1:]:
        ready = ready.union(s)
    kept = pairs(ready, _survivors, "query_id long, vec_id long, score string").withColumn("score", F.col("score").cast(number))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
