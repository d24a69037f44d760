"""MinHash near-duplicate classes with HyperMinHash registers.

Every distinct shingle set gets one signature of ``REGISTERS`` registers: a
shingle hash picks a register with its top bits, and the register keeps the
smallest remainder as a leading-zero count and mantissa bits (two bytes).
Bands of four registers are compared for equality; pairs of a band are then
estimated from all registers (corrected for chance collisions) and confirmed on
the full shingle sets.

Skew.  Equal shingle sets are one row before banding, whatever their doc_ids, so
copies cost one row each and nothing more.  Its key orders sets by their smallest
doc_id and then by the set, so two texts under one doc_id stay two sets.  Buckets,
clusters and hubs that hold many rows are joined by broadcast (``join_per_key``).  Links are then looked for in three
rounds, none of which expands a group into all of its pairs:

1. stars: in a band bucket, members are paired with the bucket's smallest member
   only; promising pairs are confirmed and give components, and all promising
   pairs, confirmed or not, give clusters of similar texts;
2. stragglers: in a cluster of several components, members outside the largest
   are compared with the other members, in blocks inside tasks that keep the full
   sets at hand and report one link per pair of components;
3. leftovers: members of one bucket that lie in different clusters are compared
   by their registers inside tasks, and promising pairs are confirmed.

So any two members of a bucket are either connected or compared, and no link
between members of a bucket is lost.  Components come from alternating large-star
and small-star steps over edge tables in the shared folder.

Recall.  At similarity s a band of 4 registers agrees with probability s**4 and
one of 32 bands with 1-(1-s**4)**32: over 0.9999999 at 0.8.

Defined cases: a null or blank text has an empty set, is linked with nothing
and forms its own class; a text with fewer words than the shingle length has
one shingle, its whole word sequence; repeated rows (equal doc_id and text) are
returned once per row with the same class; different texts under one doc_id are
linked each by itself; a null doc_id is kept, with component_id null unless its
class has another id; a row without a set is its own class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_per_key, stage_table

REGISTERS = 128
BAND = 4
MANTISSA_BITS = 10
#: Members of a bucket that one task compares with each other at once.
CHUNK = 4096
#: Members of a cluster whose full texts one task holds at once, on either side.
TEXT_CHUNK = 512
#: The estimate has a standard error of 0.036 at 0.8; pairs are dropped unseen
#: only when it lies this far below the threshold (over four standard errors).
ESTIMATE_SLACK = 0.15
_EMPTY_BAND = "X'" + "00" * (2 * BAND) + "'"


# --- inside tasks ---------------------------------------------------------

_UPPER = {c: c + 32 for c in range(65, 91)}


def _shingle_hashes(text, n):
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of one text."""
    import numpy as np
    import xxhash

    if not text:
        return np.empty(0, np.uint64)
    # str.split() also cuts at other spaces, so the six ASCII ones are used explicitly
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", text.translate(_UPPER))
    if not ws:
        return np.empty(0, np.uint64)
    known = {}
    for w in ws:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in ws), np.uint64, len(ws))
    k = min(n, len(ws))
    with np.errstate(over="ignore"):
        acc = np.full(len(ws) - k + 1, len(ws) if len(ws) < n else n, np.uint64)
        for j in range(k):  # position-dependent mixing of the word hashes
            acc ^= h[j : len(ws) - k + 1 + j]
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def _registers(hashes):
    """HyperMinHash registers of sorted distinct hashes, as big-endian bytes; 0 is empty."""
    import numpy as np

    bits = REGISTERS.bit_length() - 1
    out = np.zeros(REGISTERS, ">u2")
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])  # sorted: the first is the smallest
        rest = hashes[first] << np.uint64(bits)
        exact = np.frexp(np.maximum(rest, np.uint64(1)).astype(np.float64))
        zeros = np.clip(64 - exact[1], 0, 61)
        mantissa = np.floor((exact[0] * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
        out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS) | np.clip(mantissa, 0, (1 << MANTISSA_BITS) - 1)
    return out.tobytes()


def _sign(batches, n):
    import pyarrow as pa
    import xxhash

    for b in batches:
        rows = [(h := _shingle_hashes(t, n), len(h)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("row_key"),
                pa.array([k for _, k in rows], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) if k else None for h, k in rows], pa.binary()),
                pa.array([_registers(h) for h, _ in rows], pa.binary()),
            ],
            ["doc_id", "row_key", "n_shingles", "set_id", "signature"],
        )


def _estimates(a, b):
    """Corrected Jaccard estimates of register matrices (rows broadcast)."""
    import numpy as np

    either = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    # Two independent minima fall into one cell of width x/2**r: 1/(8 ln 2) of 2**-r.
    chance = 0.18 / (1 << MANTISSA_BITS)
    return np.clip((same / np.maximum(either, 1) - chance) / (1 - chance), 0, 1)


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, REGISTERS)


def _size_fits(n_a, n_b, percent):
    """A similarity cannot exceed the ratio of the set sizes."""
    import numpy as np

    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _estimate_pairs(batches, least, percent):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            keep = _estimates(_matrix(b.column("sig_a")), _matrix(b.column("sig_b"))) >= least
            keep &= _size_fits(b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)
            yield b.select(["a", "b"]).filter(pa.array(keep))


def _leftover_pairs(frame, least, percent):
    """Promising pairs of buckets (or of two chunks of one) across clusters."""
    import numpy as np
    import pandas as pd

    frame = frame.sort_values(["band", "lo", "hi"], kind="stable")
    sig = np.frombuffer(b"".join(frame["signature"]), ">u2").astype(np.uint16).reshape(-1, REGISTERS)
    ids, names = pd.factorize(frame["id"].map(bytes), sort=True)  # numbers in the order of the keys
    root, size, chunk = pd.factorize(frame["root"].map(bytes))[0], frame["n_shingles"].to_numpy(), frame["chunk"].to_numpy()
    key = frame[["band", "lo", "hi"]].to_numpy()
    cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(frame)]
    todo, found, waiting = [], set(), 0

    def flush():
        i, j = np.concatenate([x for x, _ in todo]), np.concatenate([y for _, y in todo])
        ok = _estimates(sig[i], sig[j]) >= least
        found.update(zip(np.minimum(ids[i], ids[j])[ok].tolist(), np.maximum(ids[i], ids[j])[ok].tolist(), strict=True))
        todo.clear()

    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = key[s, 1], key[s, 2]
        for i in range(s, e):
            if chunk[i] != lo:
                continue
            j = np.arange(i + 1 if lo == hi else s, e)
            j = j[(chunk[j] == hi) & (root[j] != root[i]) & _size_fits(size[i], size[j], percent)]
            if len(j):
                todo.append((np.full(len(j), i), j))
                waiting += len(j)
            if waiting > 20_000:
                flush()
                waiting = 0
    if todo:
        flush()
    return _named(sorted(found), names)


def _named(pairs, names):
    """Pairs of positions in ``names`` as a frame of keys."""
    import pandas as pd

    return pd.DataFrame({"a": [names[i] for i, _ in pairs], "b": [names[j] for _, j in pairs]}, dtype=object)


def _straggler_links(frame, n, least, percent):
    """Links that connect components of clusters: rows of side 0 (stragglers) against
    rows of side 1 (all members) of the same cluster and block."""
    # a task holds one deal of blocks; ids are numbered in it
    import numpy as np
    import pandas as pd

    links, sets = [], {}
    frame["id"], names = pd.factorize(frame["id"].map(bytes), sort=True)
    frame["root"], frame["cluster"] = pd.factorize(frame["root"].map(bytes))[0], pd.factorize(frame["cluster"].map(bytes))[0]
    for _, g in frame.groupby(["cluster", "lo", "hi"], sort=False):
        sets.clear()
        for i, t in zip(g["id"], g["text"], strict=True):
            if i not in sets:
                sets[i] = _shingle_hashes(t, n)
        left, right = g[g["side"] == 0], g[g["side"] == 1]
        ids, comps = right["id"].to_numpy(), right["root"].tolist()
        size = np.array([len(sets[i]) for i in ids])
        sig = np.frombuffer(b"".join(_registers(sets[i]) for i in ids), ">u2").astype(np.uint16).reshape(-1, REGISTERS)
        parent = {}

        def top(c, parent=parent):
            while c in parent:
                c = parent[c]
            return c

        for i, c in zip(left["id"], left["root"], strict=True):
            own = sets[i]
            est = _estimates(sig, np.frombuffer(_registers(own), ">u2").astype(np.uint16))
            for j in np.argsort(-est, kind="stable"):
                if est[j] < least:
                    break
                x, y = top(c), top(comps[j])
                if x == y or not _size_fits(len(own), size[j], percent):
                    continue
                both = len(np.intersect1d(own, sets[ids[j]], assume_unique=True))
                if 100 * both >= percent * (len(own) + size[j] - both):
                    links.append((min(i, ids[j]), max(i, ids[j])))
                    parent[x] = y
    return _named(sorted(set(links)), names)


def _confirm(batches, n, percent):
    """Keep the pairs whose full shingle sets have the asked similarity."""
    import numpy as np
    import pyarrow as pa

    last = (None, None)
    for b in batches:
        keep = []
        for a_id, ta, tb in zip(b.column("a").to_pylist(), b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
            if last[0] != a_id:
                last = (a_id, _shingle_hashes(ta, n))
            sa, sb = last[1], _shingle_hashes(tb, n)
            both = len(np.intersect1d(sa, sb, assume_unique=True))
            keep.append(100 * both >= percent * (len(sa) + len(sb) - both) and both > 0)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


# --- plans ----------------------------------------------------------------


def signatures(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, set_id (128-bit hash of the shingle
    set) and registers."""
    return docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(
        lambda it: _sign(it, shingle_words),
        "doc_id long, row_key long, n_shingles long, set_id binary, signature binary",
    )


def set_key(doc_id: Column, set_id: Column) -> Column:
    """Binary key that sorts by doc_id, null last, and then by the set."""
    shown = F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(doc_id.isNull(), "01").otherwise("00"), shown, F.substring(F.hex(set_id), 1, 16)))


def doc_id_of(key: Column) -> Column:
    """The doc_id in a set's key."""
    shown = F.hex(key)
    # 16 hexadecimal digits as two unsigned halves
    half = lambda at: F.conv(F.substring(shown, at, 8), 16, 10).cast("long")
    value = F.shiftleft(half(3), 32).bitwiseOR(half(11)).bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.substring(shown, 1, 2) == "00", value)


def star_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, root)`` for every id
    in an edge, root being the smallest id reachable.

    Alternates large-star (every larger neighbour to the smallest neighbour) and
    small-star (every smaller neighbour to the smallest); each step's edges are a
    table in the shared folder.  Stops when a round leaves the edges unchanged.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links = stage_table(links, label)
    mark = None
    while True:
        both = links.union(links.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        near = stage_table(near.select("u", F.least("u", "m").alias("m"), "n"), label)
        large = join_per_key(both, near, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stage_table(large, label)
        near = stage_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), label)
        small = (
            join_per_key(large, near, "u", "n")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        links = stage_table(small, label)
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row_key (hash of the text), n_shingles, component_id, kept and class_key
    for every row of ``docs``; rows of one class have equal class_keys, null without a set.

    Links are pairs with ``100 * |A & B| >= percent * |A | B|``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage_table(signatures(docs, shingle_words), "neardup-signed")
    filled = signed.where("n_shingles > 0")
    # one row per set: its key, its copies, and where its text is
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n_shingles", "signature")).alias("first")
    sets = filled.groupBy("set_id").agg(first, F.count("*").alias("copies"))
    sets = sets.select(set_key(F.col("first.doc_id"), F.col("set_id")).alias("id"), "set_id", "copies", "first.doc_id", "first.row_key", "first.n_shingles", "first.signature")
    sets = stage_table(sets, "neardup-sets")
    least = percent / 100 - ESTIMATE_SLACK
    again = not signed.groupBy("doc_id", "row_key").agg(F.count("*").alias("c")).where("c > 1").isEmpty()

    def texts(ids: DataFrame) -> DataFrame:
        """id and text of the sets asked for, stored."""
        places = sets.join(ids.distinct(), "id").select("id", F.col("doc_id").alias("at_id"), F.col("row_key").alias("at_key"))
        here = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.xxhash64("text") == F.col("at_key"))
        found = docs.join(places, here).select("id", "text")
        return stage_table(found.dropDuplicates(["id"]) if again else found, "neardup-texts")

    piece = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
            lambda k: F.struct(k.alias("k"), F.substring("signature", k * (2 * BAND) + 1, F.lit(2 * BAND)).alias("v")),
        )
    )
    bands = (
        sets.select("id", piece.alias("p"))
        .where(f"p.v <> {_EMPTY_BAND}")
        .select("id", F.xxhash64("p.k", "p.v").alias("band"))
    )
    pivots = stage_table(bands.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"), "neardup-pivots")
    members = stage_table(join_per_key(bands, pivots, "band", "n"), "neardup-bands")  # only buckets that hold more than one set

    star = members.where("id > a").select("a", F.col("id").alias("b")).distinct()
    star = stage_table(_promising(star, sets, least, percent), "neardup-promising")
    clusters = star_components(star)
    near = texts(star.select(F.col("a").alias("id")).union(star.select("b")))
    links = stage_table(_confirmed(star, near, shingle_words, percent), "neardup-links")
    roots = star_components(links)

    placed = clusters.withColumnRenamed("root", "cluster").join(roots, "id", "left")
    placed = stage_table(placed.select("id", "cluster", F.coalesce("root", "id").alias("root")), "neardup-clusters")
    inside = _stragglers(placed, near, shingle_words, least, percent)
    links = links.union(stage_table(inside, "neardup-links"))

    labelled = members.join(placed.select("id", "cluster"), "id", "left").select("band", "id", "n", F.coalesce("cluster", "id").alias("root"))
    labelled = stage_table(labelled, "neardup-labelled")
    split = labelled.groupBy("band", "n").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_ = join_per_key(labelled.drop("n"), stage_table(split.select("band", "n"), "neardup-split"), "band", "n")
    crossed = stage_table(_leftovers(stage_table(open_, "neardup-open"), sets, least, percent), "neardup-crossed")
    far = texts(crossed.select(F.col("a").alias("id")).union(crossed.select("b")))
    links = links.union(stage_table(_confirmed(crossed, far, shingle_words, percent), "neardup-links"))
    roots = star_components(links)

    of_set = sets.join(roots, "id", "left").select("set_id", "copies", F.coalesce("root", "id").alias("class_key"))
    of_set = stage_table(of_set, "neardup-classes")
    columns = ["doc_id", "row_key", "n_shingles"]
    rows = join_per_key(filled.select(*columns, "set_id"), of_set, "set_id", "copies").select(*columns, doc_id_of(F.col("class_key")).alias("component_id"), "class_key")
    blank = signed.where("n_shingles = 0").select(*columns, F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("class_key"))
    return rows.union(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _promising(pairs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    sig = sets.select("id", "n_shingles", "signature")
    rows = pairs.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
    return rows.mapInArrow(lambda it: _estimate_pairs(it, least, percent), "a binary, b binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    rows = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return (
        rows.select("a", "b", "text_a", "text_b")
        .mapInArrow(lambda it: _confirm(it, n, percent), "a binary, b binary")
        .distinct()
    )


def _stragglers(placed: DataFrame, texts: DataFrame, n: int, least: float, percent: int) -> DataFrame:
    """Links found between the members of a cluster outside its largest component and
    the rest of the cluster."""
    sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("c"))
    sizes = sizes.groupBy("cluster").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"))
    open_ = sizes.where("most.c < all").select(
        "cluster", "all", F.col("most.root").alias("main"),
        F.ceil((F.col("all") - F.col("most.c")) / TEXT_CHUNK).cast("int").alias("n_lo"),
        F.ceil(F.col("all") / TEXT_CHUNK).cast("int").alias("n_hi"),
    )
    rows = stage_table(join_per_key(placed, stage_table(open_, "neardup-open"), "cluster", "all"), "neardup-stragglers")
    deals = max(1, rows.count() // TEXT_CHUNK)
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = F.transform(every("n_hi"), lambda h: F.struct(F.lit(0).alias("side"), own("n_lo").alias("lo"), h.alias("hi")))
    right = F.transform(every("n_lo"), lambda x: F.struct(F.lit(1).alias("side"), x.alias("lo"), own("n_hi").alias("hi")))
    sides = F.when(F.col("root") != F.col("main"), F.concat(left, right)).otherwise(right)
    deal = F.when(F.col("n_hi") > 1, F.xxhash64("cluster", "b.lo", "b.hi")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(deals)))
    rows = rows.join(texts, "id").select("cluster", "id", "root", "text", "n_hi", F.explode(sides).alias("b"))
    rows = rows.select(deal.alias("deal"), "cluster", "id", "root", "text", "b.side", "b.lo", "b.hi")
    return rows.groupBy("deal").applyInPandas(lambda f: _straggler_links(f, n, least, percent), "a binary, b binary").distinct()


def _leftovers(members: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Promising pairs across clusters, bucket by bucket; a bucket of more than
    ``CHUNK`` members is compared chunk against chunk in separate groups."""
    deals = max(1, members.count() // CHUNK)
    rows = (
        members.join(sets, "id")
        .withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("chunk", "other"))
        .withColumn("hi", F.greatest("chunk", "other"))
        # small buckets share groups, so that a group is more than a few rows
        .withColumn("deal", F.when(F.col("n") > 256, F.xxhash64("band", "lo", "hi")).otherwise(F.pmod(F.xxhash64("band"), F.lit(deals))))
    )
    return (
        rows.select("deal", "band", "lo", "hi", "chunk", "id", "root", "n_shingles", "signature")
        .groupBy("deal")
        .applyInPandas(lambda f: _leftover_pairs(f, least, percent), "a binary, b binary")
        .distinct()
    )
