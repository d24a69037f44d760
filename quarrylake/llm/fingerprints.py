"""I-Match document fingerprints over several randomised lexicon subsets.

The lexicon holds every term whose inverse document frequency log2(N / n(t)) lies
in a band.  Such terms occur in at least N / 2**IDF_HIGH rows, so there are at
most 2**IDF_HIGH times the mean number of distinct terms of a row, whatever the
corpus size.  Up to ``TABLE_TERMS`` of them travel inside the plan as a hash table, and
texts are fingerprinted without a shuffle; a larger lexicon (of very long documents)
is joined with the texts' terms instead, with the same result.

``GROUPS`` independent hashes give each term random subsets at ``LEVELS`` sampling
rates 1/2, 1/4, ...  A text's field for a subset hashes its sorted
distinct terms in that subset.  Dense subsets react to any edit, sparse ones keep
their hash while their few terms stay, so that the share of equal fields, taken
where fields hold about one term, follows the share of common terms.

The next document (descending doc_id, after the last the first) is found without
a global sort: rows are dealt to ranges of ids that hold about as many rows each
(from quantiles; an id or null in very many rows is cut further by a hash of the text),
each range also gets the first row of the range below, and windows look one row ahead
inside ranges.

Defined cases: a null text is empty; a text without lexicon terms is identified
by its word sequence; repeated rows are neighbours of each other, in a fixed
order; a null doc_id sorts after all others; a table of one row has itself as
next; ids may be any longs; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stage_table

IDF_LOW, IDF_HIGH = 3.0, 9.0
LEVELS, GROUPS, DIGITS = 12, 8, 4
FIELDS = LEVELS * GROUPS
EMPTY = "-" * DIGITS
NOT_TERM = r"[^\p{L}\p{N}]+"
#: Terms that travel inside the plan (8 bytes each).
TABLE_TERMS = 1 << 20
#: Rows of an id range, on average: at least so many, and more beyond ``RANGES`` ranges.
RANGE_ROWS, RANGES = 1024, 4096


def terms(text: Column) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_distinct(F.split(F.lower(text), NOT_TERM))


def lexicon(docs: DataFrame, low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """``h``, the hashes of all terms in the idf band."""
    total = docs.count()
    counts = docs.where("text is not null").select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log2(F.lit(float(max(total, 1))) / F.col("n"))
    return counts.where((F.col("n") > 1) & (F.col("term") != "") & idf.between(low, high)).select(F.xxhash64("term").alias("h"))


def within(known: DataFrame, size: int):
    """Test of a term against the lexicon as a constant hash table: the hashes by slot
    (``h mod number of slots``) and where each slot begins, as two folded literals."""
    slots = 1 << max(4, (size - 1).bit_length())
    hashes = sorted((r["h"] for r in known.collect()), key=lambda h: h % slots)  # at most TABLE_TERMS
    begins = [0] * (slots + 1)
    for h in hashes:
        begins[h % slots + 1] += 1
    begins = list(accumulate(begins))
    literal = lambda v, kind: F.split(F.lit(",".join(map(str, v))), ",").cast(f"array<{kind}>")
    begins, hashes = literal(begins, "int"), literal(hashes or [0], "bigint")

    def inside(w: Column) -> Column:
        slot = F.pmod(F.xxhash64(w), F.lit(slots)).cast("int")
        first = F.get(begins, slot)
        return F.array_contains(F.slice(hashes, first + 1, F.get(begins, slot + 1) - first), F.xxhash64(w))

    return inside


def with_band_terms(rows: DataFrame, known: DataFrame, **texts: str) -> DataFrame:
    """``rows`` with, for each ``name=column``, the sorted lexicon terms of that text as
    the array ``name``."""
    size = known.count()
    if size <= TABLE_TERMS:
        inside = within(known, size)
        return rows.select("*", *[F.array_sort(F.filter(terms(F.col(c)), inside)).alias(n) for n, c in texts.items()])
    rows = stage_table(rows.withColumn("row_id", F.monotonically_increasing_id()), "imatch-rows")
    out = rows
    for n, c in texts.items():
        each = rows.select("row_id", F.explode(terms(F.col(c))).alias("term")).withColumn("h", F.xxhash64("term"))
        mine = each.join(known, "h").groupBy("row_id").agg(F.array_sort(F.collect_list("term")).alias(n))
        out = out.join(mine, "row_id", "left").withColumn(n, F.coalesce(n, F.expr("cast(array() as array<string>)")))
    return out.drop("row_id")


def fingerprint(words: Column, text: Column) -> Column:
    """Fixed-width fields of sorted lexicon terms, one per subset, then an identity of
    ``text`` if it has no such terms."""
    rolled = F.transform(words, lambda w: F.struct(w.alias("w"), *[F.xxhash64(w, F.lit(g)).alias(f"h{g}") for g in range(GROUPS)]))

    def fields(group: int) -> Column:
        # a level keeps the terms of the level before whose next hash bit is 0
        def step(acc: Column, level: Column) -> Column:
            mine = F.filter(acc["kept"], lambda x: F.getbit(x[f"h{group}"], level) == 0)
            code = F.lpad(F.substring(F.lower(F.hex(F.xxhash64(F.transform(mine, lambda x: x["w"])))), -DIGITS, DIGITS), DIGITS, "0")
            return F.struct(mine.alias("kept"), F.concat(acc["out"], F.when(F.size(mine) == 0, EMPTY).otherwise(code)).alias("out"))

        zero = lambda k: F.struct(k.alias("kept"), F.lit("").alias("out"))
        return lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), zero(k), step, lambda a: a["out"])

    every = let(rolled, lambda k: F.concat(*[fields(g)(k) for g in range(GROUPS)]))
    blank = EMPTY * FIELDS
    identity = F.concat(F.lit(blank), F.lower(F.hex(F.xxhash64(F.split(F.lower(text), NOT_TERM)))))
    return let(every, lambda x: F.when(x != blank, x).otherwise(identity))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal fields among the sparse levels, between 0 and 1.

    A level counts from the first at which one of the fingerprints has an empty
    field; fields empty on both sides say nothing.  Equal fingerprints give 1.
    """
    field = lambda s, j: F.substring(s, j * DIGITS + 1, F.lit(DIGITS))
    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(FIELDS - 1)),
        lambda j: F.struct((j % LEVELS).alias("level"), field(a, j).alias("x"), field(b, j).alias("y")),
    )
    gap = lambda p: F.array_min(F.transform(F.filter(p, lambda q: (q["x"] == EMPTY) | (q["y"] == EMPTY)), lambda q: q["level"]))
    told = lambda p, first: F.filter(p, lambda q: (q["level"] >= first) & ((q["x"] != EMPTY) | (q["y"] != EMPTY)))
    same = lambda t: F.size(F.filter(t, lambda q: q["x"] == q["y"]))
    share = let(
        pairs,
        lambda p: let(
            F.coalesce(gap(p), F.lit(LEVELS - 1)),
            lambda first: let(told(p, first), lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(same(t) / F.size(t))),
        ),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def id_ranges(docs: DataFrame) -> Column:
    """Range number of a row (doc_id, tie), ascending with (doc_id, tie), nulls first.

    Quantiles of doc_id are the bounds, so that ranges hold about as many rows each; an
    id that is a bound several times is cut into as many parts by tie, and so are nulls.
    """
    n, missing = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(2, min(RANGES, -(-n // RANGE_ROWS)))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / ranges for i in range(1, ranges)], 16 * ranges)).first()[0] or []
    bounds = sorted(set(cuts))
    literal = lambda v: F.split(F.lit(",".join(map(str, v)) or "0"), ",").cast("array<bigint>")
    found, times = literal(bounds), literal([cuts.count(x) for x in bounds])
    # tie is a hash: its upper half cut evenly
    piece = lambda k: F.shiftright((F.shiftright("tie", 32) + (1 << 31)) * k, 32)

    # binary search for the number of bounds up to the id
    step = lambda a, j: F.when((a + j <= len(bounds)) & (F.get(found, a + j - 1) <= F.col("doc_id")), a + j).otherwise(a)
    steps = [F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))] or [F.lit(1)]

    def numbered(at: Column) -> Column:
        own, k = F.get(found, at - 1), F.get(times, at - 1)
        return at.cast("long") * (1 << 20) + F.when((at > 0) & (own == F.col("doc_id")), piece(k)).otherwise(F.coalesce(k, F.lit(0)))

    several = max(1, min(RANGES, -(-missing // RANGE_ROWS)))
    known = let(F.aggregate(F.array(*steps), F.lit(0), step), numbered)
    return F.when(F.col("doc_id").isNull(), piece(F.lit(several)) - (1 << 20)).otherwise(known)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, t, ghost, ...) dealt to id ranges, and the window in which the
    row after a row is its next document; ghosts are copies of the row after a range."""
    part = id_ranges(docs).alias("part")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("text").alias("tie")).select("*", part)
    heads = docs.select("doc_id", F.xxhash64("text").alias("tie")).select("*", part)
    heads = heads.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("head"))  # at most 3 * RANGES rows
    up, all_ = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("head.doc_id").alias("head_id"), F.col("head.tie").alias("head_tie"),
        F.coalesce(F.lead("part").over(up), F.first("part").over(all_)).alias("ghost_part"),
    )
    key = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("ghost_part").alias("part"), F.lit(True).alias("ghost")))
    rows = rows.join(F.broadcast(heads), key, "left").withColumn("at", F.explode(F.filter(places, lambda p: p["part"].isNotNull())))
    rows = rows.select("doc_id", "t", "tie", F.col("at.part").alias("part"), F.col("at.ghost").alias("ghost"))
    return rows, Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("tie"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last third replaced from
    the next document), and their likeness; see the module for the edge cases."""
    docs = docs.select("doc_id", "text")
    known = stage_table(lexicon(docs), "imatch-lexicon")
    rows, ahead = with_next(docs)
    k = F.floor(F.length("t") / 3).cast("int")
    rows = rows.withColumn("next", F.coalesce(F.lead("t").over(ahead), F.col("t")))
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.length("t") - k), F.substring("next", F.lit(1), k)))
    rows = with_band_terms(rows, known, own="t", other="edited")
    rows = rows.withColumn("fingerprint", fingerprint(F.col("own"), F.col("t")))
    rows = rows.withColumn("next_fingerprint", F.coalesce(F.lead("fingerprint").over(ahead), F.col("fingerprint"))).where("not ghost")
    rows = rows.select(
        "doc_id",
        F.length("t").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("other"), F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
