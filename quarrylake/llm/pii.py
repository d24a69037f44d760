"""Personal data: fixed patterns plus information-theoretic sanitisation.

Base spans are the leftmost non-overlapping matches of four patterns.  Each
distinct matched value is a protected entity e.  Corpus co-occurrence then says
how strongly a term t reveals it: with document counts over all N rows,

    IC(e)     = log2(N / n(e))                   what a reader would have to learn
    PMI(t, e) = log2(n(t, e) * N / (n(t) * n(e)))  what t tells about e

where n(t, e) counts the rows that hold both, n(t) and n(e) all rows that hold one.
PMI(t, e) / IC(e) is 1 for a term that occurs only beside e.  Few rows say little:
P(e | t) is smoothed by ``PRIOR`` rows at the rate of e in the corpus, so

    PMI(t, e) = log2((n(t, e) + PRIOR * n(e) / N) / (n(t) + PRIOR) * N / n(e))

and one row with both counts, but for less than many.  Terms at or above
``GENERALISE`` are generalised, those at or above ``REMOVE`` are removed; both give
spans of kind ``term`` at all their occurrences in all rows.

Only pairs that can reach a threshold are formed: n(t, e) <= n(e) bounds n(t) from above,
so frequent terms never meet an entity.  Counts are grouped with partial aggregation and
joined by key, frequent keys by broadcast (``join_per_key``), so that the rows of an
entity or term never meet in one task.  Everything is a Spark SQL expression.

A generalised term is replaced by its class: a name (capitalised), a code (with digits)
or a plain word.

Defined cases: a null text is empty and has no spans; repeated rows are counted
and returned as often as they come; matches that fail their check are dropped
without a retry; an empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPANS, code_point_spans, join_per_key, spans_if, stage_table
from .secrets import redact

KINDS = ["email", "ip", "card", "phone", "term"]
# Runs are possessive and starts are pinned to the head of a run (or the end of the
# previous match), which finds the same spans without trying every start of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole chain of digits with single separators, of 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

PRIOR = 1.0
GENERALISE = 0.9
REMOVE = 0.98
#: Ends of the text end a term.
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*+"
NOT_TERM = r"[^\p{L}\p{N}]+"
#: Disclosing terms are broadcast up to so many, else joined.
BROADCAST_TERMS = 400_000
#: What replaces base spans, by kind, and generalised terms, by class.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "name": "[NAME]", "code": "[CODE]", "word": "[WORD]"}


def base_spans(text: Column) -> Column:
    """Spans of the four fixed patterns."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    email = code_point_spans(text, EMAIL, "email", lambda v: F.lit(True))
    ip = code_point_spans(text, IP, "ip", lambda v: v.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))
    card = code_point_spans(text, CARD, "card", lambda v: F.call_function("luhn_check", digits(v)))
    phone = code_point_spans(text, PHONE, "phone", lambda v: F.length(digits(v)).between(9, 15))
    return F.concat(
        spans_if(text.contains("@"), email),
        spans_if(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), ip),
        spans_if(text.rlike(CARD), card),
        spans_if(text.contains("+"), phone),
    )


def entity_of(span: Column) -> Column:
    """Key of a protected entity: its kind and its value without case and separators."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]", ""))
    )
    return F.xxhash64(span["kind"], value)


def terms(text: Column) -> Column:
    """Distinct lower-case terms of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, NOT_TERM), lambda w: w.rlike(r"^\p{L}")), lambda w: F.lower(w)))


def disclosing_terms(rows: DataFrame, each: DataFrame, total: int, prior: float, generalise: float) -> DataFrame:
    """term and share for the terms at or above ``generalise``.

    ``rows`` (doc_id, row_key, base, beside) are the rows with entities, ``each``
    (term, ...) has one row per row and distinct term, ``total`` counts all rows.
    """
    # equal rows count as often as they come
    rows = rows.groupBy("doc_id", "row_key").agg(
        F.count("*").alias("copies"), F.first("beside").alias("beside"),
        F.array_distinct(F.transform(F.first("base"), entity_of)).alias("entities"),
    )
    rows = stage_table(rows.withColumn("row", F.xxhash64("doc_id", "row_key")), "pii-rows")
    held = stage_table(rows.select("row", "copies", F.explode("entities").alias("entity")), "pii-entities")
    n_e = stage_table(held.groupBy("entity").agg(F.sum("copies").alias("n_e")), "pii-counts")
    n_t = stage_table(each.groupBy("term").agg(F.count("*").alias("n_t")), "pii-counts")
    n = F.lit(float(max(total, 1)))
    # told >= (n_e / N) ** (1 - generalise) is needed, and told <= (1 + prior / N) * n_e / (n_t + prior)
    most = (1 + prior / n) * F.col("n_e") * F.pow(n / F.col("n_e"), 1 - generalise) * (1 + 1e-9) - prior
    held = join_per_key(held, n_e.where(F.col("n_e") < n), "entity", "n_e").withColumn("most", most)
    held = stage_table(held, "pii-entities")
    bound = held.groupBy("row").agg(F.max("most").alias("row_most"))
    near = stage_table(rows.join(bound, "row").select("row", "row_most", F.explode("beside").alias("term")), "pii-near")
    near = join_per_key(near, n_t, "term", "n_t").where("n_t <= row_most").select("row", "term", "n_t")
    pairs = near.join(held, "row").where("n_t <= most").groupBy("entity", "term")
    pairs = pairs.agg(F.sum("copies").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    told = (F.col("n_te") + prior * F.col("n_e") / n) / (F.col("n_t") + prior)
    share = F.log2(told * n / F.col("n_e")) / F.log2(n / F.col("n_e"))
    return pairs.select("term", share.alias("share")).where(F.col("share") >= generalise).groupBy("term").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, row_key, base and added spans for every row; an added span's ``value``
    says whether its term is to be generalised or removed.

    ``row_key`` tells repeated doc_ids with different texts apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), text.alias("t"), base_spans(text).alias("base"))
    beside = F.when(F.size("base") > 0, terms(redact(F.col("t"), F.col("base"), " ")))
    rows = stage_table(rows.select("doc_id", "row_key", "base", beside.alias("beside")), "pii-spans")

    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    each = texts.select("doc_id", "row_key", F.explode(terms(F.col("text"))).alias("term"))
    known = disclosing_terms(rows.where(F.size("base") > 0), each, rows.count(), prior, generalise)
    known = stage_table(known, "pii-terms")
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    hits = each.join(known, "term").groupBy(F.col("doc_id").alias("told_id"), F.col("row_key").alias("told_key"))
    hits = hits.agg(F.collect_set(F.struct("term", "share")).alias("told")).withColumn("told", F.map_from_entries("told"))
    same = F.col("doc_id").eqNullSafe(F.col("told_id")) & (F.col("row_key") == F.col("told_key"))
    spots = texts.join(hits, same)
    spots = spots.withColumn("at", code_point_spans(F.col("text"), TERM, "term", lambda v: F.map_contains_key("told", F.lower(v))))
    how = lambda s: F.when(F.col("told")[F.lower(s["value"])] >= remove, "remove").otherwise(
        F.when(s["value"].rlike("[0-9]"), "code").when(s["value"].rlike(r"^\p{Lu}"), "name").otherwise("word")
    )
    added = F.transform("at", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("term").alias("kind"), how(s).alias("value")))
    hits = spots.select(F.col("told_id").alias("hit_id"), F.col("told_key").alias("hit_key"), added.alias("added")).dropDuplicates(["hit_id", "hit_key"])
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    added = F.coalesce("added", F.expr(NO_SPANS))
    clear = F.filter(added, lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"])))
    return rows.join(hits, key, "left").select("doc_id", "row_key", "base", clear.alias("added"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind, generalised terms by their
    class, and removed terms taken out."""
    found = scan(docs.select("doc_id", "text"), **options)
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), F.concat("base", "added").alias("found_spans"))
    found = found.where(F.size("found_spans") > 0).dropDuplicates(["hit_id", "hit_key"])
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").join(found, key, "left")
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    text = F.col("text")
    ordered = F.array_sort(F.transform("found_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["kind"] != "term", mark[s["kind"]]).when(s["value"] == "remove", "").otherwise(mark[s["value"]]).alias("by"),
    )))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["by"]).alias("out")),
    ).otherwise(a)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    rows = rows.select("doc", F.when(F.col("found_spans").isNotNull(), clean).otherwise(text).alias("clean"))
    return rows.select(*[F.col("clean").alias(c) if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])
