"""Secret scan: fixed patterns plus a battery of randomness tests on token runs.

Base spans are the leftmost non-overlapping matches of three patterns.  The
battery adds spans of kind ``random``: every run of ``MIN_RUN`` or more
characters of ``[A-Za-z0-9+/_=-]`` outside base spans is a candidate; what a base span
leaves of a run is tested by itself, without signs at its ends, and runs of over ``TEST_CHARS`` characters are
tested in pieces of even length.  Its encoding is inferred
from its characters (decimal, hex, base32, lower-case letters and digits, or
base64), which fixes the alphabet of k symbols and each character's rank, and
three tests look at the n ranks under "drawn uniformly from the alphabet":

* chi-squared uniformity, X2 = k/n * sum(c*c) - n, with mean k-1 and variance
  2(k-1)(n-1)/n;
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* serial correlation of neighbouring ranks, about normal with variance 1/n.

A candidate passes when the sum of the three squared z-scores is below
``RANDOM_LIMIT``, the 0.999 quantile of chi-squared with 3 degrees of freedom;
an excess of uniformity does not count against it.

Short runs of ordinary text can pass such tests by luck, so a second step
controls false discoveries.  The null model "ordinary text" has the character
frequencies of all words of all documents that are too short to be candidates, mapped
to the encoding's alphabet; the fixed license texts are its prior, so it is known in an
input of keys alone too.  Base64 holds three such models (text as it is, in lower
and in upper case), of which the likeliest counts.  With the likelihood ratio L of
uniform against ordinary text and the battery's sum S, the evidence for a key is
L * exp(-S / 2): the less even a run, the weaker.  Its mean under ordinary text is at
most that of L, which is 1, so by Markov's inequality its inverse is a valid p-value;
it shrinks with length.  Benjamini-Hochberg is applied within length bands on p-values
rounded up to whole powers of two: one count per band and power is all that is
gathered, whatever the corpus size.

Everything is a Spark SQL expression; there is no per-document driver work.

Defined cases: a null text is empty and has no spans; ties and repeated rows are
scanned row by row; matches that fail their length check are dropped without a
retry; an empty table returns no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_SPANS, code_point_spans, join_spans, spans_if, stage_table
from .licenses import TEMPLATES

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]++"
#: A maximal run, so the same as all matches of [0-9a-f]+ with 16 or more characters.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

MIN_RUN = 16
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN
RANDOM_LIMIT = 16.27
FALSE_DISCOVERY = 0.01
#: Runs longer than this are tested in consecutive pieces, so a test's cost is bounded.
TEST_CHARS = 256

# The alphabets of the inferred encodings, in rank order.
ALPHABETS = {
    "dec": "0123456789",
    "hex": "0123456789abcdef",
    "hexu": "0123456789ABCDEF",
    "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "b36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: How ordinary text is mapped to each alphabet.
FORMS = {"dec": [str], "hex": [str.lower], "hexu": [str.upper], "b32": [str.upper], "b36": [str.lower], "b64": [str, str.lower, str.upper]}


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns."""
    lowered = F.lower(text)
    probe = text.rlike(r"[:=]") & lowered.rlike("passw|secret|token|api_?key")
    assign = code_point_spans(text, ASSIGN, "assign", lambda v: F.length(F.regexp_replace(v, ASSIGN_HEAD, "")) >= 12)
    access = code_point_spans(text, ACCESS, "access", lambda v: F.length(v) >= 18)
    hexes = code_point_spans(text, HEX, "hex", lambda v: F.length(v) >= 16)
    return F.concat(
        spans_if(probe, assign),
        spans_if(text.contains("AKIA"), access),
        spans_if(text.rlike(HEX), hexes),
    )


def encoding(run: Column) -> Column:
    """The smallest alphabet that holds all characters; padding and URL forms count as base64."""
    return (
        F.when(run.rlike("^[0-9]+$"), "dec")
        .when(run.rlike("^[0-9a-f]+$"), "hex")
        .when(run.rlike("^[0-9A-F]+$"), "hexu")
        .when(run.rlike("^[A-Z2-7]+=*$"), "b32")
        .when(run.rlike("^[0-9a-z]+$"), "b36")
        .otherwise("b64")
    )


def ranks(run: Column, enc: Column) -> Column:
    """Each character's rank in its alphabet (URL forms of base64 map to the plain ones)."""
    plain = F.translate(F.regexp_replace(run, "=+$", ""), "-_=", "+/")
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[enc]
    return F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet) - 1)


def uncovered(run: Column, base: Column) -> Column:
    """The stretches (start, end, value) of a run that no base span covers."""
    stretch = lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substring(run["value"], a - run["start"] + 1, b - a).alias("value"))
    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))
    ordered = F.array_sort(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    zero = F.struct(run["start"].alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))
    add = lambda a, until: F.when(until > a["at"], F.concat(a["out"], F.array(stretch(a["at"], until)))).otherwise(a["out"])
    step = lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), add(a, b["start"]).alias("out"))
    return F.aggregate(ordered, zero, step, lambda a: add(a, run["end"]))


def battery(found: DataFrame) -> DataFrame:
    """Adds enc, k, n and the three z-scores to rows with a column ``value``."""
    rows = found.withColumn("enc", encoding(F.col("value")))
    size = F.create_map(*[x for e, a in ALPHABETS.items() for x in (F.lit(e), F.lit(len(a)))])
    rows = rows.withColumn("k", size[F.col("enc")].cast("double")).withColumn("r", ranks(F.col("value"), F.col("enc")))
    rows = rows.withColumn("r", F.filter("r", lambda x: x >= 0)).withColumn("n", F.size("r").cast("double"))
    k, n, r = F.col("k"), F.col("n"), F.col("r")
    counts = F.transform(F.array_distinct(r), lambda x: F.size(F.filter(r, lambda y: y == x)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    x2 = k / n * squares - n
    rows = rows.withColumn("z_chi", (x2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))

    high = F.transform(r, lambda x: (x >= k / 2).cast("int"))
    n1 = F.aggregate(high, F.lit(0), lambda a, x: a + x).cast("double")
    n0 = n - n1
    first, second = F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1)
    runs = F.aggregate(F.zip_with(first, second, lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, x: a + x).cast("double")
    mean = 2 * n1 * n0 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    rows = rows.withColumn("z_runs", F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(99.0)))

    avg = F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / n
    dev = F.transform(r, lambda x: x - avg)
    total = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
    lagged = F.zip_with(F.slice(dev, 1, F.size(dev) - 1), F.slice(dev, 2, F.size(dev) - 1), lambda a, b: a * b)
    serial = F.aggregate(lagged, F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("z_serial", F.when(total > 0, (serial / total + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)))


def ordinary_text(docs: DataFrame) -> dict[str, list[list[float]]]:
    """For each encoding and form, log2(k * p) of every symbol in ordinary text."""
    short = F.filter(F.split("text", "[^A-Za-z0-9+/_=-]+"), lambda w: F.length(w) < MIN_RUN)
    words = docs.where("text is not null").select(F.explode(short).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    letters = words.select(F.explode(F.split("w", "")).alias("c"), "n").where("c <> ''")
    counts = Counter("".join(TEMPLATES.values()))
    for r in letters.groupBy("c").agg(F.sum("n").alias("n")).collect():  # at most 67 rows
        counts[{"-": "+", "_": "/"}.get(r["c"], r["c"])] += r["n"]

    def weights(alphabet: str, form) -> list[float]:
        mapped = Counter()
        for c, n in counts.items():
            mapped[form(c)] += n
        total = sum(mapped[c] + 1 for c in alphabet)
        return [math.log2(len(alphabet) * (mapped[c] + 1) / total) for c in alphabet]

    return {e: [weights(a, form) for form in FORMS[e]] for e, a in ALPHABETS.items()}


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, row_key, base (spans) and added (spans of the battery) for every row.

    ``row_key`` tells repeated doc_ids with different texts apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # at most one copy of each text's own runs; values are kept for the tests only
    runs = spans_if(text.rlike(RUN), code_point_spans(text, RUN, "random", lambda v: F.length(v) >= MIN_RUN))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), base_spans(text).alias("base"), runs.alias("runs"))
    rows = stage_table(rows, "secrets-spans")

    found = rows.where(F.size("runs") > 0).select("doc_id", "row_key", "base", F.explode("runs").alias("s"))
    found = found.select("doc_id", "row_key", F.explode(uncovered(F.col("s"), F.col("base"))).alias("s"))
    # signs at the ends join a key to its neighbours; they say nothing about its encoding
    found = found.select("doc_id", "row_key", "s", F.regexp_replace("s.value", "^[+/_=-]+|[+/_-]+$", "").alias("inner")).where(F.length("inner") >= MIN_RUN)
    size, pieces = F.length("inner"), F.ceil(F.length("inner") / TEST_CHARS).cast("long")
    cut = lambda i: F.call_function("div", i * size, pieces).cast("int")
    found = found.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    piece = F.substring("inner", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i")))
    found = found.select("doc_id", "row_key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), piece.alias("value"))
    tested = stage_table(battery(found).where("n >= 2"), "secrets-tested")

    # fixed tables of at most 64 numbers, one per encoding and form
    models = ordinary_text(docs)
    table = lambda w: F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")
    bits = lambda w: F.aggregate("r", F.lit(0.0), lambda a, x: a - F.get(w, x))
    nth = lambda i: F.create_map(*[x for e, m in models.items() for x in (F.lit(e), table(m[min(i, len(m) - 1)]))])[F.col("enc")]
    ratio = F.least(*[bits(nth(i)) for i in range(max(map(len, FORMS.values())))])
    chi = F.greatest(F.lit(0.0), F.col("z_chi"))
    total = chi * chi + F.col("z_runs") ** 2 + F.col("z_serial") ** 2
    passed = tested.select(
        "doc_id", "row_key", "start", "end",
        F.least(F.lit(9), F.floor(F.log2("n"))).cast("int").alias("band"),
        F.least(F.lit(64.0), F.greatest(F.lit(0.0), F.floor(ratio - total * (0.5 / math.log(2))))).cast("int").alias("bits"),
        (total <= RANDOM_LIMIT).alias("random"),
    )
    # Benjamini-Hochberg: the fewest bits b with 2^-b * m <= q * (number with >= b bits)
    passed = passed.withColumn("bits", F.when(F.col("random"), F.col("bits")).otherwise(F.lit(0)))
    counts = passed.groupBy("band", "bits").agg(F.count("*").alias("c"))  # at most 10 x 65 rows
    down = Window.partitionBy("band").orderBy(F.desc("bits")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("band")
    levels = counts.select("band", "bits", F.sum("c").over(down).alias("above"), F.sum("c").over(whole).alias("m"))
    levels = levels.where(F.pow(F.lit(2.0), -F.col("bits")) * F.col("m") <= false_discovery * F.col("above"))
    levels = levels.groupBy("band").agg(F.min("bits").alias("least"))
    hits = passed.join(F.broadcast(levels), "band").where("random and bits >= least and bits > 0")
    hits = hits.select("doc_id", "row_key", F.struct("start", "end", F.lit("random").alias("kind"), F.lit(None).cast("string").alias("value")).alias("s"))
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key")).agg(F.collect_set("s").alias("added"))
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    return rows.join(hits, key, "left").select(
        "doc_id", "row_key", "base",
        F.coalesce("added", F.expr(NO_SPANS)).alias("added"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans give one mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digests(rows: DataFrame, kinds: list[str], base_kinds: list[str]) -> DataFrame:
    """Counts per base kind, the base digest and all spans, from ``scan`` rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base_kinds],
        F.sha2(join_spans(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"),
        join_spans(F.concat("base", "added"), kinds).alias("spans"),
    )
