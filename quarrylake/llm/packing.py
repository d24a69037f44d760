"""Sequence packing as a cutting-stock problem solved by column generation.

A document is cut into full pieces of ``capacity`` tokens and one remainder.
Spark counts the remainders by length; the histogram has at most ``capacity``
entries whatever the corpus size, and only it reaches the driver.  There a
linear program chooses how often each pattern of lengths is used: its master
problem starts from single-length patterns, and an unbounded knapsack solved by
dynamic programming prices the next pattern from the dual values until the program
is within ``GAP`` of a lower bound, from the duals or from the tokens (``UnfinishedPricing`` is warned of with its bound
should ``MAX_PRICINGS`` come first).  Pattern counts are rounded down, the rest of
the histogram is packed first-fit by decreasing length, and the patterns are
handed out to documents by their rank within their length.

Ranks need no global sort: documents are dealt to hash buckets inside a length,
bucket sizes are summed up, and each bucket numbers its own rows.

Defined cases: a null or empty text is the single token ``END``; repeated rows
are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stage_table

END = 0
CAPACITY = 1024
#: Stop pricing when the program is surely within this share, or one sequence, of its optimum.
GAP = 0.0002
#: The last pricings gain ever less; beyond so many the gap that is left is warned of.
MAX_PRICINGS = 400
#: Rows of one rank bucket, on average; more for very frequent lengths.
BUCKET_ROWS = 500

PIECE = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long"


# --- tokens ---------------------------------------------------------------


class UnfinishedPricing(UserWarning):
    """Column generation stopped before its bound was met."""


def _plain_byte_level(spec) -> bool:
    """Whether the file's settings are those that ``_encoder``'s pattern stands for."""
    pre, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not model.get("byte_fallback") and not model.get("ignore_merges")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        and spec.get("truncation") is None and spec.get("padding") is None
    )


def _encoder(path):
    """Text to ids of a byte-level BPE file, identical to the ``tokenizers`` library.

    The ranks are read from that file and given to ``tiktoken``, which applies the
    same merges several times faster; special tokens in a text keep their ids.  A file
with other settings than plain byte-level BPE is left to ``tokenizers`` itself.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain_byte_level(spec):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    # byte-level alphabets write each byte as one printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    bpe = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)
    return lambda text: bpe.encode(text, allowed_special=names, disallowed_special=())


def _pieces(batches, path, capacity, with_ids):
    import zlib

    import numpy as np
    import pyarrow as pa
    import xxhash

    encode = _encoder(path)
    for b in slices(batches):
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), END], "<u4")
            raw = ids.tobytes()
            key = xxhash.xxh3_64_intdigest(raw, seed=(doc_id or 0) & 0xFFFFFFFF) >> 1
            for s in range(0, len(ids), capacity):
                part = raw[4 * s : 4 * (s + capacity)]
                out.append((doc_id, key, s, len(part) // 4, zlib.crc32(part), len(ids), *([part] if with_ids else [])))
        cols = list(zip(*out, strict=True)) or [[]] * (6 + with_ids)
        kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
        names = ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids as little-endian 32-bit words."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: _pieces(it, tokenizer, capacity, with_ids), PIECE + ", ids binary" * with_ids
    )


# --- patterns (histogram of bounded size) ---------------------------------


def price_pattern(values, lengths, capacity):
    """The most valuable multiset of lengths within ``capacity``: (value, counts)."""
    import numpy as np

    gain = np.full(capacity + 1, -1.0)
    gain[lengths] = values
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        option = gain[1 : c + 1] + best[c - 1 :: -1]  # take a piece of 1..c and fill the rest
        k = int(option.argmax())
        best[c], pick[c] = (option[k], k + 1) if option[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = {}, capacity
    while c > 0:
        if pick[c]:
            counts[int(pick[c])] = counts.get(int(pick[c]), 0) + 1
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[capacity]), counts


def solve_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, covering ``histogram`` exactly.

    Returns ``[(counts by length, uses)]``.
    """
    import numpy as np

    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    result = []
    if left.get(capacity):
        result.append(({capacity: 1}, left.pop(capacity)))
    lengths = np.array(sorted(left), np.int64)
    if len(lengths):
        need = np.array([left[int(x)] for x in lengths], float)
        at = {int(x): i for i, x in enumerate(lengths)}
        patterns, columns = _greedy_basis(lengths, need, capacity)
        inverse = np.linalg.inv(columns)
        use = np.maximum(inverse @ need, 0)
        # two lower bounds of the program: all tokens in full sequences, and the priced duals
        bound = float(lengths @ need) / capacity
        for _ in range(MAX_PRICINGS):
            value, pattern = price_pattern(inverse.sum(0), lengths, capacity)
            bound = max(bound, use.sum() / max(value, 1.0))
            if use.sum() - bound <= max(1.0, GAP * bound):
                break
            column = np.zeros(len(lengths))
            for x, n in pattern.items():
                column[at[x]] = n
            move = inverse @ column
            ratio = np.where(move > 1e-9, use / np.where(move > 1e-9, move, 1), np.inf)
            out = int(ratio.argmin())
            patterns[out] = pattern
            pivot = inverse[out] / move[out]
            inverse -= np.outer(move, pivot)
            inverse[out] = pivot
            step = ratio[out]
            use = np.maximum(use - step * move, 0)
            use[out] = step
        else:
            warnings.warn(f"{MAX_PRICINGS} pricings leave a gap of at most {1 - bound / use.sum():.4f}", UnfinishedPricing, stacklevel=2)
        for pattern, n in zip(patterns, np.floor(use + 1e-6).astype(int), strict=True):
            n = min([int(n), *(left[x] // k for x, k in pattern.items())])
            if n > 0:
                result.append((pattern, n))
                for x, k in pattern.items():
                    left[x] -= n * k
    result += [(p, 1) for p in _first_fit(left, capacity)]
    return result


def _greedy_basis(lengths, need, capacity):
    """A first basis: patterns filled from the longest length down, each used until
    one of its lengths runs out.  A pattern holds only lengths that had not run out
    before, so the basis is triangular in that order and its uses are feasible."""
    import numpy as np

    n, left = len(lengths), need.copy()
    patterns, columns = [], np.zeros((n, n))
    open_ = np.ones(n, bool)
    for _ in range(n):
        room, pattern, i = capacity, {}, n - 1
        while i >= 0 and room >= lengths[0]:
            if open_[i] and lengths[i] <= room:
                k = int(room // lengths[i])
                k = max(1, min(k, int(left[i]))) if pattern or left[i] >= 1 else k
                pattern[i] = k
                room -= k * int(lengths[i])
            i -= 1
        uses, gone = min((max(left[i], 0) / k, i) for i, k in pattern.items())
        for i, k in pattern.items():
            left[i] -= uses * k
        open_[gone] = False
        for i, k in pattern.items():
            columns[i, gone] = k
        patterns.append((gone, {int(lengths[i]): k for i, k in pattern.items()}))
    return [p for _, p in sorted(patterns, key=lambda x: x[0])], columns


def _first_fit(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """First-fit by decreasing length over what rounding left (at most a pattern's
    worth per histogram entry)."""
    bins: list[list] = []
    for x in sorted(left, reverse=True):
        for _ in range(left[x]):
            for b in bins:
                if b[0] >= x:
                    break
            else:
                bins.append(b := [capacity, {}])
            b[0] -= x
            b[1][x] = b[1].get(x, 0) + 1
    return [b[1] for b in bins]


def pattern_table(spark: SparkSession, patterns) -> DataFrame:
    """Rank intervals by length: which sequences and slots a pattern gives to the
    pieces ranked ``first`` and on.  Its size is bounded by the histogram."""
    rows, base, given = [], 0, {}
    for counts, uses in patterns:
        offset = 0
        for x, k in sorted(counts.items(), reverse=True):
            first = given.get(x, 0)
            rows.append((x, first, first + uses * k, k, base, offset))
            given[x] = first + uses * k
            offset += x * k
        base += uses
    return spark.createDataFrame(rows, "length long, first long, until long, per long, base long, slot long")


# --- plans ----------------------------------------------------------------


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rank`` from 0 within ``length``, without sorting a length in one task.

    A length's rows are dealt to buckets in proportion to its count, at least
    ``BUCKET_ROWS`` a bucket and no more buckets than rows in one.
    """
    rows = [(x, -(-n // max(BUCKET_ROWS, math.isqrt(n)))) for x, n in counts.items()]
    # one row per length, so at most the capacity
    deals = F.broadcast(pieces.sparkSession.createDataFrame(rows, "length long, buckets long"))
    dealt = pieces.join(deals, "length").withColumn("bucket", F.pmod(F.xxhash64("row_key", "start"), "buckets")).drop("buckets")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("row_key", "doc_id", "start")
    return (
        dealt.join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
        .drop("bucket", "before")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset; sequences are gapless from 0."""
    spark = docs.sparkSession
    pieces = stage_table(cut_pieces(docs, tokenizer, capacity, with_ids), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = pattern_table(spark, solve_patterns(counts, capacity))
    rank = ranked(pieces, counts)
    # at most a few rows per histogram entry, so the small side is bounded by the capacity
    placed = rank.join(F.broadcast(places), "length").where("rank >= first and rank < until")
    turn = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.floor(turn / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("slot") + (turn % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
