"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text (runs of
other characters than letters are one space), with
log counts and inverse document frequencies over all training rows.  The model is
trained by follow-the-regularised-leader with proximal L1 and L2 penalties
(elastic net), which keeps most weights at zero, and its scores are calibrated
by one temperature fitted on rows left out of training.

Document frequencies are counted by Spark over every training row.  The
regression itself sees a bounded sample: about ``SAMPLE_PER_LANGUAGE`` rows of
each language and ``SAMPLE_ROWS`` in all, chosen by a hash of the row (documented
parameters).  Every language of the training rows is learned; the driver holds one
count for each, as it holds the model.  Prediction reads every text whole, in Arrow
batches.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled row all are ``und``; rows with null lang are not learned
from; repeated rows are learned from and predicted row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: With very many languages each has fewer, but about ``LEAST_ROWS`` in any case.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, LEAST_ROWS = 1000, 200_000, 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
#: One row in so many of the sample is left out of training and fits the temperature.
CALIBRATION_SHARE = 5
SEED = 11


def gram_counts(text):
    """Hashed n-gram counts of one text as (buckets, counts).

    Runs of anything but letters count as one space, as digits and symbols say nothing
    about a language.
    """
    import re

    import numpy as np

    text = re.sub(r"[\W\d_]+", " ", text.lower())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            parts.append((h >> np.uint64(50)).astype(np.int64))
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def has_letter(text) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _document_counts(batches):
    import numpy as np
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for b in slices(batches):
        for t in b.column("text").to_pylist():
            total[gram_counts(t)[0]] += 1
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def _features(batches):
    import numpy as np
    import pyarrow as pa

    for b in slices(batches):
        got = [gram_counts(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("lang"),
                b.column("calibrate"),
                pa.array([i.astype("<u2").tobytes() for i, _ in got], pa.binary()),
                pa.array([c.astype("<u4").tobytes() for _, c in got], pa.binary()),
            ],
            ["lang", "calibrate", "buckets", "counts"],
        )


def weigh(buckets, counts, idf):
    """TF-IDF values of length one."""
    import numpy as np

    x = (1 + np.log(counts)) * idf[buckets]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def train(rows, labels, classes: int, epochs: int = EPOCHS, seed: int = SEED):
    """FTRL-proximal weights (BUCKETS x classes) of a multinomial logistic regression.

    ``rows`` are (buckets, values); a row updates only its own buckets.
    """
    import numpy as np

    z, n = np.zeros((BUCKETS, classes), np.float32), np.zeros((BUCKETS, classes), np.float32)
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = rows[r]
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    return weights(slice(None))


def fit_temperature(scores, labels) -> float:
    """The temperature that gives the left-out rows the greatest likelihood."""
    import numpy as np

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(labels)), labels] - np.log(np.exp(s).sum(1))).mean()

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(40):  # golden-section search; the loss has one minimum
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(training: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> dict | None:
    """The model, from ``training(key, text, lang)``; None without labelled rows.

    Only per-language counts, the bounded sample and per-bucket counts reach the driver.
    """
    import numpy as np

    training = training.where("text is not null and lang is not null")
    langs = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not langs:
        return None
    names = sorted(langs)
    index, per_language = {x: i for i, x in enumerate(names)}, max(LEAST_ROWS, min(per_language, SAMPLE_ROWS // len(names)))
    spread = F.pmod(F.xxhash64("key", F.xxhash64("text"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    rates = [(x, min(1.0, per_language / n)) for x, n in langs.items()]
    rates = F.broadcast(training.sparkSession.createDataFrame(rates, "lang string, rate double"))
    part = training.withColumn("u", spread).join(rates, "lang").where("u < rate").drop("rate")
    part = part.withColumn("calibrate", F.pmod(F.xxhash64("key", "text", F.lit(SEED + 1)), F.lit(CALIBRATION_SHARE)) == 0)
    sample = part.select("text", "lang", "calibrate").mapInArrow(_features, "lang string, calibrate boolean, buckets binary, counts binary").collect()
    counted = training.select("text").mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS)
    for r in counted:
        df[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(langs.values())) / (1 + df)) + 1
    sample.sort(key=lambda r: (r["lang"], bytes(r["buckets"]), bytes(r["counts"])))
    rows, labels, held = [], [], []
    for r in sample:
        i = np.frombuffer(r["buckets"], "<u2").astype(np.int64)
        rows.append((i, weigh(i, np.frombuffer(r["counts"], "<u4").astype(float), idf)))
        labels.append(index[r["lang"]])
        held.append(r["calibrate"])
    pick = lambda flag: [k for k, h in enumerate(held) if h == flag]
    learn, check = pick(False) or pick(True), pick(True)
    w = train([rows[k] for k in learn], [labels[k] for k in learn], len(names))
    scores = np.array([rows[k][1] @ w[rows[k][0]] for k in check]) if check else np.zeros((0, len(names)))
    t = fit_temperature(scores, np.array([labels[k] for k in check])) if check else 1.0
    used = np.flatnonzero(np.abs(w).sum(1))  # sparse: only these buckets are shipped
    return {"langs": names, "idf": idf, "used": used, "weights": w[used], "temperature": t}


def _predict(batches, model, within=None):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    w = np.zeros((BUCKETS, len(model["langs"])))
    w[model["used"]] = model["weights"]
    for b in slices(batches):
        names, scores = [], []
        texts = b.column("text") if within is None else pc.struct_field(b.column(within), "text")
        for t in texts.to_pylist():
            if not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            i, c = gram_counts(t)
            s = weigh(i, c, model["idf"]) @ w[i] / model["temperature"]
            p = np.exp(s - s.max())
            names.append(model["langs"][int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        cols = [b.column(c) for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            [*(c for c in b.schema.names if c != "text"), "lang_pred", "score"],
        )


def predict(docs: DataFrame, model: dict | None, keep: list[str], within: str | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score; texts are read whole.  Texts are the
    column ``text``, or that field of the kept struct ``within``, and so go to Python once.
    """
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # BUCKETS rows at most (zero rows left out), one column per language
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    text = ["text"] if within is None else []
    return docs.select(*text, *keep).mapInArrow(lambda it: _predict(it, model, within), schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: CRC-32 of the id's digits divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(docs.where("not held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])
