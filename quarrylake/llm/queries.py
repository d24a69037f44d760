"""Queries of the training-data operators, with their DuckDB equivalents.

Each query applies an operator, with production parameters, to its whole table
and derives the digest columns that a reader can check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, licenses, mixing, neardup, packing, pii, secrets, topk
from .common import table


def tokenizer_path() -> str:
    """The public byte-level BPE file of the installed tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return secrets.digests(rows, pii.KINDS, ["email", "ip", "card", "phone"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return secrets.digests(rows, secrets.KINDS, ["assign", "access", "hex"])


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.draws(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("shards")
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = turns.select("conv_id", "turn", "role", "text").union(extra.select("conv_id", "turn", "role", "text"))
    # each row is one turn, also where turn numbers repeat
    msg = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    log = chat.as_events(rows.select("conv_id", msg.alias("msg"), "role", "text"))
    done = chat.render(chat.fold_events(log)).withColumn("formatted", chat.formatted(F.col("segments")))
    back = done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    best = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)
    # a score beyond 64 bits is null; its rank is exact all the same
    return best.select("query_id", "rank", "vec_id", F.expr("try_cast(score as bigint)").alias("score"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle_words=4, percent=80)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_secret_scans": op3_secret_scans,
    "op4_license_scans": op4_license_scans,
    "op5_imatch_fingerprints": op5_imatch_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_topk": op9_exact_topk,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": f"""
        WITH r AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
          UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role))
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
          coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
          sum({len(chat.START + chat.MIDDLE + chat.STOP)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("t")}))::BIGINT AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op9_exact_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20""",
    "op10_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
          FROM documents),
        d AS (
          SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
              FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
        r AS (SELECT doc_id, doc_id AS near FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near),
        m AS (SELECT doc_id, min(near) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(s)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (doc_id)""",
}
