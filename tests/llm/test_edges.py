"""Nulls in any column, blank and very long texts, repeated rows, empty tables, and extra
columns whose names are used inside the operators."""

import pytest
from pyspark.sql import functions as F

from quarrylake.llm import fingerprints, langid, licenses, mixing, neardup, packing, pii, secrets
from quarrylake.llm import pipeline_stages as stages
from quarrylake.llm import queries as q
from quarrylake.llm.queries import tokenizer_path

LONG = "lorem ipsum dolor " * 20_000
ROWS = [
    (1, "the cat sat on the mat with a hat and a bat", "en", "a", 44), (1, "the cat sat on the mat with a hat and a bat", "en", "a", 44),
    (2, None, "en", None, None), (3, "", None, "a", 0), (4, "   \n\t ", "de", "b", 6), (None, "der hund und die katze sind im haus", "de", None, 36),
    (5, LONG, "en", "a", len(LONG)), (6, "x", "fr", "c", 1), (7, "le chat est sur la table avec le chien", "fr", "c", 38),
    (8, "12345 67890", None, "c", 11), (9, "le chat est sur la table avec le chien", None, "c", 38),
]
EXTRA = ["id", "size", "base", "doc", "kept", "kept_id", "hit_id", "spans", "words", "row_key", "block", "draws", "rank", "n", "root", "at", "bucket", "lang_pred", "score", "t", "_kept_id", "_doc", "_own", "_text", "_id", "copy", "own", "tie", "key", "part", "h", "class_key"]


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


OPERATORS = {
    "pii": lambda d: pii.scan(d), "sanitise": lambda d: pii.sanitise(d), "packing": lambda d: packing.pack(d, tokenizer_path()), "secrets": lambda d: secrets.scan(d),
    "fingerprints": lambda d: fingerprints.compare_with_next(d), "language": lambda d: langid.identify(d), "mixing": lambda d: mixing.draws(d), "mix": lambda d: mixing.mix(d),
    "neardup": lambda d: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, name):
    n = docs.count()
    rows = OPERATORS[name](docs).collect()
    if name == "packing":
        assert len({(r.doc_id, r.start) for r in rows if r.start == 0}) == len({r.doc_id for r in docs.collect()})
    elif name != "mix":
        assert len(rows) == n
    if n and name == "language":
        assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 8)} == {"und"}
    if n and name == "neardup":
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4) and got[6] == (1, 6) and got[9] == (5, 7) and got[None] == (4, None)


def test_licenses(docs):
    assert licenses.scan(docs).collect() == []


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, 2, "user", None), (2, None, None, None), (None, 0, "assistant", "</s>"),
    (3, 0, "assistant", LONG), (3, 1, "user", ""),
]


@pytest.mark.parametrize("rows", [TURNS, []])
def test_chat_query(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("extra").alias(c) for c in EXTRA + ["msg", "seq", "event", "e", "at"] if c != "at"])
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in q.op8_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[-1].n_turns == 2
    if rows:
        assert {c: r.n_turns for c, r in got.items()} == {1: 4, 2: 1, None: 1, 3: 2, -1: 2}
        assert got[3].loss_chars == len(LONG) and got[1].loss_chars == 4 and got[None].loss_chars == 4


VECTORS = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1e12, -1e12]), (21, None), (22, []), (None, [1.0]), (23, [0.5]), (24, [None, 1.0]), (25, [float("nan")]), (40, [1.0] * 5000)]


@pytest.mark.parametrize("rows", [VECTORS, []])
def test_top_k_query(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("extra").alias(c) for c in EXTRA + ["v", "low", "width", "b"]])
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = q.op9_exact_topk(spark, str(tmp_path)).collect()
    if not rows:
        assert got == []
        return
    ranks = {}
    for r in got:
        ranks.setdefault(r.query_id, []).append(r["rank"])
    assert {i: sorted(x) for i, x in ranks.items()} == {0: [1, 2, 3, 4], 20: [1, 2, 3, 4, 5], 40: [1, 2, 3, 4, 5]}


@pytest.mark.parametrize("stage", [stages.keep_identified, stages.keep_one_of_each_class, stages.redact_secrets, stages.mix_sources])
def test_stages_keep_the_columns(spark, docs, stage):
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    if docs.count() and stage is stages.keep_one_of_each_class:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_packing_stage(spark, docs):
    rows = stages.pack_sequences(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert not rows or sum(r.length for r in rows if r.doc_id == 2) == 1


def test_tasks_hold_few_texts_at_once():
    import numpy as np
    import pyarrow as pa

    from quarrylake.llm import common, langid

    texts = [None if k % 7 == 0 else f"text {k} " * (k % 5) for k in range(1000)]
    doc = pa.array([{"doc_id": k, "text": t} for k, t in enumerate(texts)])
    model = {"langs": ["a", "b"], "idf": np.ones(langid.BUCKETS), "used": np.arange(50), "weights": np.ones((50, 2)) * [[1, 2]], "temperature": 1.0}
    batches = [pa.RecordBatch.from_arrays([doc], ["doc"]), pa.RecordBatch.from_arrays([doc[:0]], ["doc"])]
    found = list(langid._predict(batches, model, "doc"))
    assert max(b.num_rows for b in found) <= common.SLICE_ROWS
    assert [r for b in found for r in b.column("doc").to_pylist()] == doc.to_pylist()
    beside = pa.RecordBatch.from_arrays([pa.array(texts), doc], ["text", "doc"])
    assert pa.Table.from_batches(found) == pa.Table.from_batches(langid._predict([beside], model))
    assert found[0].column("lang_pred").to_pylist()[0] == langid.UNKNOWN
