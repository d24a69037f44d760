"""The pipeline's stages, each held against a plain re-computation on its own input."""

import collections
import zlib

import numpy as np
import pytest

from quarrylake.llm import licenses, mixing, secrets
from quarrylake.llm import queries as q

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows after each stage, every stage written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    root = tmp_path_factory.mktemp("stages")
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(root / str(k)))
        docs = spark.read.parquet(str(root / str(k)))
        out.append(docs.collect())
    return out


def test_only_texts_without_a_language_go(stages):
    kept = {r.doc_id for r in stages[1]}
    assert kept == {r.doc_id for r in stages[0] if r.text and any(c.isalpha() for c in r.text)}
    assert stages[1][0].asDict().keys() == stages[0][0].asDict().keys()


def test_one_document_of_each_class_stays(stages):
    classes = brute.classes([(r.doc_id, r.text) for r in stages[1]], 5)
    assert sorted(r.doc_id for r in stages[2]) == sorted({c for _, c in classes.values()})


def test_secrets_are_replaced(spark, stages):
    before = {r.doc_id: r.text for r in stages[2]}
    assert len(stages[3]) == len(before)
    order = sorted(before)
    added = dict(zip(order, brute.random_spans([before[d] for d in order], secrets.ALPHABETS, "".join(licenses.TEMPLATES.values())), strict=True))
    for r in stages[3]:
        text, at, want = before[r.doc_id], 0, ""
        for s, e in sorted([(s, e) for s, _, e, _ in brute.secret_spans(text)] + added.get(r.doc_id, [])):
            if s >= at:
                want += text[at:s] + "[SECRET]"
            at = max(at, e)
        assert r.text == want + text[at:] and r.n_chars == len(r.text)


def test_added_secrets_are_replaced(spark, sf_dir):
    rng = np.random.default_rng(9)
    key = ["".join(rng.choice(list(secrets.ALPHABETS["b64"]), 60)) for _ in range(5)]
    df = spark.createDataFrame([(i, f"see {k} here", "en", "a", 70) for i, k in enumerate(key)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["secret_scans"](spark, df, sf_dir).collect()
    assert [(r.text, r.n_chars) for r in out] == [("see [SECRET] here", 17)] * 5


def test_the_mix_meets_its_targets(stages):
    words = lambda t: len(brute.WORD.findall(t or ""))
    size, taken = collections.Counter(), collections.Counter()
    texts = {r.doc_id: r.text for r in stages[3]}
    for r in stages[3]:
        size[r.source] += words(r.text)
    for r in stages[4]:
        assert texts[r.doc_id].startswith(r.text)
        taken[r.source] += words(r.text)
    names = sorted(size)
    target = brute.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(names, target, strict=True))


def test_sequences_hold_the_mixed_tokens(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    want, got, filled = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for r in stages[4]:
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[r.doc_id, s, zlib.crc32(ids[s : s + 1024].tobytes())] += 1
    for r in stages[5]:
        got[r.doc_id, r.start, r.ids_crc32] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_run_gives_the_same_rows(spark, sf_dir, stages):
    key = lambda r: (r.doc_id, r.start, r.ids_crc32)
    assert collections.Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == collections.Counter(map(key, stages[5]))
