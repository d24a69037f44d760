import collections
import zlib

from . import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import chat, fingerprints, langid, licenses, mixing, neardup, packing, pii, secrets, topk
from quarrylake.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.mark.parametrize("name, spans, kinds", [("op1_pii", brute.pii_spans, ["email", "ip", "card", "phone"]), ("op3_secret_scans", brute.secret_spans, ["assign", "access", "hex"])])
def test_base_spans(spark, sf_dir, docs, name, spans, kinds):
    rows = {r.doc_id: r for r in q.QUERIES[name](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for d, t, _, _ in docs:
        want = spans(t or "")
        assert [rows[d][f"n_{k}"] for k in kinds] == [sum(s[3] == k for s in want) for k in kinds]
        assert rows[d].base_sha256 == brute.sha(brute.joined(want))
        assert set(brute.joined(want).split(",")) <= set(rows[d].spans.split(",")) | {""}


TRICKY = [
    "x@y.z_w@q.r.s a@b c@d.e@f.g ..@a-b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3 999.9.9.9.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 1 41111111111111111111111 5-4111111111111111",
    "+1 (017) 555-7713 +1 2 +49.30.1234567) +123456789012345678 ++1-234-567-89",
    "é" * 5 + " a.b@c.dé 𝒳 user@host.org 𝒳𝒳 +1 (415) 555-2671",
    "token=password=abcdefghijklmnop secret: token: abcdefghijklmnop API_KEY = 'abcdefghijkl' passwd:short",
    "AKIA1234567890ABCD AKIAAKIA AKIA" + "Z" * 40 + " 0123456789abcdef g0123456789abcdefg 0123456789ABCDEF",
    "", None,
    "a" * 200_000, "1" * 100_000, ("1.2." * 20_000), "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000, "4 " * 30_000,
]


def test_tricky_spans(spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for scan, spans in ((pii.scan, brute.pii_spans), (secrets.scan, brute.secret_spans)):
        rows = {r.doc_id: sorted((s.start, s.kind, s.end) for s in r.base) for r in scan(df).collect()}
        for d, t in enumerate(TRICKY):
            if t is not None and len(t) > 150_000 and spans is brute.pii_spans and "@" not in t and t[0] == "a":
                assert rows[d] == []  # a plain quadratic scan takes too long here
                continue
            assert rows[d] == sorted((s, k, e) for s, _, e, k in spans(t or "")), d


def test_disclosing_terms(spark):
    near = [(i, f"report by zyxelquark at spy{i % 2}@corp.example.com today number {i}") for i in range(8)]
    plain = [(100 + i, f"the report of today number {i}") for i in range(40)]
    df = spark.createDataFrame(near + plain, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.scan(df).collect()}
    for i, t in near:
        assert "zyxelquark" not in [t[s.start : s.end] for s in rows[i].added]  # two entities share it: PMI < IC
    assert all(not rows[i].added for i, _ in plain)
    one = spark.createDataFrame([(i, f"the report by zyxelquark at spy@corp.example.com today {i}") for i in range(4)] + plain, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.scan(one).collect()}
    assert all("zyxelquark" in ["the report by zyxelquark at spy@corp.example.com today"[s.start : s.end] for s in rows[i].added] for i in range(4))
    clean = {r.doc_id: r.text for r in pii.sanitise(one).collect()}
    assert clean[0].startswith("the report ") and "zyxelquark" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == plain[0][1]

def test_disclosing_terms_everywhere(spark):
    """Terms at the ends of a text, far from the entity, in rows without it, and of entities of one or two rows."""
    plain = [(100 + i, f"the report of today number {i}") for i in range(3000)]
    far = "the report of today number " * 20
    rows = [(i, f"zyxelquark {far} spy@corp.example.com {far} Vornholm") for i in range(8)]
    rows += [(20, f"{far} report of ZYXELQUARK"), (30, f"the report of grelmian {far} one@rare.example.org")]
    df = spark.createDataFrame(rows + plain, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scan(df).collect()}
    found = {d: [t[s.start : s.end].lower() for s in sorted(got[d].added)] for d, t in rows}
    assert all(found[i] == ["zyxelquark", "vornholm"] for i in range(8))
    assert found[20] == ["zyxelquark"] and found[30] == ["grelmian"]
    assert not any(got[d].added for d, _ in plain)
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(df).collect()}
    assert not any(w in t for t in clean.values() for w in ("zyxelquark", "vornholm", "grelmian", "@"))


def test_disclosing_terms_against_brute_force(spark, docs):
    texts = [t for _, t, _, _ in docs]
    texts += [f"{t} mail agent{i % 3}@corp.example.com about Quellmark{i % 3} now" for i, t in enumerate(texts[:9])]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.term_spans(texts)
    assert [sorted((s.start, s.end) for s in got[i].added) for i in range(len(texts))] == want
    for i in range(9):
        assert f"Quellmark{i % 3}" in [texts[len(docs) + i][s:e] for s, e in want[len(docs) + i]]


def test_added_secrets_against_brute_force(spark, docs):
    """Tokens planted into the driver's documents, some touching a base span."""
    rng = np.random.default_rng(3)
    texts = [t or "" for _, t, _, _ in docs]
    for i in range(30):
        enc, n = [("b64", 40), ("b36", 40), ("hexu", 48), ("b32", 44), ("b64", 700), ("b36", 24)][i % 6]
        token = "".join(rng.choice(list(secrets.ALPHABETS[enc]), n))
        texts[i * 5] += [f" key {token} end", f" AKIA{'Z' * 20}/{token}", f" {token}+0123456789abcdef0123"][i % 3]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.random_spans(texts, secrets.ALPHABETS, "".join(licenses.TEMPLATES.values()))
    assert [sorted((s.start, s.end) for s in got[i].added) for i in range(len(texts))] == want
    assert all(want[i * 5] for i in range(30) if i % 6 != 5)  # keys of 24 characters may say too little
    assert not any(x for i, x in enumerate(want) if i % 5 or i >= 150)


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("around", [0, 120])
def test_few_tokens(spark, n, around):
    rng = np.random.default_rng(n)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    rows = [(i, "".join(rng.choice(letters, 60))) for i in range(n)] + [(100 + i, f"the word donaudampfschifffahrtsgesellschaft {i}") for i in range(around)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(bool(r.added) for r in got if r.doc_id < 100) == n and not any(r.added for r in got if r.doc_id >= 100)


def test_random_tokens(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    tokens = ["".join(rng.choice(letters, 60)) for _ in range(20)]
    words = ["the" + "ation" * 5, "donaudampfschifffahrtsgesellschaft", "antidisestablishmentarianism"] * 40
    rows = [(i, f"see {t} here") for i, t in enumerate(tokens)] + [(100 + i, f"the word {w} is long") for i, w in enumerate(words)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i].added) for i in range(20)) >= 18
    assert not any(got[100 + i].added for i in range(len(words)))
    found = next(got[i] for i in range(20) if got[i].added)
    assert (found.added[0].start, found.added[0].end) == (4, 64)

@pytest.mark.parametrize("enc, n", [("hexu", 40), ("b32", 32), ("b36", 40), ("b64", 44)])
@pytest.mark.parametrize("around", ["see {} here", "{}"])
def test_every_candidate_is_a_key(spark, enc, n, around):
    rng = np.random.default_rng(7)
    keys = ["".join(rng.choice(list(secrets.ALPHABETS[enc]), n)) for _ in range(20)]
    df = spark.createDataFrame([(i, around.format(k)) for i, k in enumerate(keys)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert sum(bool(got[i].added) for i in range(20) if not got[i].base) >= 18 - sum(bool(r.base) for r in got.values())


def test_ordinary_runs_are_no_keys(spark):
    runs = ["MAX_CONNECTION_RETRY_LIMIT_SECONDS", "INTERNATIONALISATION", "getApplicationContextProvider", "how-to-train-your-dragon-part-two", "src/main/java/org/example/Main", "2026-11-28-12-34-56-789"]
    df = spark.createDataFrame([(i, f"the {r} of this text") for i, r in enumerate(runs * 5)], "doc_id long, text string")
    assert not any(r.added for r in secrets.scan(df).collect())


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.tokenizer_path())
    rows = q.op2_packing(spark, sf_dir).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d, text, _, _ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
        total += at
    assert total / packing.CAPACITY / len(filled) > 0.97


def test_tokens_equal_the_tokenizer_library():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(q.tokenizer_path()), packing._encoder(q.tokenizer_path())
    for text in ["", " ", "a<|endoftext|>b  c", "é😀\n\n x\t", "don't  stop now", "１２３ 中文字", "\x00\x1f", "a" * 5000]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_patterns_cover_the_histogram():
    rng = np.random.default_rng(0)
    h = collections.Counter(int(x) for x in rng.integers(1, 1025, 20_000))
    patterns = packing.solve_patterns(h)
    got = collections.Counter()
    for p, n in patterns:
        assert sum(x * k for x, k in p.items()) <= packing.CAPACITY
        for x, k in p.items():
            got[x] += n * k
    assert got == h
    assert sum(n for _, n in patterns) * packing.CAPACITY < 1.01 * sum(x * n for x, n in h.items())


def test_mixing(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in q.op7_mixing(spark, sf_dir).collect()}
    again = {r.doc_id: r for r in q.op7_mixing(spark, sf_dir).collect()}
    assert rows == again
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _, _ in docs}
    per, taken, target = collections.Counter(), collections.Counter(), {}
    for d, _, s, _ in docs:
        per[s] += size[d]
        taken[s] += rows[d].taken
        target[s] = rows[d].target
    assert all(rows[d].size == size[d] and rows[d].source_size == per[s] and rows[d].taken <= 2 * size[d] for d, _, s, _ in docs)
    assert all(abs(taken[s] - target[s]) <= 1 for s in per)
    names = sorted(per)
    want = brute.targets([per[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(per.values()))
    assert [target[s] for s in names] == pytest.approx(want)
    assert sum(want) == pytest.approx(1.5 * sum(per.values()))


def test_splitting_tree_keeps_quotas():
    counts = mixing.split_quotas([100, 7, 0, 33], 5)
    assert np.sum(counts, 0).tolist() == [100, 7, 0, 33]
    assert max(map(sum, counts)) - min(map(sum, counts)) <= 3
    sizes = mixing.split_quotas([10**12, 3 * 10**9, 5], [10**11, 9 * 10**11, 3 * 10**9 + 5])  # beyond numpy's draws
    assert np.sum(sizes, 0).tolist() == [10**12, 3 * 10**9, 5] and list(map(sum, sizes)) == [10**11, 9 * 10**11, 3 * 10**9 + 5]
    assert mixing.split_quotas([100, 7, 0, 33], 5) == counts


def test_mix_cuts_at_words(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(10)), "a" if i < 3 else "b", 0) for i in range(30)], "doc_id long, text string, source string, n_chars long")
    rows = mixing.mix(df).collect()
    assert sum(len(r.text.split()) for r in rows) == sum(d["words"] for r in mixing.draws(df).collect() for d in r.draws)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_fingerprints(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in q.op5_imatch_fingerprints(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    for i, (d, t, _, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        assert rows[d].n_chars == len(t) and rows[d].edited_sha256 == brute.sha(t[: len(t) - k] + after[:k])
    same = collections.defaultdict(set)
    for d, t, _, _ in docs:
        same[t].add(rows[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert np.mean([r.near_edited for r in rows.values()]) > 3 * np.mean([r.near_next for r in rows.values()])


def test_fingerprints_against_brute_force(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in q.op5_imatch_fingerprints(spark, sf_dir).collect()}
    of = brute.imatch([t for _, t, _, _ in docs], fingerprints.GROUPS, fingerprints.LEVELS, fingerprints.DIGITS)
    like = lambda a, b: brute.likeness(a, b, fingerprints.GROUPS, fingerprints.LEVELS, fingerprints.DIGITS)
    order = sorted(docs, reverse=True)
    for i, (d, t, _, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        r, own, edited, following = rows[d], of(t), of(t[: len(t) - k] + after[:k]), of(after)
        assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
        assert r.near_edited == pytest.approx(like(own, edited)) and r.near_next == pytest.approx(like(own, following))


def test_fingerprints_of_any_ids(spark, monkeypatch):
    """Ids over the whole range of longs, one id in many rows, null ids; small ranges; a joined lexicon."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    ids = [-(2**63), 2**63 - 1, 0, *range(40), *[77] * 30, *[None] * 20]
    texts = [f"text number {i} about w{i % 7} and w{i % 5} and v{i % 11} " * 3 for i in range(len(ids))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    rows = fingerprints.compare_with_next(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d is None, d or 0) for d in ids)
    sure = sorted((d for d in ids if d is not None and ids.count(d) == 1), reverse=True)
    own = {d: t for d, t in zip(ids, texts, strict=True)}
    by = {r.doc_id: r for r in rows}
    for a, b in zip(sure, sure[1:], strict=False):
        if not any(b < d < a for d in ids if d is not None):
            k = len(own[a]) // 3
            assert by[a].edited_sha256 == brute.sha(own[a][: len(own[a]) - k] + own[b][:k])
    # every row is the next one of exactly one row
    heads = collections.Counter(brute.sha(a[: len(a) - len(a) // 3] + b[: len(a) // 3]) for a in texts for b in set(texts))
    assert all(r.edited_sha256 in heads for r in rows)
    monkeypatch.setattr(fingerprints, "TABLE_TERMS", 0)
    key = lambda r: (str(r.doc_id), r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
    assert sorted(map(key, fingerprints.compare_with_next(df).collect())) == sorted(map(key, rows))


def test_many_languages(spark, monkeypatch):
    """Rare languages are learned too, whatever their number."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(30):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7, replace=False)
        for _ in range(12 if k else 200):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 6)) for _ in range(40)), f"l{k}"))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.9 and len({r.lang_pred for r in held}) > 25


def test_language(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in q.op6_language_id(spark, sf_dir).collect()}
    held = [(d, lang) for d, _, _, lang in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d].held_out for d, _ in held) and sum(r.held_out for r in rows.values()) == len(held)
    assert np.mean([rows[d].lang_pred == lang for d, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_chat_query(spark, sf_dir):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in q.op8_chat_formatting(spark, sf_dir).collect()}
    assert rows.keys() == turns.keys()
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(x for _, role, x in ts if role == "assistant")
        assert rows[c].n_turns == len(ts) and rows[c].loss_chars == len(loss) and rows[c].loss_sha256 == brute.sha(loss)
        assert rows[c].turns_sha256 == brute.sha("".join(f"{role}\n{x}\n" for _, role, x in ts))


def test_event_folding(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 2, 1, "delta", "assistant", "a"), (1, 3, 1, "delta", "assistant", "b"),
        (1, 4, 2, "message", "user", "more"), (1, 5, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "c"), (1, 7, 0, "edit", "user", "hello"),
        (None, 0, 0, "message", None, None),
    ]
    done = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, msg long, event string, role string, text string"))
    assert sorted((r.conv_id, r.msg, r.role, r.text) for r in done.where("conv_id = 1").collect()) == [(1, 0, "user", "hello"), (1, 1, "assistant", "c")]
    assert done.where("conv_id is null").first().text == ""


def test_log_of_the_query_folds_back(spark):
    rows = [(c, m, "assistant" if m % 2 else "user", f"text {c} of {m} " * (m % 5)) for c in range(40) for m in range(1, 12)] + [(None, 1, None, None)]
    log = chat.as_events(spark.createDataFrame(rows, "conv_id long, msg int, role string, text string"))
    assert {r.event for r in log.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    back = chat.fold_events(log).collect()
    assert sorted((str(r.conv_id), r.msg, r.role, r.text) for r in back) == sorted((str(c), m, r or "", t or "") for c, m, r, t in rows)


def test_one_long_conversation(spark):
    """40,000 events of one conversation, folded in one pass."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("msg"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    back = chat.fold_events(chat.as_events(rows))
    assert back.agg(F.count("*"), F.count_if(F.col("text") == F.concat(F.lit("t"), "msg"))).first() == (20_000, 20_000)


@pytest.mark.parametrize("text", ["", "\\", "<|end|>", "a<|turn|>\\<", "</s>[INST]x[/INST]<<SYS>>", "\\<|\\\\|>[INST", "é😀\n<"])
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, text, text)], "conv_id long, msg long, role string, text string")
    out = chat.render(row).withColumn("f", chat.formatted(F.col("segments"))).select(chat.read_back(F.col("f")).alias("t"), chat.read_loss(F.col("segments")).alias("l")).first()
    assert [(t.role, t.text) for t in out.t] == [("assistant", text), (text, text)] and out.l == text


def test_top_k(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    ids, m = np.array([v[0] for v in vectors]), np.floor(64 * np.array([v[1] for v in vectors], float)).astype(np.int64)
    got = collections.defaultdict(list)
    for r in sorted(q.op9_exact_topk(spark, sf_dir).collect()):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        assert got[ids[i]] == [(k + 1, ids[j], s[j]) for k, j in enumerate(best)]


def test_top_k_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(300)] + [(300, [2.0, 2.0]), (301, None), (302, [nan, 1.0]), (303, [inf, 1.0]), (304, [None, 1.0]), (305, [1.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert v.count() == 302
    got = topk.top_k(v.where("vec_id = 7"), v, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(300, 12288), (0, 5120), (1, 5120), (2, 5120), (3, 5120)]
    assert topk.top_k(v.where("vec_id = 7"), v.where("vec_id in (7, 300)"), 5).count() == 1
    assert topk.top_k(v.where("vec_id = -1"), v, 5).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.choice([-1e9, 1e9, 3.5, 2.25e9], 8).tolist()) for i in range(60)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.top_k(v.where("vec_id % 20 = 0"), v, 5).collect()
    m = {i: [int(np.floor(64 * x)) for x in r] for i, r in rows}
    for i in range(0, 60, 20):
        want = sorted((-sum(a * b for a, b in zip(m[i], m[j], strict=True)), j) for j in m if j != i)[:5]
        assert [(-int(r.score), r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == want


def test_two_texts_under_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b + " c"), (3, a + " c"), (4, b + " d"), (5, a + " d"), (None, a + " e"), (None, "x y"), (9, "x y"), (-5, "x  y")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    found = sorted((str(r.doc_id), r.component_id) for r in got)
    assert found == sorted([("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 1), ("None", 1), ("None", -5), ("9", -5), ("-5", -5)])
    classes = {(r.doc_id, r.row_key): r.class_key for r in got}
    assert len(set(map(bytes, classes.values()))) == 3  # the texts of doc 1 are two classes


def test_near_duplicates(spark, sf_dir, docs):
    rows = {r.doc_id: r for r in q.op10_minhash_near_dedup(spark, sf_dir).collect()}
    want = brute.classes([(d, t) for d, t, _, _ in docs], 4)
    assert {d: (r.n_shingles, r.component_id) for d, r in rows.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in rows.items())


def test_near_duplicate_group(spark):
    """One large group of variants at 0.6 to 0.95, where stars alone miss links."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(150, rng.integers(0, 9), replace=False):
            w[j] = f"x{rng.integers(1000)}"
        texts.append((i, " ".join(w)))
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()}
    assert rows == {d: c for d, (_, c) in brute.classes(texts, 4).items()}


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.id: r.root for r in neardup.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT/notice"], licenses.TEMPLATES["GPL-3.0/statement"]
    noise = " ".join(f"word{i} license of things" for i in range(60))
    rows = [
        (1, f"{noise} {mit} {noise}"), (2, f"{noise}\n{gpl}\n{noise}"), (3, noise), (4, None), (5, ""),
        (6, noise + " " + mit.replace("free of charge", "without charge")), (7, "Released under the MIT License."), (7, "Released under the MIT License."),
        (8, " ".join(mit.split()[:30])),
    ]
    got = sorted((r.doc_id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "MIT/notice"), (2, "GPL-3.0/statement"), (6, "MIT/notice"), (7, "MIT/statement")]


def test_licenses_at_every_offset(spark):
    """A long notice whole, with one word changed, and edited down to the containment, after 0 to 2 steps of words."""
    mit = licenses.template_words(licenses.TEMPLATES["MIT/notice"])
    m, rows = len(mit), []
    every = licenses.template_shingles(mit)
    for k in range(2 * (m // 8) + 1):
        lead = [f"x{i}" for i in range(k)]
        for n_edits in (0, 1, 3):
            words = list(mit)
            for j in range(n_edits):
                words[(k * 7 + j * (m // 3)) % m] = "zz"
            share = len(set(licenses.template_shingles(words)) & set(every)) / len(every)
            rows.append((len(rows), " ".join([*lead, *words, "tail", "words"]), share, k))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect() if r.template == "MIT/notice"}
    want = [r for r in rows if r[2] >= licenses.CONTAINMENT]
    assert len(want) > len(rows) / 2 and set(got) == {r[0] for r in want}
    assert all(got[r[0]].start == r[3] and got[r[0]].n_words == m for r in want if r[2] == 1)


def test_adjacent_licenses(spark):
    mit, cc = licenses.TEMPLATES["MIT/notice"], licenses.TEMPLATES["CC-BY-4.0/short"]
    lead = [" ".join(f"w{i}" for i in range(k)) for k in range(24)]
    df = spark.createDataFrame([(k, f"{x} {cc} {mit} {mit} tail") for k, x in enumerate(lead)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.template, r.n_words) for r in licenses.scan(df).collect())
    n, m = len(licenses.template_words(cc)), len(licenses.template_words(mit))
    want = [x for k in range(24) for x in ((k, k, "CC-BY-4.0/short", n), (k, k + n, "MIT/notice", m), (k, k + n + m, "MIT/notice", m))]
    assert got == want


def test_licenses_against_brute_force(spark, sf_dir, docs):
    got = {(r.doc_id, r.template.split("/")[0].split("-")[0]) for r in q.op4_license_scans(spark, sf_dir).collect()}
    want = set()
    for d, t, _, _ in docs:
        have = set(licenses.template_shingles(licenses.template_words(t or "")))
        for name, x in licenses.TEMPLATES.items():
            s = licenses.template_shingles(licenses.template_words(x))
            if len(have.intersection(s)) >= licenses.CONTAINMENT * len(s):
                want.add((d, name.split("/")[0].split("-")[0]))
    assert got == want


def test_fields_of_languages():
    t = langid.fit_temperature(np.array([[2.0, 0.0], [0.0, 2.0], [2.0, 0.0], [0.0, 2.0], [2.0, 0.0]]), np.array([0, 1, 0, 1, 1]))
    assert 1 < t < 3  # four of five right: log-odds of 2 are too sure
    assert fingerprints.FIELDS == fingerprints.LEVELS * fingerprints.GROUPS
