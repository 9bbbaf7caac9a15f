"""Quality, language and likelihood models: brute force, held-out accuracy, odd cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fragweave.llm import gru, langid, lm, quality
from fragweave.llm.common import Memo, folded_words
from tests.llm import samples


def labelled(spark):
    data = samples.rows(240)
    junk = [[i, t.upper().replace(" ", "!! ") if i % 2 else " ".join(w + "%%" for w in t.split()), k] for i, t, k in data if i % 4 == 1]
    texts = {r[0]: r for r in data} | {r[0]: r for r in junk}
    labels = [(i, int(i % 4 != 1), 0) for i in texts]
    return list(texts.values()), spark.createDataFrame(labels + [(99999, 1, 0), (None, 1, 0), (9001, None, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    data, labels = labelled(spark)
    docs = samples.table(spark, data + samples.ODD)
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert len(rows) == len(data) + len(samples.ODD)
    held = [(r.predicted, int(r.doc_id % 4 != 1)) for r in rows if r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # a score is a plain sparse dot product
    memo, (w, bias) = Memo(quality._code), model
    for text in ("The cat, the CAT!", "", "a"):
        b, _ = quality.buckets([text], memo)
        z = bias + (quality.GAIN * sum(float(w[k]) for k in b) / len(b) if len(b) else 0)
        assert quality.scores([text], w, bias, memo)[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    assert quality.classify(samples.empty(spark), model).count() == 0
    zero, bias = quality.fit(docs, labels.where("quality = 1"))
    assert not zero.any() and bias > 0


def test_quality_ignores_held_out_labels(spark):
    data, labels = labelled(spark)
    docs = samples.table(spark, data)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def brute_bits(text, training):
    count = defaultdict(Counter)
    for b in map(langid.normal, training):  # each text begins anew, so the order of texts plays no part
        for i in range(3, len(b)):
            for k in range(4):
                count[b[i - k : i]][b[i]] += 1

    def p(ctx, c):
        seen = count.get(ctx)
        lower = lambda: p(ctx[1:], c) if ctx else 1 / 256
        if not seen:
            return lower()
        n, q = sum(seen.values()), len(seen)
        return seen[c] / (n + q) if c in seen else q / (n + q) * lower()

    z = langid.normal(text)
    return sum(-math.log2(p(z[i - 3 : i], z[i])) for i in range(3, len(z)))


def test_code_lengths():
    train = {k: [t for _, t, l in samples.rows(30) if l == k] for k in ("de", "en", "fr")}
    model = langid.train(train)
    texts = [t for _, t, _ in samples.rows(6, seed=9)] + ["ж 数 xyz", "a", "ÄÖ qqq"]
    bits, sizes = langid.code_lengths(texts, model)
    for t, row, n in zip(texts, bits, sizes):
        assert n == len(langid.normal(t)) - 3
        for k, got in zip(model.langs, row):
            assert got == pytest.approx(brute_bits(t, train[k]), rel=1e-5)


def test_language(spark):
    data = samples.rows(150)
    docs = samples.table(spark, data + samples.ODD)
    rows = langid.identify(docs, langid.fit(docs)).collect()
    truth = {i: k for i, _, k in data}
    held = [(r.lang_pred, truth[r.doc_id]) for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {9001, 9002, 9003, 9007}
    assert len(rows) == len(data) + len(samples.ODD) and all(0 <= r.score <= 1 for r in rows)
    none = samples.empty(spark)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_likelihoods(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    monkeypatch.setattr(lm, "SHORTLIST", 20)
    data = samples.rows(120) + samples.ODD
    rows = lm.likelihoods(samples.table(spark, data), tokens=20_000).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    words = lambda t: (t or "").encode().lower().split() + ["end"]
    count = Counter(w for i, t, _ in data if fold(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i, fold(i) == 0, len(words(t)), sum(count[w] > 0 for w in words(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t, _ in data)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    held = [r for r in rows if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    none = lm.likelihoods(samples.empty(spark), tokens=100)
    assert none.count() == 0


def test_gru_gradients_and_lanes():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 50, 30))[::-1].astype(float)
    m = gru.start(counts, 5, hidden=6)
    for k, p in zip(("x", "u", "b", "wc", "bc", "ww", "bw"), m.params()):
        setattr(m, k, p.astype(np.float64))
    h, t = rng.standard_normal((7, 6)), rng.integers(0, 30, 7)
    grads = [np.zeros_like(p) for p in m.params()]
    _, dh = gru.log_probs(m, h, t, grads)
    for a, g in ((h, dh), (m.wc, grads[3]), (m.bc, grads[4]), (m.ww, grads[5]), (m.bw, grads[6])):
        i = tuple(rng.integers(0, s) for s in a.shape)
        old, e = a[i], 1e-5
        a[i] = old + e
        up = -gru.log_probs(m, h, t).sum()
        a[i] = old - e
        down = -gru.log_probs(m, h, t).sum()
        a[i] = old
        assert g[i] == pytest.approx((up - down) / 2 / e, rel=1e-3, abs=1e-6)
    # class and member probabilities make a distribution
    every = gru.log_probs(m, np.repeat(h[:1], 30, 0), np.arange(30))
    assert np.exp(every).sum() == pytest.approx(1)
    # lanes, refills and windows give what one document after another gives
    docs = [rng.integers(0, 30, int(n)) for n in [1, 2, 33, 400, *rng.integers(1, 80, 300)]]
    got = gru.score(m, docs, 0)
    for i in (0, 1, 2, 3, 50, 200):
        state, prev, total = np.zeros((1, 6)), 0, 0.0
        for w in docs[i]:
            state, _ = gru.step(m, np.array([prev]), state)
            total += gru.log_probs(m, state, np.array([w]))[0]
            prev = w
        assert got[i] == pytest.approx(total, rel=1e-4)


def test_gru_learns():
    docs = [np.array([0, 1, 2, 3] * 20 + [4])] * 40
    m = gru.train(gru.start(np.array([20.0, 20, 20, 20, 1]), 2, hidden=8), docs, 4, 600_000)
    assert gru.score(m, docs[:1], 4)[0] / 81 > -0.3


def test_gru_pass_uses_every_symbol_once():
    docs = [np.array([i % 5, *range(i % 37), 7]) % 8 for i in range(400)]
    m = gru.start(np.ones(8), 3, hidden=6)
    met = gru.train_once(m, iter(docs), 7)
    want = np.bincount(np.concatenate([np.append(7, d[:-1]) for d in docs]), minlength=8)
    assert met.tolist() == want.tolist()
    same = gru.averaged(m, gru.packed(m, met) + gru.packed(m, met))
    assert all(np.allclose(a, b) for a, b in zip(m.params(), same.params()))


def test_gru_lanes_end_together():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 8, int(n)) for n in [*rng.integers(1, 60, 4000), 900]]
    met = list(gru.passing(gru.start(np.ones(8), 3, hidden=6), iter(docs), 7))
    size = sum(map(len, docs))
    assert met[-1].sum() == size
    # the long document at the end would by itself take 57 windows more
    assert len(met) - 1 <= 1.1 * size / (gru.LANES * gru.WINDOW) + 2
    assert sorted(map(bytes, gru.paced(iter(docs), 4))) == sorted(map(bytes, docs))


def test_rows_that_miss_steps_catch_up():
    rng = np.random.default_rng(8)
    start = [f((3, 6, 4)).astype(np.float32) for f in (rng.standard_normal, rng.standard_normal, lambda s: rng.random(s) + 0.1)]
    missed = np.array([0, 1, 2, 7, 40, 300])
    plain, lazy = [[x.copy() for x in start] for _ in range(2)]
    for step in range(300):
        on = missed > step
        rows = [x[:, on] for x in plain]
        gru._adam(rows[0], np.zeros_like(rows[0]), rows[1], rows[2], 1e-3, 0.9)
        for x, r in zip(plain, rows):
            x[:, on] = r
    gru._catch_up(*lazy, missed, 1e-3, 0.9)
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-5) for x, y in zip(plain, lazy))


def test_words_by_arrow_are_folded_words():
    texts = [None, "", "   ", " a  B\ta ", "\x0b\x0cx\r\n", "\x1cA\x1f b", "\u00c4\u00a0\u2028\u0085 z", "\x00 Q", "one", "E\u0301A Z\u0130 \U0001f600X"]
    texts += [f"{c}w{c}V{c}" for c in map(chr, range(1, 200))]
    for part in (texts, texts[:3], texts[5:6]):
        words, places, edges = lm.coded(pa.array(part, pa.string()))
        assert [[words[i] for i in places[a:b]] for a, b in zip(edges, edges[1:])] == [folded_words(t) for t in part]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = pa.Table.from_batches(lm._count(iter([batch, batch.slice(3, 2)]))).to_pylist()
    count, bucket = Counter(), {}
    for r in got:
        count[r["key"]] += r["n"]
        bucket[r["key"]] = r["bucket"]
    want = Counter(w for t in texts + texts[3:5] for w in folded_words(t))
    keys = lm.keys_of(list(want)).tolist()
    assert count == Counter(dict(zip(keys, want.values())) | {lm.END: len(texts) + 2})
    assert [bucket[k] for k in keys] == [lm.bucket_of(w) for w in want]
    column = pa.array(["a" * n for n in (5, 0, 30, 1, 1, 9)])
    assert [(at, len(x)) for at, x in lm.pieces(column.slice(1), 10)] == [(0, 1), (1, 1), (2, 2), (4, 1)]


def test_recurrent_model_learns_from_documents_outside_the_sample(spark):
    data = [(i, " ".join(f"w{(k + i) % 20}" for k in range(400))) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    rows = [r for r in lm.likelihoods(docs, sample=0, tokens=1).collect() if r.held_out]
    # counts alone give log10(1 / 20) a word; the order of words is in the documents only
    assert rows and sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_a_document_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(4)
    for size in (1.0, 1000.0):  # the bound serves the first, rows' own maxima the second
        m = gru.start(np.sort(rng.integers(1, 50, 40))[::-1].astype(float), 6, hidden=8)
        m.ww *= size
        m.wc *= size
        assert (gru._top(m.bc, m.wc) is None) == (size > 1)
        h, t = np.tanh(rng.standard_normal((9, 8))).astype(np.float32), rng.integers(0, 40, 9)
        alone = [gru.log_probs(m, h[i : i + 1], t[i : i + 1])[0] for i in range(9)]
        assert gru.log_probs(m, h, t) == pytest.approx(alone, rel=1e-5) and np.isfinite(alone).all()


def slow_ftrl(rows):
    """Follow-the-regularised-leader, a coordinate at a time, in plain Python."""
    n, q = 1 << quality.BITS, quality
    share = sum(r[2] for r in rows) / len(rows)
    z, g2 = defaultdict(float), defaultdict(float)
    weight_of = lambda i: 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(g2[i])) / q.ALPHA + q.L2)
    rng = np.random.default_rng(17)
    for _ in range(q.EPOCHS):
        for r in rng.permutation(len(rows)):
            idx, x, y = rows[r]
            feats = [(int(i), q.GAIN * float(v)) for i, v in zip(idx, x)] + [(n, 1.0)]
            w = {i: weight_of(i) for i, _ in feats}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in feats)))
            for i, v in feats:
                g = (0.5 / share if y else 0.5 / (1 - share)) * (p - y) * v
                z[i] += g - (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / q.ALPHA * w[i]
                g2[i] += g * g
    return {i: weight_of(i) for i in list(z)}


def test_ftrl_against_plain_python():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        idx = np.unique(rng.integers(0, 40, 8)) + 20 * (k % 3 == 0)
        rows.append((idx.astype(np.int32), rng.random(len(idx)), int(k % 3 == 0)))
    w, bias = quality.train(rows)
    want = slow_ftrl(rows)
    assert bias == pytest.approx(want.pop(1 << quality.BITS), rel=1e-6)
    assert all(w[i] == pytest.approx(v, rel=1e-5, abs=1e-7) for i, v in want.items()) and np.count_nonzero(w) == sum(v != 0 for v in want.values())


def test_null_ids_repeated_ids_and_long_texts(spark, tmp_path):
    """Through the queries: null ids aren't held out, repeated ids keep their rows, long texts count whole."""
    from fragweave.llm import queries

    data = samples.rows(60)
    data += [[None, data[0][1], "en"], [None, None, None], [7, "other text of the same id", "de"], [8, "word " * 200_000, "en"], [9, "x" * 300_000, "en"]]
    docs = samples.table(spark, data)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = sorted(str(r[0]) for r in data)
    for name in ("op1_distribution_divergence", "op2_quality_classifier", "op4_lm_scoring", "op7_bpe_encoding", "op9_language_id", "op10_simhash"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(str(r.doc_id) for r in rows) == ids, name
        if "held_out" in rows[0]:
            assert all(r.held_out is False for r in rows if r.doc_id is None) and any(r.held_out for r in rows)
        if name == "op1_distribution_divergence":
            assert {r.n_words for r in rows if r.doc_id == 8} == {200_000, len(data[8][1].split())}
        if name == "op4_lm_scoring":
            assert {200_001} <= {r.n_tokens for r in rows}
