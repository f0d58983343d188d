from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinbuild.llm import language_model
from twinbuild.llm.common import held_out, stored
from twinbuild.llm.language_model import Network, Shape, count_tokens, describe, run, score_documents, score_texts, train

SMALL = Shape(words=64, classes=8, tails=4, state=8, lanes=8, window=5, rounds=2, held_counts=100)


def base(docs, scored):
    learnt = {d: t for d, t in docs.items() if crc32(str(d).encode()) % 7 != 2}
    counts = Counter(w for t in learnt.values() for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs.items():
        tokens = [*(t or "").encode().lower().split(), b""]
        out[d] = (len(tokens), sum(w in counts for w in tokens), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    return out


def test_base_and_gain_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in score_documents(docs, ~held_out(F.col("doc_id"), 7)).collect()}
    want = base({r["doc_id"]: r["text"] for r in docs.collect()}, got)
    for d, (n, known, total, score) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and abs(r["base_score"] - score) < 1e-6 * abs(score) + 1e-9
    out = [d for d in want if crc32(str(d).encode()) % 7 == 2]
    assert sum(got[d]["score"] for d in out) > sum(got[d]["base_score"] for d in out)


def test_probabilities_sum_to_one():
    shape = SMALL
    net = Network(shape)
    history = np.array([3, 7, 65])
    total = 0.0
    for k in range(shape.words + shape.tails):
        total += np.exp(run(net, [np.append(history, k)], False)[0] - run(net, [history], False)[0])
    assert abs(total - 1) < 1e-4


def test_state_is_carried_and_lanes_do_not_mix():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 68, n) for n in (1, 40, 3, 17, 90, 5, 2, 33, 12, 1, 60)]
    net = Network(SMALL)
    together = run(net, docs, False)
    long = Network(Shape(**{**SMALL.__dict__, "window": 1000, "lanes": 1})).load(net.flat())
    assert np.allclose(together, [run(long, [d], False)[0] for d in docs], rtol=1e-4)


def test_gradients():
    net = Network(SMALL, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    ids, targets, fresh = rng.integers(0, 68, (6, 3)), rng.integers(0, 68, (6, 3)), rng.random((6, 3)) < 0.3
    h = rng.normal(0, 0.5, (3, 8))

    def loss():
        states, _ = net.forward(h, ids, fresh, False)
        return -net.outputs(states.reshape(-1, 8).astype(np.float64), targets.ravel(), False)[0].sum()

    states, memory = net.forward(h, ids, fresh, True)
    _, grads, back = net.outputs(states.reshape(-1, 8), targets.ravel(), True)
    grads |= net.backward(ids, fresh, memory, back.reshape(6, 3, 8))
    for name, g in grads.items():
        for at in rng.choice(np.flatnonzero(np.abs(g).ravel() > 1e-3), 5):
            x = net.p[name].reshape(-1)
            was = x[at]
            x[at] = was + 1e-2
            up = loss()
            x[at] = was - 1e-2
            down = loss()
            x[at] = was
            assert abs((up - down) / 2e-2 - g.reshape(-1)[at]) < 2e-2 * max(1, abs(g.reshape(-1)[at])), name


def test_defined_cases(odd, nothing):
    got = score_documents(odd, ~held_out(F.col("doc_id"), 7), shape=SMALL).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1} and all(np.isfinite([r["score"], r["base_score"]]).all() for r in got)
    assert score_documents(nothing, F.lit(True), shape=SMALL).collect() == []
    counts = stored(count_tokens(nothing), "none")
    corpus = describe(counts, SMALL)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in score_texts(odd, counts, corpus, train(nothing, corpus, shape=SMALL)).collect())


def test_words_cover_the_corpus_and_classes_divide_them(spark):
    texts = [(k, " ".join(f"w{x}" for x in range(k, 6000, 3) for _ in range(1 + (x < 60)))) for k in range(3)]
    corpus = describe(stored(count_tokens(spark.createDataFrame(texts, "doc_id long, text string")), "counts"), Shape())
    shape = Shape().fitted(corpus)
    own = corpus.end + sum(corpus.held[w] for w in corpus.frequent)
    assert 0.8 * corpus.total <= own <= 0.8 * corpus.total + 2 and shape.words == len(corpus.frequent) + 1
    bounds = shape.bounds()
    assert (np.diff(bounds) > 0).all() and bounds[0] == 0 and bounds[-1] == shape.words and 60 < shape.classes < 80 and shape.state >= 16
    net = Network(shape, np.concatenate((corpus.frequencies(shape.words), corpus.tail_norm)))
    states = np.random.default_rng(0).normal(size=(1, shape.state)).astype(np.float32)
    every = np.arange(shape.words + shape.tails)
    assert abs(np.exp(net.outputs(np.repeat(states, len(every), 0), every, False)[0]).sum() - 1) < 1e-4


def plain(net, doc):
    """The log probability of a document, a token at a time."""
    p, s = {k: v.astype(np.float64) for k, v in net.p.items()}, net.shape
    h, total, source = np.zeros(s.state), 0.0, s.words - 1
    for t in doc:
        x, (z, r, again) = p["gates"][:, source], h @ p["recurrent"]
        z, r = 1 / (1 + np.exp(x[0] + z)), 1 / (1 + np.exp(x[1] + r))
        new = np.tanh(x[2] + r * again)
        h = z * h + (1 - z) * new
        c = net.class_of[t]
        g = net.group_of[c]
        for name, k, low, high in [("group", g, 0, len(net.groups) - 1), ("class", c, net.groups[g], net.groups[g + 1]), *([("word", t, net.bounds[c], net.bounds[c + 1])] if t < s.words else [])]:
            logits = p[name][low:high] @ np.append(h, 1)
            total += logits[k - low] - np.logaddexp.reduce(logits)
        source = t
    return total


def test_same_as_a_token_at_a_time():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 68, n) for n in (1, 25, 7, 40)]
    for span in (1, 400):  # with 400, exponentials need their maximum taken off
        net = Network(SMALL)
        for name in ("group", "class", "word"):
            net.p[name] *= span
        assert np.allclose(run(net, docs, False), [plain(net, d) for d in docs], rtol=1e-4)


def test_parts_of_a_level_give_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    states, targets = rng.normal(0, 0.5, (200, 8)).astype(np.float32), rng.integers(0, 68, 200)
    whole = Network(SMALL).outputs(states, targets, True)
    monkeypatch.setattr(language_model, "AT_ONCE", 7)
    parts, again = Network(SMALL), Network(SMALL).outputs(states, targets, True)
    parts.outputs(states[:5], targets[:5], True)  # what one window leaves does not enter the next
    for got in (again, parts.outputs(states, targets, True)):
        assert np.allclose(got[0], whole[0], atol=1e-5) and np.allclose(got[2], whole[2], atol=1e-5)
        assert all(np.allclose(got[1][k], g, atol=1e-4) for k, g in whole[1].items())
    rows = parts.outputs(states[:1], targets[:1], True)[1]["word"].any(1)
    assert rows.sum() <= 8  # one target, one class


def test_work_runs_over_whole_arrays():
    """Gates lie side by side, texts of some batches are scored together, and an id's rows are added up, however often it comes."""
    ids, fresh = np.zeros((4, 3), int), np.zeros((4, 3), bool)
    before, (z, r), inner, new = Network(SMALL).forward(np.zeros((3, 8), np.float32), ids, fresh, True)[1]
    assert all(x.shape == (4, 3, 8) and x.flags.c_contiguous for x in (before, z, r, inner, new))
    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * 40] * 3)], names=["_ids"])] * 5  # 30 tokens and 16 bytes of places
    assert [len(x) for x in language_model._together(iter(batches), 60)] == [2, 2, 1]
    rng = np.random.default_rng(4)
    ids, values = np.append(rng.integers(0, 30, 100), [5] * 50), rng.normal(size=(3, 150, 8))
    rows, sums = language_model._sums_by(ids, values, 40)
    want = np.zeros((3, 40, 8))
    for part in range(3):
        np.add.at(want[part], ids, values[part])
    assert sorted(rows) == sorted(set(ids.tolist())) and np.allclose(sums, want[:, rows])
