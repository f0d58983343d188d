import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinbuild.llm.periodic_runs import find_runs, repeated_from, run_digest, runs_of, suffixes


def brute(words, least=12):
    """(start, length, period) of all runs, by every period from every start."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_of_random_texts():
    rng = random.Random(13)
    for _ in range(600):
        least, texts = rng.choice([2, 4, 7, 12]), []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 45))]
            if w and rng.random() < 0.6:
                a, p = rng.randrange(len(w)), 1 + rng.randrange(6)
                w = [x if i < a or a + p > len(w) else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        starts = np.cumsum([0, *map(len, texts)])
        want = sorted((int(starts[k]) + s, n, q) for k, w in enumerate(texts) for s, n, q in brute(w, least))
        ids, of = np.array([x for w in texts for x in w], np.int64), np.repeat(np.arange(len(texts)), list(map(len, texts)))
        assert sorted(map(tuple, runs_of(ids, of, least).tolist())) == want, (texts, least)


def test_suffixes_and_common_lengths():
    rng = np.random.default_rng(1)
    ids, text = rng.integers(0, 2, 60), np.repeat([0, 1], [25, 35])
    ends = np.searchsorted(text, text, side="right")
    order, common = suffixes(ids, text, ends)
    words = [tuple(ids[i : ends[i]]) for i in order]
    assert [(text[i], w) for i, w in zip(order, words)] == sorted((text[i], w) for i, w in zip(order, words))
    for k in range(1, 60):
        same = next((n for n, (x, y) in enumerate(zip(words[k - 1], words[k])) if x != y), min(len(words[k - 1]), len(words[k])))
        assert common[k] == (same if text[order[k]] == text[order[k - 1]] else 0)


def test_long_texts_take_no_quadratic_time():
    n = 200_000
    rng = np.random.default_rng(0)
    passage = np.where(np.arange(n) % 50 < 8, np.arange(n) % 50, rng.integers(100, 50_000, n))  # one passage, 4,000 times, after other words each time
    for words, runs in ((np.zeros(n, np.int64), [(0, n, 1)]), (np.arange(n) % 20_011, [(0, n, 20_011)]), (passage, [])):
        assert list(map(tuple, runs_of(words, np.zeros(n, np.int64)).tolist())) == runs


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    w, h = words_of(text), None if doc_id is None else crc32(str(doc_id).encode())
    n = len(w)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(((-n, s, q) for s, n, q in runs), default=None)
    longest = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_brute_force(spark, sf_dir):
    from twinbuild.llm.queries import op13_periodic_runs

    short = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 4000}
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, sf_dir).select(*COLUMNS).collect()}
    assert {k: got[k] for k in short} == {k: expected(k, t) for k, t in short.items()}
    assert sum(got[k][1] > 0 for k in short) > 50


def test_cases(spark, odd, nothing):
    turned = repeated_from(odd.select("doc_id", "text"))
    got = sorted((tuple(r) for r in run_digest(find_runs(turned)).select(*COLUMNS).collect()), key=str)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert run_digest(find_runs(nothing)).collect() == []
    whole = find_runs(odd, keep=("doc_id", "lang")).where("doc_id = 8").first()
    assert whole["n_words"] == 3000 and [tuple(r) for r in whole["runs"]] == [(0, 3000, 1)] and whole["collapsed"] == "word"


@pytest.mark.parametrize("least, runs", [(12, 0), (6, 1)])
def test_least_words(spark, least, runs):
    docs = spark.createDataFrame([(1, "x a b a b a b y")], "doc_id long, text string")
    assert len(find_runs(docs, least=least).first()["runs"]) == runs
