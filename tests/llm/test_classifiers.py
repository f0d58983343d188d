import inspect
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinbuild.llm import language_id, quality_classifier
from twinbuild.llm import quality_rules as rules
from twinbuild.llm.common import held_out
from twinbuild.llm.language_id import fit_language, predict_language
from twinbuild.llm.quality_classifier import QualityModel, _margin, fit_quality, score_quality
from twinbuild.llm.quality_rules import BINS_OF_SCORE, COUNTS, kept_by_rules, quality_rules, rule_statistics


@pytest.fixture(scope="session")
def learn(spark):
    return ~held_out(F.col("doc_id"), 4)


def test_quality_on_held_out_rows(spark, sf_dir, learn):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    model = fit_quality(docs, labels, learn)
    got = score_quality(docs, model).where(~learn).join(labels, "doc_id").collect()
    assert len(got) > 60 and np.mean([(r["score"] >= 0.7) == r["quality"] for r in got]) > 0.93


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = QualityModel(np.zeros((0, 0)), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    ids, x = np.array([1, 5, 7, 2, 5]), rng.normal(size=5)
    got, _ = _margin(m, ids, x, np.array([0, 3]))
    for value, part in zip(got, (slice(0, 3), slice(3, 5)), strict=True):
        i, v = ids[part], x[part]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(value - (0.3 + m.linear[i] @ v + pairs)) < 1e-9


def test_quality_cases(odd, nothing, labels):
    model = fit_quality(odd, labels, metadata=("n_chars",))
    assert model is None or all(0 <= r["score"] <= 1 for r in score_quality(odd, model, metadata=("n_chars",)).collect())
    assert fit_quality(odd, labels.limit(0)) is None and {r["score"] for r in score_quality(odd, None).collect()} == {0.5}
    assert score_quality(nothing, model).collect() == []


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 4000 else {w for w in set(windows)}
    covered = {k + j for k, w in enumerate(windows) if w in twice for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_rule_statistics(spark, sf_dir, odd):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 9 = 0").collect()]
    for t in [*(r["text"] for r in odd.collect()), *texts, "a b c a b c a", "x\nx\n\n \nx ", "a a a a"]:
        assert rule_statistics((t or "").encode())[:5] == brute(t), (t or "")[:60]


def test_rules_judge(spark, sf_dir, odd, nothing, labels):
    docs, marks = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    got = quality_rules(docs, marks).join(marks, "doc_id").where("not base_failed").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
    rows = quality_rules(odd, labels).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert quality_rules(nothing, labels).collect() == [] and kept_by_rules(nothing, labels).columns == odd.columns
    assert kept_by_rules(odd, labels).count() == sum(r["kept"] for r in rows) and BINS_OF_SCORE > 0 and len(COUNTS) == 5


def test_language_on_held_out_rows(spark, sf_dir, odd, nothing, learn):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(docs, learn)
    got = predict_language(docs, model, keep=("doc_id", "lang")).collect()
    own = [r for r in got if crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang"] == r["lang_pred"] for r in own]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)
    rows = predict_language(odd, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (0, 1, 2)} == {("und", 0.0)}
    assert predict_language(nothing, model).collect() == [] and fit_language(nothing) is None
    assert {r["lang_pred"] for r in predict_language(odd, None).collect()} == {"und"}


def test_language_counts_are_naive_bayes(spark):
    model = fit_language(spark.createDataFrame([(1, "aa", "x"), (2, "bb", "y"), (3, "bb", "y"), (4, None, "z"), (5, "cc", None)], "doc_id long, text string, lang string"), bits=10, orders=(1,), alpha=1.0)
    assert model.languages == ["x", "y"] and np.allclose(np.exp(model.log_prob).sum(0), 1, atol=1e-3) and np.exp(model.log_prior) == pytest.approx([1 / 3, 2 / 3])


def test_quality_sample_is_held_compactly():
    rows = [(k, k % 2, np.full(k, k, np.int32).tobytes(), np.full(k, 0.5, np.float32).tobytes(), [float(k), float("nan")]) for k in range(4)]
    sample, y = quality_classifier.gathered(iter(rows))
    assert (sample.words.dtype, sample.values.dtype, len(sample.words)) == (np.int32, np.float32, 6) and y.tolist() == [0, 1, 0, 1]
    words, values, stats = sample.row(3)
    assert words.tolist() == [3, 3, 3] and values.tolist() == [0.5] * 3 and stats[0] == 3 and np.isnan(stats[1])
    assert inspect.signature(fit_quality).parameters["sample_rows"].default == 12_000
    assert len(quality_classifier.gathered(iter(()))[0]) == 0


def brute_anomaly(forest, row):
    """Path lengths of one row, node by node."""
    total = 0.0
    for feature, split, left, length in zip(forest.feature, forest.split, forest.left, forest.length, strict=True):
        node = 0
        while feature[node] >= 0:
            node = left[node] + (row[feature[node]] >= split[node])
        total += length[node]
    n = forest.tree_rows
    return 2 ** (-total / len(forest.feature) / (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))


def test_forest_against_row_by_row():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(0, 1, (400, 5)), rng.normal(6, 1, (4, 5))])
    forest = rules.grow(rows, 40, 128)
    scores = rules.anomaly(forest, rows)
    assert np.allclose(scores, [brute_anomaly(forest, r) for r in rows]) and scores[400:].min() > np.quantile(scores[:400], 0.98)


def test_many_equal_short_lines_stand_out():
    """Between varied lines, so that few windows of three words repeat and the base rule passes."""
    words = np.random.default_rng(5)
    line = lambda n: " ".join(f"w{x}" for x in words.integers(0, 5000, n))
    plain = ["\n".join(line(int(words.integers(8, 14))) for _ in range(8)) for _ in range(200)]
    faulty = ["\n".join(f"buy now\n{line(5)}" for _ in range(20)) for _ in range(6)]
    stats = np.array([rules.rule_statistics(t.encode()) for t in [*plain, *faulty]])
    columns = {c: stats[:, k] for k, c in enumerate((*rules.COUNTS, *rules.EXTRA))}
    rates = rules._rates(columns)
    scores = rules.anomaly(rules.grow(rates, 100, 128), rates)
    assert (columns["n_repeat_words"] * 100 <= 50 * columns["n_words"]).all() and (rates[200:, -1] > 0.1).all() and scores[200:].min() > np.quantile(scores[:200], 0.95)


def test_language_by_hand(spark):
    """Counts, priors and log probabilities against sums over n-grams, and letters by Unicode's categories."""
    rows = [(1, "aab", "x"), (2, "abc abc", "y"), (3, "ba", "x"), (4, None, "y"), (5, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language_id.fit_language(docs, bits=10)
    grams = {x: np.concatenate([language_id.hashed_ngrams(t, 10, m.orders) for _, t, y in rows if t and y == x]) for x in ("x", "y")}
    counts = np.stack([np.bincount(grams[x], minlength=1 << 10) + 0.5 for x in m.languages], axis=1)
    assert m.languages == ["x", "y"] and np.allclose(m.log_prob, np.log(counts / counts.sum(0)), atol=1e-5) and np.allclose(m.log_prior, np.log([2 / 3, 1 / 3]))
    texts = [(k, t) for k, t in enumerate(["ab", "cab", "½", "² ①", "12 3!", "é", "ß½", "", None, "漢"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_language(spark.createDataFrame(texts, "doc_id long, text string"), m).collect()}
    for k, t in texts:
        if not any(c.isalpha() for c in t or ""):
            assert got[k] == "und"
        else:
            assert got[k] == m.languages[int(np.argmax(m.log_prob[language_id.hashed_ngrams(t, 10, m.orders)].sum(0) + m.log_prior))]
    with pytest.raises(ValueError, match="languages"):
        language_id.fit_language(docs, most_languages=1)


def test_ids_that_repeat_and_names_that_clash(spark):
    """Of rows with one id the same one is learnt from, however the rows lie, and a column named like ours does no harm."""
    rows = [(k % 40, f"good words number {k}" if k % 2 else f"BAD!!! $$$ {k}", 1) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, _label int")
    first = quality_classifier.fit_quality(docs, labels)
    again = quality_classifier.fit_quality(docs.orderBy(F.rand(3)).repartition(7), labels)
    assert np.array_equal(first.linear, again.linear) and np.array_equal(first.factors, again.factors)


def test_samples_hold_repeated_rows_by_their_share(spark):
    from twinbuild.llm.common import hash_sample

    many = spark.range(150_300).select(F.when(F.col("id") < 150_000, F.lit(0)).otherwise(F.col("id")).alias("x"), F.lit("a").alias("y"))
    for parts in (3, 17):
        got = [r["x"] for r in hash_sample(many.repartition(parts), 25_600, "x", "y").collect()]
        assert len(got) == 25_600 and 25_450 < got.count(0) < 25_600
        again = sorted(got) if parts == 3 else again
        assert sorted(got) == again
    three = spark.range(60_000).select((F.col("id") % 3).alias("x"))
    got = [r["x"] for r in hash_sample(three, 1_000, "x").collect()]
    assert len(got) == 1_000 and all(300 < got.count(k) < 370 for k in range(3))
    assert hash_sample(three, 60_000, "x").count() == 60_000 and hash_sample(three.limit(0), 5, "x").count() == 0


def test_forest_sees_rows_that_repeat(spark):
    stats = spark.range(30_000).select(F.lit(1).alias("doc_id"), *((F.lit(100) if c == "n_words" else F.when(F.col("id") < 29_900, F.lit(7)).otherwise(F.col("id"))).cast("long").alias(c) for c in (*COUNTS, *rules.EXTRA)))
    forest = rules.fit_forest(stats, trees=10, tree_rows=256)
    assert forest is not None and forest.tree_rows == 256


def test_long_texts_are_counted_in_slices():
    text = "".join(chr(97 + k * k % 26) if k % 7 else " Éß漢😀"[k % 5] for k in range(5_000))
    whole = np.bincount(language_id.hashed_ngrams(text, 12, (1, 2, 3)), minlength=1 << 12)
    for at_once in (1, 2, 3, 64, 4_999, 5_002, 10_000):
        parts = list(language_id.gram_slices(text, 12, (1, 2, 3), at_once))
        assert len(parts) >= len(text) // at_once and (np.bincount(np.concatenate(parts), minlength=1 << 12) == whole).all()
    assert whole.sum() == 3 * len(text.lower()) + 3
    assert (language_id.ngram_counts(text * 60, 12, (1, 2, 3)) == np.bincount(language_id.hashed_ngrams(text * 60, 12, (1, 2, 3)), minlength=1 << 12)).all()
    assert language_id.ngram_counts("", 12, (1, 2, 3)).sum() == 2 + 1
