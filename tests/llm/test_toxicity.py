import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinbuild.llm import toxicity as T
from twinbuild.llm.common import held_out


def kinds(text):
    """The kinds of a text's matches under the word lists."""
    got = T.text_features(pa.array([text]), T.lexicon({}), T.table(T.grammar()))[0]
    return {k for k, x in zip(T.KINDS, got, strict=False) if x > 0}


@pytest.mark.parametrize("text, want", [
    ("what a worthless thing", {"plain"}), ("you are an idiot", {"aimed"}), ("You, IDIOT!", {"aimed"}), ("I will hurt you", {"threat"}), ("they kill him", {"threat"}),
    ("this is not stupid", {"negated"}), ("you are not an idiot", {"negated"}), ("she called him an idiot", {"reported"}), ("he said: you are a moron", {"reported"}),
    ("we stab the meat", set()), ("nothing here", set()), ("", set()), ("not so. idiot", {"plain"}), ("she said so\nidiot", {"plain"}), ("he wrote that. you loser", {"aimed"}),
    ("not one of all these good people here is an idiot", {"plain"}), ("Du bist ein Trottel", {"aimed"}), ("«Connard»", {"plain"}),
])
def test_clauses(text, want):
    assert kinds(text) == want


def test_composition_is_one_after_the_other():
    rng = np.random.default_rng(11)
    first = T.threats(set(T.SYMBOLS))
    second = T.within(first.written(), "target", 4, lambda s: "aimed" if s == "insult" else s)
    third = T.within(second.written(), "not", 3, lambda s: f"negated {s}" if s in T.MATCHES else s)
    both = T.compose(T.compose(first, second), third)
    for _ in range(300):
        symbols = rng.choice(T.SYMBOLS, 15).tolist()
        assert both.run(symbols) == third.run(second.run(first.run(symbols)))


def test_steps_follow_the_grammar():
    machine, rng = T.grammar(), np.random.default_rng(12)
    steps = T.table(machine)
    for _ in range(200):
        symbols, state, got = rng.choice(T.SYMBOLS, 20).tolist(), 0, []
        for s in symbols:
            state, kind = steps[state][T.SYMBOLS.index(s)]
            got.append(kind)
        assert got == [T.kind_of(w) for w in machine.run(symbols)]


def test_words_and_beginnings():
    known = T.lexicon({"abcd*": 2.0, "abcde": 3.0, "abcdef*": 1.5, "trash": 0.5})
    found = known.look_up(pa.array(["abcd", "abcdx", "abcde", "abcdefg", "abc", "trash", ""]))
    assert known.weights[found].tolist() == [0, 2.0, 3.0, 1.5, 0, 0.5, 0]
    assert T.forms(["abcdef", "xy"]) == {"abcdef", "xy", "abcd*", "abcde*"}


def test_features_do_not_depend_on_the_batch():
    texts = ["you idiot. fine", None, "", "a b c", "x" * 3000, "idiot\nidiot | moron", "not " * 50 + "scum"]
    texts = [t or "" for t in texts]
    known, steps = T.lexicon({}), T.table(T.grammar())
    whole = T.text_features(pa.array(texts), known, steps)
    assert np.allclose(whole, np.concatenate([T.text_features(pa.array([t]), known, steps) for t in texts]))


def test_weights_follow_labels_and_stay_near_defaults_without():
    rng = np.random.default_rng(0)
    x = rng.random((500, len(T.FEATURES)))
    y = (x[:, 0] > 0.5).astype(float)
    bias, w = T.fit_weights(x, y)
    assert w[0] > 5 and ((bias + x @ w > 0) == y).mean() > 0.95
    assert np.allclose(T.fit_weights(np.zeros((4, len(T.FEATURES))), np.array([0, 0, 1.0, 0]))[1], T.DEFAULTS)


def test_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    learn = ~held_out(F.col("doc_id"), 4)
    model = T.fit_toxicity(docs, labels, learn)
    rows = T.score_toxicity(docs, model).where(~learn).join(labels.where("toxic is not null"), "doc_id").collect()
    caught = [r["score"] >= 0.3 for r in rows if r["toxic"] == 1]
    assert np.mean(caught) > 0.6 and not any(r["score"] >= 0.3 for r in rows if r["toxic"] == 0)  # some labels of these tables are noise
    other = T.fit_toxicity(docs.repartition(7), labels.repartition(3), learn)
    assert other.words.entries == model.words.entries and np.allclose(other.weights, model.weights)


def test_cases(spark, odd, nothing, labels):
    for known in (T.fit_toxicity(odd, labels), T.fit_toxicity(odd, labels.limit(0)), T.fit_toxicity(nothing, labels)):
        rows = T.score_toxicity(odd, known, keep=("doc_id", "lang")).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] < 0.3 for r in rows)
        assert T.score_toxicity(nothing, known).collect() == []
    one_kind = T.fit_toxicity(odd, labels.where("toxic = 0"))
    assert one_kind.bias == T.DEFAULT_BIAS and T.score_toxicity(odd.withColumn("text", F.lit("you worthless idiot")), one_kind).first()["score"] > 0.5
