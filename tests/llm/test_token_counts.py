import random

import pytest

from twinbuild.llm.token_counts import MARK, Counts, piece_scores, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = piece_scores(public_tokenizers.path("piece_bpe_32k.model"))


def public(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True)
    return t


def test_against_the_public_tokenizer(spark, sf_dir, odd):
    known = public(VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 7 = 0").select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 10000 doc_id", "text"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, VOCABULARY).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        want = len(known.encode(text, add_special_tokens=False).ids) if text else 0
        assert got[r["doc_id"]] == want, text[:80]


def test_ties_go_as_in_the_public_tokenizer():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {MARK, *"abc", *("".join(rng.choice("abc" + MARK) for _ in range(rng.randint(1, 4))) for _ in range(12))}
        bytes_ = [(f"<0x{k:02X}>", -50.0) for k in range(256)]
        vocabulary = [("<unk>", 0.0), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces)), *bytes_]
        counts, known = Counts(vocabulary), public(vocabulary)
        for _ in range(40):
            text = "".join(rng.choice("abcd \n") for _ in range(rng.randint(1, 14)))
            assert counts.text(text)[0] == len(known.encode(text, add_special_tokens=False).ids), (vocabulary[:20], text)


def test_defined_cases(odd, nothing):
    got = token_counts(odd, VOCABULARY).collect()
    assert len(got) == odd.count() and {(r["n_tokens"], r["viterbi_score"]) for r in got if r["doc_id"] in (0, 1)} == {(0, 0.0)}
    assert token_counts(nothing, VOCABULARY).collect() == []
    assert Counts([]).text("ab c")[0] == 9
