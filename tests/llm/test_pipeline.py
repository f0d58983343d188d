import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F

import corpus_pipeline
from twinbuild.llm import near_dedup, quality_classifier
from twinbuild.llm.decontamination import contaminated, without_leaks
from twinbuild.llm.near_dedup import near_duplicates


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns and after.exceptAll(before).count() == 0 and 0 < after.count() < before.count(), name
        if name == "quality_classifier":
            kept = {r["quality"]: r["count"] for r in after.join(labels, "doc_id").groupBy("quality").count().collect()}
            assert kept[1] > 0.97 * labels.where("quality = 1").count() and kept.get(0, 0) < 0.2 * labels.where("quality = 0").count()
        if name == "near_dedup":
            assert {r["component_id"] for r in near_duplicates(before).collect()} == {r["doc_id"] for r in after.collect()}
        if name == "decontamination":
            assert contaminated(after, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in before.collect()}


def test_odd_documents(spark, odd, labels, sf_dir):
    """Each stage on its own: which of the odd rows stay."""
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    given = sorted(map(key, odd.collect()))
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    scored = stages["quality_classifier"](spark, odd, sf_dir)
    assert scored.columns == odd.columns and scored.exceptAll(odd).isEmpty()
    assert stages["quality_rules"](spark, odd, sf_dir).collect() == []  # under 50 words, or one word 3,000 times
    unlike = stages["near_dedup"](spark, odd, sf_dir)
    assert unlike.columns == odd.columns and sorted(map(str, (r["text"] for r in unlike.collect()))) == sorted(set(t for _, t in given))
    assert sorted(map(key, stages["decontamination"](spark, odd, sf_dir).collect())) == given
    pieces = stages["packing"](spark, odd, sf_dir).collect()
    assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({d for d, _ in given}) and sum(r["piece"] == 0 for r in pieces) == len(given)
    assert all(r["length"] >= 1 and r["offset"] + r["length"] <= 4096 for r in pieces)


def test_classifier_stage_is_the_operator(spark, sf_dir, monkeypatch):
    seen = {}
    fit, kept = quality_classifier.fit_quality, quality_classifier.kept_by_quality
    monkeypatch.setattr(quality_classifier, "fit_quality", lambda *a, **k: seen.update(fit=k) or fit(*a, **k))
    monkeypatch.setattr(quality_classifier, "kept_by_quality", lambda docs, model, least, **k: seen.update(least=least, model=model, kept=k) or kept(docs, model, least, **k))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.classify_quality(spark, docs, sf_dir).collect()}
    scored = quality_classifier.score_quality(docs, seen["model"], metadata=("n_chars",)).collect()
    assert seen["least"] == 0.7 and seen["fit"]["metadata"] == seen["kept"]["metadata"] == ("n_chars",)
    assert got == {r["doc_id"] for r in scored if r["score"] >= 0.7}


def test_rows_without_their_own_id(spark):
    """Copies and leaks among rows with null or repeated ids go, too, and only they."""
    words = [f"w{k}" for k in range(300)]
    text = lambda at: " ".join(words[at : at + 60])
    rows = [(None, text(0)), (None, text(0)), (None, text(60)), (7, text(120)), (7, text(120)), (7, text(180)), (8, text(180)), (9, "the item " + text(240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("row", F.lit("x"))
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(True, None, text(0)), (True, None, text(60)), (False, 7, text(120)), (False, 7, text(180)), (False, 9, "the item " + text(240))], key=str)
    items = spark.createDataFrame([(1, text(60)), (2, text(240))], "item_id long, text string")
    left = without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == sorted(t for _, t in rows if t not in (text(60), "the item " + text(240)))
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0 and without_leaks(docs.limit(0), items).count() == 0
