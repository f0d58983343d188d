"""Edits of facts by analysts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.plans.model import DEFAULT_CONFIDENCE, DEFAULT_PRODUCER, KINDS, Model


def judge_edits(model: Model, edits: DataFrame) -> DataFrame:
    """edits (program_id, edit_seq, target, kind, value, author) with `reason`: why one is turned down, null for one that stands.

    An unknown target or kind, or a blank rename or retype, is turned down.
    """
    known = model.functions.select("program_id", F.col("func_id").alias("target"), F.lit(True).alias("_known")).distinct()
    blank = F.col("kind").isin("rename", "retype") & (F.trim(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s", " ")) == "")
    bad = F.when(F.col("_known").isNull(), "no_such_function").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | blank, "invalid_input")
    return edits.join(known, ["program_id", "target"], "left").withColumn("reason", bad).drop("_known")


def annotate(model: Model, edits: DataFrame) -> tuple[Model, DataFrame]:
    """Apply edits (program_id, edit_seq, target, kind, value, author); gives the model and the rejected edits.

    The last edit of a (target, kind) replaces every fact of that kind on it and comes after all facts that
    stay. What `judge_edits` turns down is rejected with its reason.
    """
    judged = judge_edits(model, edits)
    rejected = judged.where("reason is not null")
    key = ["program_id", "target", "kind"]
    last = judged.where("reason is null").groupBy(*key).agg(F.max(F.struct("edit_seq", F.coalesce("value", F.lit("")).alias("value"), "author")).alias("e"))
    end = model.facts.groupBy("program_id").agg(F.max("fact_seq").alias("_end"))
    new = last.join(end, "program_id", "left").select(
        "program_id", (F.coalesce("_end", F.lit(-1)) + 1 + F.col("e.edit_seq")).alias("fact_seq"), "target", "kind", "e.value", "e.author",
        F.lit(DEFAULT_PRODUCER).alias("producer"), F.lit(DEFAULT_CONFIDENCE).alias("confidence"),
    )
    kept = model.facts.join(last.select(*key), key, "left_anti")
    return model.with_(facts=kept.unionByName(new)), rejected
