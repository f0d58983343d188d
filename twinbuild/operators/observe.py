"""Run-time observations over the static model: imports and call edges, a second and less trusted producer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.plans.model import Model

DYNAMIC, OBSERVED_CONFIDENCE = "dynamic", 90


def first_by_name(model: Model) -> DataFrame:
    """(program_id, name, func_id): the first function of each symbol."""
    return model.functions.groupBy("program_id", "name").agg(F.min_by("func_id", "func_seq").alias("func_id"))


def _traced(model: Model, traces: DataFrame) -> DataFrame:
    """traces (program_id, function, import) with func_id and import_status."""
    named = traces.join(first_by_name(model).withColumnRenamed("name", "function"), ["program_id", "function"], "left")
    own = named.join(model.functions.select("program_id", "func_id", "imports"), ["program_id", "func_id"], "left")
    status = F.when(F.col("func_id").isNull(), "unmatched").when(F.array_contains("imports", F.col("import")), "already_known").otherwise("newly_resolved")
    return own.withColumn("import_status", status).drop("imports")


def import_uplift(model: Model, traces: DataFrame) -> DataFrame:
    """Per program: imports by status, and how many functions got a new one."""
    rows = _traced(model, traces)
    count = lambda s: F.count_if(F.col("import_status") == s).alias(s)
    return rows.groupBy("program_id").agg(*map(count, ("newly_resolved", "already_known", "unmatched")), F.count_distinct(F.when(F.col("import_status") == "newly_resolved", F.col("func_id"))).alias("functions_enriched"))


def enrich_imports(model: Model, traces: DataFrame) -> Model:
    """The model with observed imports added to the sets that the anchor rung uses."""
    seen = _traced(model, traces).where("func_id is not null").groupBy("program_id", "func_id").agg(F.collect_set("import").alias("_seen"))
    joined = model.functions.join(seen, ["program_id", "func_id"], "left")
    return model.with_(functions=joined.withColumn("imports", F.when(F.col("_seen").isNotNull(), F.array_sort(F.array_union("imports", "_seen"))).otherwise(F.col("imports"))).drop("_seen").select(*model.functions.columns))


def classify_observed_edges(model: Model, observed: DataFrame) -> DataFrame:
    """observed with src_id, dst_id and edge_status: confirmed, added (seen only at run time) or unmatched."""
    names = first_by_name(model)
    of = lambda side, out: names.select("program_id", F.col("name").alias(side), F.col("func_id").alias(out))
    ends = observed.join(of("from_name", "src_id"), ["program_id", "from_name"], "left").join(of("to_name", "dst_id"), ["program_id", "to_name"], "left")
    static = model.call_edges.select("program_id", "src_id", "dst_id").distinct().withColumn("_static", F.lit(True))
    status = F.when(F.col("src_id").isNull() | F.col("dst_id").isNull(), "unmatched").when(F.col("_static"), "confirmed").otherwise("added")
    return ends.join(static, ["program_id", "src_id", "dst_id"], "left").withColumn("edge_status", status).drop("_static")


def new_stamps(model: Model, rows: DataFrame) -> DataFrame:
    """Provenance rows for the edges of classify_observed_edges that have none in the model."""
    key = ["program_id", "src_id", "dst_id"]
    new = rows.where("edge_status <> 'unmatched'").select(*key).distinct().join(model.edge_provenance.select(*key), key, "left_anti")
    return new.select(*key, F.lit(0).cast("bigint").alias("ep_seq"), F.lit(DYNAMIC).alias("producer"), F.lit(OBSERVED_CONFIDENCE).alias("confidence"))


def stamp_edges(model: Model, observed: DataFrame) -> tuple[Model, DataFrame]:
    """Give observed edges the dynamic producer where they have none; calls stay as they are.

    Also gives per program how many edges were stamped and how many observations matched nothing. A stamp on
    an edge that only the run saw does not survive validation, which counts it.
    """
    rows = classify_observed_edges(model, observed)
    stamps = new_stamps(model, rows)
    report = stamps.groupBy("program_id").agg(F.count("*").alias("stamped")).join(rows.where("edge_status = 'unmatched'").groupBy("program_id").agg(F.count("*").alias("unmatched")), "program_id", "full").fillna(0)
    return model.with_(edge_provenance=model.edge_provenance.unionByName(stamps)), report


def edges_with_provenance(model: Model) -> DataFrame:
    """Each call with its first provenance entry, static where it has none."""
    first = model.edge_provenance.groupBy("program_id", "src_id", "dst_id").agg(F.min(F.struct("ep_seq", "producer", "confidence")).alias("_p"))
    return model.call_edges.join(first, ["program_id", "src_id", "dst_id"], "left").select("program_id", "src_id", "dst_id", "edge_seq", F.coalesce("_p.producer", F.lit("static")).alias("producer"), F.coalesce("_p.confidence", F.lit(100)).alias("confidence"))
