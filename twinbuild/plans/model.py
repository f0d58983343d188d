"""The program model: five tables, keyed by program_id."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTED = "array<struct<mnemonic:string,count:bigint>>"
VECTOR = "array<struct<hash:bigint,weight_bits:bigint>>"

SCHEMAS = {
    "programs": "program_id string, name string, language string",
    "functions": "program_id string, func_id bigint, func_seq bigint, addr decimal(20,0), name string, size bigint, bb_count bigint, out_degree int, fingerprint bigint, "
    f"mnemonics {COUNTED}, trigrams {COUNTED}, string_refs array<string>, imports array<string>, callee_names array<string>, bsim_vector {VECTOR}",
    "call_edges": "program_id string, src_id bigint, dst_id bigint, edge_seq bigint",
    "facts": "program_id string, fact_seq bigint, target bigint, kind string, value string, author string, producer string, confidence int",
    "edge_provenance": "program_id string, src_id bigint, dst_id bigint, ep_seq bigint, producer string, confidence int",
}
KINDS = ("rename", "retype", "comment")
DEFAULT_PRODUCER, DEFAULT_CONFIDENCE = "user", 100


@dataclass(frozen=True)
class Model:
    programs: DataFrame
    functions: DataFrame
    call_edges: DataFrame
    facts: DataFrame
    edge_provenance: DataFrame

    def with_(self, **tables: DataFrame) -> Model:
        return replace(self, **tables)


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def write_model(model: Model, folder: str) -> None:
    """One Parquet table each; functions are laid out by program so that one program's read skips the rest."""
    for f in fields(model):
        table = getattr(model, f.name)
        (table.repartitionByRange("program_id", "func_id") if f.name == "functions" else table).write.mode("overwrite").parquet(f"{folder}/{f.name}")


def read_model(spark: SparkSession, folder: str) -> Model:
    """Tables written earlier may lack columns: those read as their defaults."""
    tables = {}
    for name, ddl in SCHEMAS.items():
        tables[name] = spark.read.schema(ddl).parquet(f"{folder}/{name}")
    legacy = F.coalesce("producer", F.lit("")) == ""
    producer = F.when(legacy, F.lit(DEFAULT_PRODUCER)).otherwise(F.col("producer"))
    confidence = F.when(legacy, F.lit(DEFAULT_CONFIDENCE)).otherwise(F.least(F.coalesce("confidence", F.lit(0)), F.lit(100)))
    tables["facts"] = tables["facts"].withColumns({"producer": producer, "confidence": confidence, "kind": F.when(F.col("kind").isin("rename", "retype"), F.col("kind")).otherwise("comment"), "author": F.when(F.col("author") != "", F.col("author"))})
    arrays = {c: F.coalesce(c, F.array()) for c in ("mnemonics", "trigrams", "string_refs", "imports", "callee_names", "bsim_vector")}
    tables["functions"] = tables["functions"].withColumns(arrays | {"fingerprint": F.coalesce("fingerprint", F.lit(0)), "out_degree": F.coalesce("out_degree", F.lit(0))})
    return Model(**tables)
