"""The total loader: whatever a stored model holds, what comes out is consistent, and every repair is counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.functions.guards import needs_cut, truncate_utf8
from twinbuild.plans.model import Model
from twinbuild.plans.store import stored

LISTS = ("string_refs", "imports", "callee_names")
COUNTED = ("mnemonics", "trigrams")
REPORT = ("duplicate_ids", "dangling_edges", "dangling_edge_provenance", "unknown_fact_targets", "truncated_strings")


def _long_in(column: str, kind: str) -> Column:
    """How many strings of a column are too long."""
    if kind == "text":
        return needs_cut(F.col(column)).cast("int")
    return F.size(F.filter(column, lambda e: needs_cut(e["mnemonic"] if kind == "counted" else e)))


def _shortened(table: DataFrame, key: list[str], columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The table with long strings cut, and per program how many were. Only rows with one are taken apart."""
    total = reduce(lambda x, y: x + y, [F.coalesce(_long_in(c, kind), F.lit(0)) for c, kind in columns.items()])
    rows = table.withColumn("_cut", total)
    counts = rows.where("_cut > 0").groupBy("program_id").agg(F.sum("_cut").alias("n"))
    fine, long = rows.where("_cut = 0").drop("_cut"), stored(rows.where("_cut > 0").drop("_cut"), "long")
    if long.isEmpty():
        return table, counts
    for c, kind in columns.items():
        if kind == "text":
            long = long.withColumn(c, truncate_utf8(F.col(c)))
            continue
        each = F.col("_e.mnemonic") if kind == "counted" else F.col("_e")
        value = F.struct(truncate_utf8(each).alias("mnemonic"), F.col("_e.count").alias("count")) if kind == "counted" else truncate_utf8(each)
        parts = long.select(*key, F.posexplode(c).alias("_at", "_e")).select(*key, F.struct("_at", value.alias("v")).alias("_s")).groupBy(*key).agg(F.array_sort(F.collect_list("_s")).alias("_l"))
        none = F.array().cast(dict(table.dtypes)[c])
        long = stored(long.drop(c).join(parts, key, "left").withColumn(c, F.coalesce(F.transform("_l", lambda s: s["v"]), none)).drop("_l"), "long")
    return fine.unionByName(long.select(*fine.columns)), counts


def validate_model(model: Model) -> tuple[Model, DataFrame]:
    """The repaired model, and per program the counts in REPORT and `clean`.

    In turn: of equal ids the first stays; calls to or from unknown ids go; long strings are cut; provenance
    of calls that are not there goes; confidence is at most 100; facts on unknown functions go.
    """
    key = ["program_id", "func_id"]
    firsts = model.functions.groupBy(*key).agg(F.min("func_seq").alias("func_seq"), F.count("*").alias("_n"))
    functions = model.functions.join(firsts.drop("_n"), [*key, "func_seq"], "left_semi").dropDuplicates([*key, "func_seq"])
    counts = {"duplicate_ids": firsts.where("_n > 1").groupBy("program_id").agg(F.sum(F.col("_n") - 1).alias("n"))}

    ids = functions.select(*key)
    of = lambda c: ids.select("program_id", F.col("func_id").alias(c), F.lit(True).alias(f"_{c}"))
    marked = model.call_edges.join(of("src_id"), ["program_id", "src_id"], "left").join(of("dst_id"), ["program_id", "dst_id"], "left")
    fine = F.col("_src_id").isNotNull() & F.col("_dst_id").isNotNull()
    edges = marked.where(fine).select(*model.call_edges.columns)
    counts["dangling_edges"] = marked.where(~fine).groupBy("program_id").agg(F.count("*").alias("n"))
    lost = marked.where(~fine & F.col("_src_id").isNotNull()).groupBy("program_id", F.col("src_id").alias("func_id")).agg(F.count("*").cast("int").alias("_lost"))
    functions = functions.join(lost, key, "left").withColumn("out_degree", F.col("out_degree") - F.coalesce("_lost", F.lit(0))).select(*model.functions.columns)
    functions, edges = stored(functions, "functions"), stored(edges, "edges")

    cut = []
    functions, n = _shortened(functions, key, {"name": "text", **dict.fromkeys(LISTS, "list"), **dict.fromkeys(COUNTED, "counted")})
    cut.append(n)
    programs, n = _shortened(model.programs, ["program_id"], {"name": "text", "language": "text"})
    cut.append(n)

    call = ["program_id", "src_id", "dst_id"]
    known = edges.select(*call).distinct().withColumn("_known", F.lit(True))
    stamps = model.edge_provenance.join(known, call, "left")
    counts["dangling_edge_provenance"] = stamps.where("_known is null").groupBy("program_id").agg(F.count("*").alias("n"))
    provenance, n = _shortened(stamps.where("_known").select(*model.edge_provenance.columns), [*call, "ep_seq"], {"producer": "text"})
    cut.append(n)
    provenance = provenance.withColumn("confidence", F.least("confidence", F.lit(100)))

    facts = model.facts.join(ids.select("program_id", F.col("func_id").alias("target"), F.lit(True).alias("_known")), ["program_id", "target"], "left")
    counts["unknown_fact_targets"] = facts.where("_known is null").groupBy("program_id").agg(F.count("*").alias("n"))
    facts, n = _shortened(facts.where("_known").select(*model.facts.columns), ["program_id", "fact_seq", "target"], {"value": "text", "author": "text", "producer": "text"})
    cut.append(n)
    facts = facts.withColumn("confidence", F.least("confidence", F.lit(100)))
    counts["truncated_strings"] = reduce(DataFrame.unionByName, cut).groupBy("program_id").agg(F.sum("n").alias("n"))

    report = model.functions.select("program_id").unionByName(model.programs.select("program_id")).distinct()
    for c in REPORT:
        report = report.join(counts[c].withColumnRenamed("n", c), "program_id", "left")
    report = report.fillna(0)
    clean = reduce(lambda x, y: x & y, [F.col(c) == 0 for c in REPORT])
    return Model(programs, functions, edges, facts, provenance), report.withColumn("clean", clean)
