"""The registered queries: every operator over the whole given tables, with scalar columns only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbuild.functions import guards
from twinbuild.functions import similarity as S
from twinbuild.functions.features import SIGNATURE, anchor_set, in_degrees, packed, packed_cosine, packed_jaccard, packed_trigram_set, squared_norm, with_baseline_features
from twinbuild.operators import diff, evaluate, facts, matching, merge, navigate, observe
from twinbuild.operators.validate import validate_model
from twinbuild.plans.model import Model
from twinbuild.plans.store import shared_folder, stored
from twinbuild.sources import observations, snapshots, tables
from twinbuild.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _both(spark: SparkSession, sf_dir: str) -> tuple[Model, DataFrame]:
    model = tables.both(tables.build_a(spark, sf_dir), tables.build_b(spark, sf_dir))
    return model, tables.pairs(model)


def _leftovers(spark: SparkSession, sf_dir: str, *features: str):
    """Both builds with these features of the functions, stored once; their exact matches, and what those leave on each side."""
    model, _ = _both(spark, sf_dir)
    functions = model.functions.withColumn("anchors", anchor_set()) if "anchors" in features else model.functions
    functions = stored(functions.select("program_id", "func_id", "func_seq", "name", *SIGNATURE, *features), "functions")
    model = model.with_(programs=stored(model.programs, "programs"), functions=functions, call_edges=stored(model.call_edges, "edges"))
    pairs = tables.pairs(model)
    sides = [functions.join(F.broadcast(pairs.select("pair_id", F.col(p).alias("program_id"))), "program_id").drop("program_id") for p in ("prog_a", "prog_b")]
    found = stored(matching.match_exact(*sides), "exact")
    return model, pairs, found, *(matching.left_over(side, found, i) for side, i in zip(sides, ("a_id", "b_id"), strict=True))


@query
def model_functions(spark, sf_dir):
    model, _ = _both(spark, sf_dir)
    n = F.aggregate("mnemonics", F.lit(0).cast("bigint"), lambda acc, e: acc + e["count"])
    return model.functions.select("program_id", "func_id", F.col("addr").cast("bigint").alias("addr"), "name", "size", "bb_count", "out_degree", n.alias("n_mnemonics"), F.size("string_refs").cast("bigint").alias("n_strings"), F.array_join("imports", ",").alias("imports"))


@query
def model_edges(spark, sf_dir):
    return _both(spark, sf_dir)[0].call_edges.drop("edge_seq")


@query
def model_facts(spark, sf_dir):
    return tables.build_a(spark, sf_dir).facts.drop("author")


@query
def mnemonic_histogram(spark, sf_dir):
    return _both(spark, sf_dir)[0].functions.select("program_id", "func_id", F.explode("mnemonics").alias("e")).select("program_id", "func_id", "e.mnemonic", F.col("e.count").alias("n"))


@query
def mnemonic_trigrams(spark, sf_dir):
    return _both(spark, sf_dir)[0].functions.select("program_id", "func_id", F.explode("trigrams").alias("e")).select("program_id", "func_id", F.col("e.mnemonic").alias("trigram"), F.col("e.count").alias("n"))


@query
def signatures(spark, sf_dir):
    return _both(spark, sf_dir)[0].functions.select("program_id", "func_id", "bb_count", "size", "out_degree", "fingerprint")


@query
def anchor_sets(spark, sf_dir):
    rows = _both(spark, sf_dir)[0].functions.select("program_id", "func_id", F.array_sort(anchor_set()).alias("a"))
    return rows.select("program_id", "func_id", F.size("a").cast("bigint").alias("n_anchors"), F.array_join("a", " ").alias("anchors"))


@query
def vector_norms(spark, sf_dir):
    rows = _both(spark, sf_dir)[0].functions.where(F.size("vector") > 0)
    return rows.select("program_id", "func_id", F.size("vector").cast("bigint").alias("n_entries"), F.round(F.sqrt(squared_norm(F.col("vector"))), 9).alias("norm"))


@query
def baseline_features(spark, sf_dir):
    model, _ = _both(spark, sf_dir)
    return with_baseline_features(model.functions, model.call_edges).select("program_id", "func_id", F.size("trigram_set").alias("n_trigrams"), "in_degree")


@query
def program_info(spark, sf_dir):
    return navigate.program_info(_both(spark, sf_dir)[0])


@query
def display_names(spark, sf_dir):
    return navigate.display_names(_both(spark, sf_dir)[0]).drop("func_seq")


@query
def function_views(spark, sf_dir):
    views = navigate.function_views(_both(spark, sf_dir)[0], "detail")
    return views.select("program_id", "func_id", "name", "summary", F.array_join("callees", ",").alias("callees"), F.array_join("callers", ",").alias("callers"), "size")


@query
def caller_chunks(spark, sf_dir):
    """The callers of each function, 8 a row at most; the first function of a program has a quarter of them all."""
    return navigate.caller_chunks(_both(spark, sf_dir)[0], 8).withColumn("callers", F.array_join("callers", ","))


@query
def search(spark, sf_dir):
    return navigate.search(_both(spark, sf_dir)[0], "F1").select("program_id", "func_id", "name")


@query
def callers(spark, sf_dir):
    return navigate.callers(_both(spark, sf_dir)[0])


@query
def annotated_views(spark, sf_dir):
    return navigate.annotated_views(_both(spark, sf_dir)[0], "intent").select("program_id", "func_id", "name", "comment")


@query
def listing(spark, sf_dir):
    return navigate.listing(_both(spark, sf_dir)[0]).select("program_id", F.col("line").cast("bigint").alias("line"), "func_id", "text")


@query
def references(spark, sf_dir):
    return navigate.references(_both(spark, sf_dir)[0]).select("program_id", "func_id", "caller_id", F.col("line").cast("bigint").alias("line"))


@query
def neighbourhood(spark, sf_dir):
    model, _ = _both(spark, sf_dir)
    focus = model.facts.select("program_id", F.col("target").alias("func_id")).distinct()
    return navigate.neighbourhood(model, focus).select("program_id", "focus", "src_id", "dst_id")


@query
def call_depth(spark, sf_dir):
    return navigate.call_depth(tables.build_a(spark, sf_dir))


@query
def annotate(spark, sf_dir):
    """Each conversation's last turn renames the function of its number."""
    model = tables.build_a(spark, sf_dir)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") + 1).alias("target"), F.col("turn").alias("edit_seq"), F.lit("rename").alias("kind"), F.col("text").alias("value"), F.col("role").alias("author"))
    edits = turns.join(model.functions.select("program_id", F.col("func_id").alias("target")), "target")
    return facts.annotate(model, edits)[0].facts.select("program_id", "target", "kind", "value")


@query
def annotate_rejected(spark, sf_dir):
    """Turns as edits of one program: of functions that it has not, of a kind that there is not, or blank, they are turned down."""
    kind = F.when(F.col("turn") % 3 == 2, "note").when(F.col("turn") % 3 == 1, "comment").otherwise("rename")
    edits = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.lit("A.src0").alias("program_id"), F.col("turn").alias("edit_seq"), (F.col("conv_id") + 1).alias("target"), kind.alias("kind"), F.col("text").alias("value"), F.col("role").alias("author"))
    return facts.annotate(tables.build_a(spark, sf_dir), edits)[1].select("program_id", "target", "edit_seq", "kind", "reason")


@query
def function_features(spark, sf_dir):
    """Features of functions from rows of instructions and references; every 25th function is a thunk and has none."""
    rows = snapshots.function_features(*tables.feature_rows(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("program_id", "func_entry", F.size("mnemonics").cast("bigint").alias("n_mnemonics"), F.array_join(F.slice("mnemonics", 1, 5), " ").alias("first_mnemonics"), joined("callees"), joined("imports"), F.size("string_refs").cast("bigint").alias("n_strings"), joined("callee_names"))


@query
def event_model(spark, sf_dir):
    """Build A once more, from the events that a materializing engine sends (a header for each program, then its functions)."""
    model = snapshots.model_from_events(tables.engine_events(spark, sf_dir))
    names = model.programs.select("program_id", F.col("name").alias("program"))
    return model.functions.join(names, "program_id").select("program_id", "program", "func_id", F.col("addr").cast("bigint").alias("addr"), "name", "size", "bb_count", "out_degree", "fingerprint")


@query
def event_edges(spark, sf_dir):
    return snapshots.model_from_events(tables.engine_events(spark, sf_dir)).call_edges.drop("edge_seq")


def _stream_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def streamed_model(spark, sf_dir):
    """The same model from a stream: a third of the events at a time, the programs' ends with the last ones."""
    folder, events = _stream_folder(spark), tables.engine_events(spark, sf_dir)
    ends = events.groupBy("program_id").agg((F.max("seq") + 1).alias("seq")).withColumn("kind", F.lit("end"))
    for k in range(3):
        part = events.where(F.pmod("seq", F.lit(3)) == k)
        (part if k < 2 else part.unionByName(ends, allowMissingColumns=True)).write.mode("append").json(f"{folder}/in")
        jobs.stream_events(spark, f"{folder}/in", f"{folder}/out", f"{folder}/log").awaitTermination()
    model, _ = jobs.ingested_model(spark, f"{folder}/out")
    names = model.programs.select("program_id", F.col("name").alias("program"))
    return model.functions.join(names, "program_id").select("program_id", "program", "func_id", F.col("addr").cast("bigint").alias("addr"), "name", "size", "bb_count", "out_degree", "fingerprint")


@query
def streamed_edits(spark, sf_dir):
    """Conversations as a stream of edits of the functions of their number, later turns first: the edits in force."""
    folder, model = _stream_folder(spark), tables.build_a(spark, sf_dir)
    known = stored(model.functions.select("program_id", "func_id"), "functions")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("turn") % 2 == 0, "rename").otherwise("comment").alias("kind")
    edits = turns.join(known, F.col("conv_id") + 1 == F.col("func_id")).select("program_id", F.col("turn").alias("edit_seq"), F.col("func_id").alias("target"), kind, F.col("text").alias("value"), F.col("role").alias("author"))
    for k in (2, 0, 1):
        edits.where(F.col("edit_seq") % 3 == k).write.mode("append").json(f"{folder}/in")
        jobs.stream_edits(spark, f"{folder}/in", f"{folder}/out", f"{folder}/log", model.with_(functions=known)).awaitTermination()
    return jobs.current_edits(spark, f"{folder}/out").select("program_id", "target", "kind", "edit_seq", "value", "author")


@query
def exact_matches(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    return matching.match_exact(*matching.two_sides(model, pairs)).select("pair_id", "a_id", "b_id")


def _exact_rows(spark, sf_dir):
    model, pairs, found, left_a, left_b = _leftovers(spark, sf_dir)
    found = found.withColumns({"status": F.lit("matched"), "confidence": F.lit(100)})
    return diff.diff_rows(diff.Diff(found, left_a.select("pair_id", "func_id"), left_b.select("pair_id", "func_id")), navigate.display_names(model), pairs)


@query
def exact_summary(spark, sf_dir):
    """What changed between build A and build B, by exact identity."""
    return diff.diff_summary(_exact_rows(spark, sf_dir)).select("pair_id", "unchanged", "renamed", "removed", "added")


@query
def exact_report_chunks(spark, sf_dir):
    """The same as a report, 16 functions a row at most."""
    return diff.diff_report_chunks(stored(_exact_rows(spark, sf_dir), "rows"), 16)


@query
def address_diff(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    return diff.diff_addresses(model, pairs).withColumn("addr", F.col("addr").cast("bigint"))


def _with_next(spark, sf_dir, *columns):
    """Every function of build A (x) with that of build B (y) made of the document 20 ids on in the same source."""
    model, pairs = _both(spark, sf_dir)
    a, b = matching.two_sides(model, pairs, ("func_id", *columns))
    x = a.select("pair_id", (F.col("func_id") - 1).alias("doc"), F.col("func_id").alias("a_id"), F.struct(*columns).alias("x"))
    y = b.where(F.col("func_id") < tables.NEW).select("pair_id", (F.col("func_id") - tables.SHIFT - 20).alias("doc"), F.col("func_id").alias("b_id"), F.struct(*columns).alias("y"))
    return x.join(y, ["pair_id", "doc"])


@query
def pair_jaccard(spark, sf_dir):
    return _with_next(spark, sf_dir, "anchors").select("pair_id", "a_id", "b_id", F.round(S.jaccard(F.col("x.anchors"), F.col("y.anchors")), 9).alias("jaccard"))


@query
def pair_vector_cosine(spark, sf_dir):
    rows = _with_next(spark, sf_dir, "vector").where("x.vector is not null and y.vector is not null")
    return rows.select("pair_id", "a_id", "b_id", F.round(S.vector_cosine(F.col("x.vector"), F.col("y.vector")), 9).alias("cosine"))


@query
def baseline_similarity(spark, sf_dir):
    """Every function of build A with the one made of the same document, by the structural baseline's score."""
    builds = tables.build_a(spark, sf_dir), tables.build_b(spark, sf_dir)
    pairs = tables.pairs(tables.both(*builds))

    def of(model: Model, program: str, start: int, id_name: str, out: str) -> DataFrame:
        model = model.with_(functions=model.functions.withColumns({"mix": packed("mnemonics"), "grams": packed_trigram_set("trigrams", "mnemonics")}))
        doc = (F.col("func_id") - start).alias("doc")
        rows = matching.side_of(model, pairs, program, ("func_id", "mix", "grams", "bb_count", "out_degree")).where(F.col("func_id") < tables.NEW)
        rows = rows.select("pair_id", doc, F.col("func_id").alias(id_name), F.struct("mix", "grams", "bb_count", "out_degree").alias(out))
        called = matching.side_of(model.with_(functions=in_degrees(model.call_edges)), pairs, program, ("func_id", "in_degree")).select("pair_id", doc, "in_degree")
        rows = rows.join(called, ["pair_id", "doc"], "left")  # by the key of the pairs, so that lists move once
        return rows.withColumn(out, F.col(out).withField("in_degree", F.coalesce("in_degree", F.lit(0)))).drop("in_degree")

    both = of(builds[0], "prog_a", 1, "a_id", "x").join(of(builds[1], "prog_b", tables.SHIFT, "b_id", "y"), ["pair_id", "doc"])
    score = S.weighed_baseline("x", "y", packed_cosine("x.mix", "y.mix"), packed_jaccard("x.grams", "y.grams"))
    return both.select("pair_id", "a_id", "b_id", F.round(score, 9).alias("similarity"))


@query
def pair_similarity(spark, sf_dir):
    """Every function of build A with the one made of the same document."""
    builds = tables.build_a(spark, sf_dir), tables.build_b(spark, sf_dir)
    pairs = tables.pairs(tables.both(*builds))
    a, b = (matching.side_of(m.with_(functions=m.functions.withColumns({"mix": packed("mnemonics"), "grams": packed("trigrams")})), pairs, p, ("func_id", "mix", "grams", "bb_count", "out_degree")) for m, p in zip(builds, ("prog_a", "prog_b"), strict=True))
    columns = F.struct("mix", "grams", "bb_count", "out_degree")
    x = a.select("pair_id", (F.col("func_id") - 1).alias("doc"), F.col("func_id").alias("a_id"), columns.alias("x"))
    y = b.where(F.col("func_id") < tables.NEW).select("pair_id", (F.col("func_id") - tables.SHIFT).alias("doc"), F.col("func_id").alias("b_id"), columns.alias("y"))
    no_order = (F.length("x.grams") == 0) | (F.length("y.grams") == 0)
    score = S.weighed_similarity("x", "y", packed_cosine("x.mix", "y.mix"), packed_cosine("x.grams", "y.grams"), no_order)
    return x.join(y, ["pair_id", "doc"]).select("pair_id", "a_id", "b_id", F.round(score, 9).alias("similarity"))


@query
def propagation_round(spark, sf_dir):
    model, pairs, found, left_a, left_b = _leftovers(spark, sf_dir)
    new = matching.propagate_round(left_a, left_b, matching.edges_of(model, pairs, "prog_a"), matching.edges_of(model, pairs, "prog_b"), found)
    return new.select("pair_id", "a_id", "b_id")


def _round(kind: str, *features: str):
    def run(spark, sf_dir):
        *_, left_a, left_b = _leftovers(spark, sf_dir, *features)
        return matching.feature_round(left_a, left_b, kind).select("pair_id", "a_id", "b_id", F.round("score", 9).alias("score"))

    return run


QUERIES |= {"anchor_round": _round("anchor", "anchors"), "vector_round": _round("bsim", "vector"), "fuzzy_round": _round("fuzzy", "mnemonics", "trigrams")}


def _diffed(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    found = diff.diff_programs(model, pairs)
    return found, diff.diff_rows(found, navigate.display_names(model), pairs), model, pairs


@query
def diff_rows(spark, sf_dir):
    return _diffed(spark, sf_dir)[1]


@query
def diff_summary(spark, sf_dir):
    return diff.diff_summary(_diffed(spark, sf_dir)[1])


@query
def method_counts(spark, sf_dir):
    return diff.method_counts(_diffed(spark, sf_dir)[0])


@query
def diff_report(spark, sf_dir):
    return diff.diff_report_json(_diffed(spark, sf_dir)[1])


@query
def graph_diff_status(spark, sf_dir):
    _, rows, model, pairs = _diffed(spark, sf_dir)
    return diff.graph_diff_status(model, rows, pairs)


@query
def reanchor_exact(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    targets = model.facts.join(pairs.withColumnRenamed("prog_a", "program_id"), "program_id").select("pair_id", F.col("target").alias("a_id")).distinct()
    return matching.match_exact(*matching.two_sides(model, pairs)).join(targets, ["pair_id", "a_id"], "left_semi").select("pair_id", "a_id", "b_id")


@query
def reanchored_facts(spark, sf_dir):
    return merge.reanchor_facts(*_both(spark, sf_dir))[0]


@query
def merge_propagation_round(spark, sf_dir):
    """Of every three exact matches two are taken as known; one round of scored propagation looks for the rest of the functions."""
    model, pairs, found, *_ = _leftovers(spark, sf_dir)
    targets = model.functions.join(pairs.withColumnRenamed("prog_a", "program_id"), "program_id").select("pair_id", "func_id")
    edges_a, edges_b = (stored(matching.edges_of(model, pairs, p), "edges") for p in ("prog_a", "prog_b"))
    return merge.propagate_scored(targets, edges_a, edges_b, found.where("a_id % 3 <> 1")).select("pair_id", "a_id", "b_id")


@query
def merge_report(spark, sf_dir):
    return merge.merge_facts(*_both(spark, sf_dir))[1]


def _collaborated(spark, sf_dir):
    model = tables.both(tables.build_a(spark, sf_dir), tables.incoming(spark, sf_dir))
    return merge.collaborate(model, tables.pairs(model, "A", "I"))


@query
def collaborate(spark, sf_dir):
    return _collaborated(spark, sf_dir)[0].select("pair_id", "fact_seq", "kind", "value", "decision")


@query
def collab_report(spark, sf_dir):
    return _collaborated(spark, sf_dir)[1]


@query
def conflicts(spark, sf_dir):
    return _collaborated(spark, sf_dir)[2]


@query
def observed_edges(spark, sf_dir):
    rows = observe.classify_observed_edges(tables.build_a(spark, sf_dir), tables.observed(spark, sf_dir))
    return rows.groupBy("program_id", "run_id", "from_name", "to_name", "edge_status").agg(F.count("*").alias("n"))


@query
def edge_provenance(spark, sf_dir):
    model, _ = observe.stamp_edges(tables.build_a(spark, sf_dir), tables.observed(spark, sf_dir))
    return observe.edges_with_provenance(model).drop("edge_seq")


@query
def stamped_edges(spark, sf_dir):
    return observe.stamp_edges(tables.build_a(spark, sf_dir), tables.observed(spark, sf_dir))[1]


@query
def import_uplift(spark, sf_dir):
    return observe.import_uplift(tables.build_a(spark, sf_dir), tables.import_traces(spark, sf_dir))


@query
def traced_imports(spark, sf_dir):
    """Imports resolved at run time, read from JSON traces of runs; a text that is cut off gives none."""
    rows = observations.parse_import_traces(tables.import_trace_texts(spark, sf_dir))
    return rows.groupBy("program_id", "function", "import").agg(F.count("*").alias("n"))


@query
def enriched_imports(spark, sf_dir):
    """Each function's imports in build A, those seen at run time included."""
    traces = observations.parse_import_traces(tables.import_trace_texts(spark, sf_dir))
    model = observe.enrich_imports(tables.build_a(spark, sf_dir), traces)
    return model.functions.select("program_id", "func_id", F.array_join("imports", ",").alias("imports"))


@query
def observation_logs(spark, sf_dir):
    """Framed logs of runs amid console noise: the calls of those that are sound, and why the others are refused (n = 0)."""
    edges, rejected = observations.read_observation_logs(tables.observation_logs(spark, sf_dir))
    counted = edges.groupBy("program_id", "run_id", "from_name", "to_name", "confidence").agg(F.count("*").alias("n"))
    return counted.unionByName(rejected.withColumn("n", F.lit(0).cast("bigint")), allowMissingColumns=True)


@query
def snapshot_programs(spark, sf_dir):
    """Snapshots as JSON, broken ones among them: what the sound ones hold, and why the others are refused."""
    sound, rejected = snapshots.parse_snapshots(stored(tables.snapshot_texts(spark, sf_dir), "snapshots"))
    model = snapshots.build_model(sound)
    edges = model.call_edges.groupBy("program_id").agg(F.count("*").alias("edges"))
    held = model.functions.groupBy("program_id").agg(F.count("*").alias("functions"), F.sum("size").alias("size"), F.max("addr").cast("bigint").alias("last_addr"))
    out = model.programs.join(held, "program_id").join(edges, "program_id", "left").fillna({"edges": 0})
    return out.select("program_id", "name", "language", "functions", "size", "last_addr", "edges").unionByName(rejected, allowMissingColumns=True)


@query
def views_by_id(spark, sf_dir):
    """Build A asked for a function of every second number, up to twice the greatest: those that it has, and those that it has not."""
    model = tables.build_a(spark, sf_dir)
    ids = model.functions.select("program_id", (2 * F.col("func_id")).alias("func_id"))
    return navigate.view(model, ids).select("program_id", "func_id", "found", "name", "summary")


@query
def search_summaries(spark, sf_dir):
    """Functions that nobody calls, by their summary."""
    return navigate.search(_both(spark, sf_dir)[0], "out-call(s), 0 caller", in_summary=True).select("program_id", "func_id", "name")


@query
def validated_model(spark, sf_dir):
    """What the loader repairs in build A after every 100th function is there twice and every 50th function's calls lead nowhere."""
    model = tables.build_a(spark, sf_dir)
    functions = model.functions.drop("vector").withColumn("bsim_vector", F.array().cast("array<struct<hash:bigint,weight_bits:bigint>>"))
    functions = functions.unionByName(functions.where("func_id % 100 = 0").withColumns({"func_seq": F.col("func_seq") + 10_000_000_000, "name": F.lit("twin")}))
    edges = model.call_edges.withColumn("dst_id", F.when(F.col("src_id") % 50 == 0, -1).otherwise(F.col("dst_id")))
    return validate_model(model.with_(functions=functions, call_edges=edges))[1]


@query
def load_report(spark, sf_dir):
    """All repairs of the loader: build A with functions twice, calls and stamps to nowhere, long names, notes on nothing, confidence beyond 100."""
    model = tables.build_a(spark, sf_dir)
    functions = model.functions.drop("vector").withColumn("bsim_vector", F.array().cast("array<struct<hash:bigint,weight_bits:bigint>>"))
    functions = functions.withColumn("name", F.when(F.col("func_id") % 97 == 0, F.repeat(F.lit("é"), 40_000)).otherwise(F.col("name")))
    functions = functions.unionByName(functions.where("func_id % 100 = 0").withColumns({"func_seq": F.col("func_seq") + 10_000_000_000, "name": F.lit("twin")}))
    edges = model.call_edges.withColumn("dst_id", F.when(F.col("src_id") % 50 == 0, -1).otherwise(F.col("dst_id")))
    stamp = lambda dst: model.call_edges.where("src_id % 30 = 1").select("program_id", "src_id", dst.alias("dst_id"), F.lit(0).cast("bigint").alias("ep_seq"), F.lit("dynamic").alias("producer"), F.lit(200).alias("confidence"))
    notes = model.facts.withColumns({"target": F.when(F.col("fact_seq") % 5 == 0, -F.col("target")).otherwise(F.col("target")), "confidence": F.lit(200)})
    loaded, report = validate_model(model.with_(functions=functions, call_edges=edges, facts=notes, edge_provenance=stamp(F.col("dst_id")).unionByName(stamp(F.col("dst_id") + 7_777_777))))
    most = loaded.facts.unionByName(loaded.edge_provenance, allowMissingColumns=True).groupBy("program_id").agg(F.max("confidence").alias("most_confidence"))
    return report.join(most, "program_id", "left")


@query
def program_caps(spark, sf_dir):
    functions = tables.build_a(spark, sf_dir).functions
    none = F.array().cast("array<string>")
    flat = F.flatten(F.transform("mnemonics", lambda e: F.array_repeat(e["mnemonic"], e["count"].cast("int"))))
    chunks = functions.select("program_id", F.struct("name", "imports", "string_refs", "callee_names", flat.alias("mnemonics"), none.alias("callees"), F.array().cast("array<array<bigint>>").alias("bsim_vector")).alias("f"))
    return snapshots.over_caps(snapshots.chunk_sizes(chunks), functions=45, mnemonics=15_000).drop("bytes")


@query
def survival_scoreboard(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    return evaluate.score_reanchoring(model, pairs, model.functions.select("name").distinct())


@query
def baseline_scoreboard(spark, sf_dir):
    """How many functions keep their name by the structural baseline, which takes the best match and asks for no margin."""
    model, pairs = _both(spark, sf_dir)
    model, pairs = model.with_(call_edges=stored(model.call_edges, "edges")), stored(pairs, "pairs")
    names = model.functions.where("program_id like 'A.%'").select("name").distinct()
    scores = evaluate.score_matches(model, pairs, names, evaluate.baseline_reanchor(model, pairs, names))
    return scores.select("pair_id", "ok", "wrong", "orphan", F.round("survival", 9).alias("survival"), "gate_ok")


@query
def similarity_matrix(spark, sf_dir):
    model, pairs = _both(spark, sf_dir)
    return evaluate.similarity_matrix(*matching.two_sides(model, pairs, ("func_id", "vector"))).withColumn("score", F.round("score", 9))


@query
def sanitized_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", guards.sanitize_inline(F.col("html")).alias("text"))


@query
def wrapped_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", guards.wrap_untrusted(F.col("text")).alias("text"))


@query
def truncated_text(spark, sf_dir):
    """Texts cut to 2,000 bytes at a character, and whether they were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", guards.truncate_utf8(F.col("text"), 2_000).alias("text"), guards.needs_cut(F.col("text"), 2_000).alias("was_cut"))
