"""Two builds of synthetic programs, derived from the documents table: build A, and a changed build B.

A program is a source in one build (`A.src0`), a function is a document. The rules that change build B are
by doc_id % 20 and listed at `build_b`. All tables follow from the given ones, whole texts included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from twinbuild.functions.features import counted_items, counted_trigrams, histogram_fingerprint
from twinbuild.plans.model import SCHEMAS, Model, empty
from twinbuild.sources.observations import checksums

SHIFT, NEW = 1_000_000, 2_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").where("doc_id is not null and source is not null").select("doc_id", "source", "text", "n_chars", "lang")


def _words(texts: pa.Array, most: int | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each word of some texts (of its first `most` characters), and the different words by number."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words = lists.flatten()
    coded = (words if most is None else pc.utf8_slice_codeunits(words, 0, most)).dictionary_encode()
    rows, ids = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), coded.indices.to_numpy().astype(np.int64)
    some = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    return rows[some], ids[some], coded.dictionary


def _lists(rows: np.ndarray, ids: np.ndarray, words: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), words.take(pa.array(ids)))


CUT, REVERSED, SWAPPED = 7, 11, 17  # edits of a body, by doc_id % 20


@F.arrow_udf(ArrayType(StringType()))
def _mnemonics(texts: pa.Array, edits: pa.Array) -> pa.Array:
    """The first two characters of each word, after an edit: without the last quarter, backwards, or with q before the second character."""
    rows, ids, words = _words(texts, 2)
    swapped = pc.binary_join_element_wise("q", pc.utf8_slice_codeunits(words, 1, 2), "") if len(words) else words
    edit = edits.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(rows)) - first[rows]
    back = edit[rows] == REVERSED
    ids = ids[np.where(back, first[rows] + sizes[rows] - 1 - place, np.arange(len(rows)))]
    ids = ids + np.where(edit[rows] == SWAPPED, len(words), 0)
    kept = (edit[rows] != CUT) | (place < np.ceil(sizes[rows] * 0.75))
    return _lists(rows[kept], ids[kept], pa.chunked_array([words, swapped]).combine_chunks(), len(texts))


@F.arrow_udf(ArrayType(StringType()))
def _long_words(texts: pa.Array) -> pa.Array:
    """The different words of nine characters or more, in order."""
    rows, ids, words = _words(texts)
    order = pc.sort_indices(words).to_numpy().astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    long = pc.greater_equal(pc.utf8_length(words), 9).to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
    row, place = np.divmod(np.unique(rows[long] * max(len(words), 1) + rank[ids[long]]), max(len(words), 1))
    return _lists(row, order[place], words, len(texts))


def _parts(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with what functions are made of: `words` (the text in lower case), size, bb_count and imports."""
    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<string>")
    return docs.select(
        "doc_id", "source", *kept, F.coalesce("n_chars", F.lit(0)).alias("size"), (1 + F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("bigint").alias("bb_count"),
        F.lower(text).alias("words"), F.when(F.col("lang").isNotNull(), F.array(F.concat(F.lit("lib_"), "lang"))).otherwise(none).alias("imports"),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _parts(_raw(spark, sf_dir))
    return docs.select("doc_id", "source", "size", "bb_count", _mnemonics("words", F.lit(0)).alias("ordered"), _long_words("words").alias("string_refs"), "imports")


def _joined(raw: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """raw with out_degree and vector. These meet on the ids alone first, so that texts are dealt out once, before they are taken apart."""
    degree = edges.groupBy("source", F.col("src").alias("doc_id")).agg(F.count("*").cast("int").alias("out_degree"))
    ids = raw.groupBy("doc_id", "source").agg(F.max(F.col("doc_id") % 20).alias("r"))
    more = ids.join(degree, ["doc_id", "source"], "left").join(vectors, "doc_id", "left")
    return raw.join(more.hint("shuffle_hash"), ["doc_id", "source"]).withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.filter(F.transform("embedding", lambda w, k: F.struct(k.cast("bigint").alias("hash"), w.cast("double").alias("weight"))), lambda e: e["weight"] > 0)
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), entries.alias("vector"))


def _edges(docs: DataFrame) -> DataFrame:
    """The document 20 ids on in the same source, the first one of the source (from every fourth), and itself (every tenth)."""
    ids = docs.select("doc_id", "source")
    following = ids.join(ids.select((F.col("doc_id") - 20).alias("doc_id"), "source"), ["doc_id", "source"]).select("source", F.col("doc_id").alias("src"), (F.col("doc_id") + 20).alias("dst"))
    first = ids.join(ids.groupBy("source").agg(F.min("doc_id").alias("dst")), "source").where("doc_id % 4 = 0").select("source", F.col("doc_id").alias("src"), "dst")
    itself = ids.where("doc_id % 10 = 0").select("source", F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    return following.unionByName(first).unionByName(itself).distinct()


def _finished(rows: DataFrame, edges: DataFrame, build: str, sources: DataFrame) -> Model:
    """rows: func_id, source, name, addr, size, bb_count, words, edit, string_refs, imports, vector, out_degree; edges by func_id; sources that have rows."""
    program = F.concat(F.lit(f"{build}."), F.col("source")).alias("program_id")
    calls = edges.select(program, F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("dst").alias("edge_seq"))
    # each from the words: a function's lists are then made in one go, and those that nobody reads are not made
    ordered = lambda: _mnemonics("words", "edit")
    functions = rows.select(
        program, "func_id", F.col("func_id").alias("func_seq"), F.col("addr").cast("decimal(20,0)").alias("addr"), "name", "size", "bb_count", "out_degree",
        histogram_fingerprint(counted_items(ordered())).alias("fingerprint"), counted_items(ordered()).alias("mnemonics"), counted_trigrams(ordered()).alias("trigrams"),
        "string_refs", "imports", F.array().cast("array<string>").alias("callee_names"), "vector",
    )
    spark = rows.sparkSession
    programs = sources.select("source").distinct().select(program).select("program_id", F.col("program_id").alias("name"), F.lit("text").alias("language"))
    return Model(programs, functions, calls, empty(spark, "facts"), empty(spark, "edge_provenance"))


def build_a(spark: SparkSession, sf_dir: str) -> Model:
    docs = _raw(spark, sf_dir)
    calls = _edges(docs)
    rows = _parts(_joined(docs, calls, _vectors(spark, sf_dir)), "out_degree", "vector").select(
        (F.col("doc_id") + 1).alias("func_id"), "source", F.concat("source", F.lit(".f"), F.col("doc_id")).alias("name"), (4096 + 16 * F.col("doc_id")).alias("addr"), "size", "bb_count",
        "words", F.lit(0).alias("edit"), _long_words("words").alias("string_refs"), "imports", "vector", "out_degree",
    )
    edges = calls.select("source", (F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    model = _finished(rows, edges, "A", docs)
    labels = _table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id")
    third = F.col("doc_id") % 3
    producer = F.when(third == 0, "user").otherwise("engine").alias("producer")
    confidence = F.when(third == 0, 100).when(third == 1, 45).otherwise(95).alias("confidence")
    named = F.array_compact(F.array(
        F.when(F.col("quality") == 1, F.struct(F.lit(0).alias("k"), F.lit("rename").alias("kind"), F.concat(F.lit("q"), F.col("quality")).alias("value"))),
        F.when(F.col("toxic") == 1, F.struct(F.lit(1).alias("k"), F.lit("comment").alias("kind"), F.lit("toxic").alias("value"))),
    ))
    facts = labels.select("doc_id", "source", producer, confidence, F.explode(named).alias("f")).select(
        F.concat(F.lit("A."), "source").alias("program_id"), (2 * F.col("doc_id") + F.col("f.k")).alias("fact_seq"), (F.col("doc_id") + 1).alias("target"), "f.kind", "f.value", F.lit(None).cast("string").alias("author"), "producer", "confidence",
    )
    return model.with_(facts=facts)


def build_b(spark: SparkSession, sf_dir: str) -> Model:
    """By doc_id % 20: 3 removed; 5 body edited; 7 last quarter and calls to others cut; 9 mnemonics, anchors and
    calls gone; 11 mnemonics reversed, anchors, vector and calls gone; 13 renamed; 17 changed in every way. By
    doc_id % 50: 1 also adds a function. Every function has a new id.
    """
    plain = _raw(spark, sf_dir)
    kept = F.when((F.col("src") % 20).isin(9, 11, 17), False).when(F.col("src") % 20 == 7, F.col("src") == F.col("dst")).otherwise(True)
    calls = _edges(plain).where(kept & (F.col("src") % 20 != 3) & (F.col("dst") % 20 != 3))
    docs = _parts(_joined(plain, calls, _vectors(spark, sf_dir)), "out_degree", "vector", "r")
    r, none = F.col("r"), F.array().cast("array<string>")
    words = F.when(r == 5, F.concat("words", F.lit(" zz"))).when(r == 9, "").otherwise(F.col("words"))
    size = F.when(r == 5, F.col("size") + 64).when(r == 7, F.col("size") - 7).when(r == 9, F.col("size") + 11).when(r == 11, F.col("size") + 1).when(r == 17, 2 * F.col("size") + 1).otherwise(F.col("size"))
    blocks = F.when(r == 5, F.col("bb_count") + 3).when(r == 17, 2 * F.col("bb_count") + 7).otherwise(F.col("bb_count"))
    bare = r.isin(9, 11, 17)
    rows = docs.where("r <> 3").select(
        (F.col("doc_id") + SHIFT).alias("func_id"), "source", F.concat("source", F.lit(".f"), F.col("doc_id"), F.when(r == 13, "_v2").otherwise("")).alias("name"), (8192 + 16 * F.col("doc_id")).alias("addr"), size.alias("size"), blocks.alias("bb_count"), words.alias("words"), r.cast("int").alias("edit"),
        F.when(bare, none).otherwise(_long_words("words")).alias("string_refs"), F.when(bare, none).otherwise(F.col("imports")).alias("imports"), F.when(~r.isin(11, 17), F.col("vector")).alias("vector"), "out_degree",
    )
    added = plain.where("doc_id % 50 = 1").select(
        (F.col("doc_id") + NEW).alias("func_id"), "source", F.concat("source", F.lit(".new"), F.col("doc_id")).alias("name"), (8200 + 16 * F.col("doc_id")).alias("addr"), (F.col("doc_id") + 3).alias("size"), F.lit(2).cast("bigint").alias("bb_count"), F.lit("in it re").alias("words"), F.lit(0).alias("edit"),
        none.alias("string_refs"), none.alias("imports"), F.lit(None).cast("array<struct<hash:bigint,weight:double>>").alias("vector"), F.lit(0).alias("out_degree"),
    )
    edges = calls.select("source", (F.col("src") + SHIFT).alias("src"), (F.col("dst") + SHIFT).alias("dst"))
    return _finished(rows.unionByName(added), edges, "B", plain.where("doc_id % 20 <> 3 or doc_id % 50 = 1"))


def incoming(spark: SparkSession, sf_dir: str) -> Model:
    """Build A's functions as another analyst has them: own ids, the same notes, some with other values and confidence."""
    a = build_a(spark, sf_dir)
    shift = lambda c: (F.col(c) + SHIFT).alias(c)
    program = F.concat(F.lit("I"), F.substring("program_id", 2, 1_000)).alias("program_id")
    doc = F.col("target") - 1
    value = F.when(doc % 7 == 0, F.concat("value", F.lit("_2"))).otherwise(F.col("value"))
    facts = a.facts.select(program, "fact_seq", shift("target"), F.when(doc % 11 == 0, "retype").otherwise(F.col("kind")).alias("kind"), value.alias("value"), "author", "producer", F.when(doc % 14 == 0, 100).otherwise(F.col("confidence")).alias("confidence"))
    functions = a.functions.withColumns({"program_id": F.concat(F.lit("I"), F.substring("program_id", 2, 1_000)), "func_id": F.col("func_id") + SHIFT, "func_seq": F.col("func_seq") + SHIFT})
    edges = a.call_edges.select(program, shift("src_id"), shift("dst_id"), "edge_seq")
    return Model(a.programs.select(program, "name", "language"), functions, edges, facts, a.edge_provenance)


def both(a: Model, b: Model) -> Model:
    """The tables of two models together; their programs have different ids."""
    return Model(*(getattr(a, t).unionByName(getattr(b, t)) for t in SCHEMAS))


def pairs(model: Model, old: str = "A", new: str = "B") -> DataFrame:
    """(pair_id, prog_a, prog_b): each program of the old build with the one of the new build."""
    sources = model.programs.where(F.col("program_id").startswith(f"{old}.")).select(F.substring("program_id", len(old) + 2, 1_000).alias("pair_id"))
    return sources.select("pair_id", F.concat(F.lit(f"{old}."), "pair_id").alias("prog_a"), F.concat(F.lit(f"{new}."), "pair_id").alias("prog_b"))


def feature_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(functions, instructions, refs) as rows, for `snapshots.function_features`: a document's tokens, long tokens, calls and language."""
    docs = _documents(spark, sf_dir)
    key = (F.concat(F.lit("A."), "source").alias("program_id"), F.col("doc_id").cast("string").alias("func_entry"))
    functions = docs.select(*key, F.lit(False).alias("external"), (F.col("doc_id") % 25 == 24).alias("thunk"))
    instructions = docs.select(*key, F.posexplode("ordered").alias("ord", "mnemonic"))
    blank = F.lit(None).cast("string")
    ref = lambda kind, entry, name, external, text: (F.lit(0).alias("ord"), F.lit(kind).alias("ref_kind"), entry.alias("target_entry"), name.alias("target_name"), F.lit(external).alias("target_external"), text.alias("string_value"))
    calls = _edges(docs).select(F.concat(F.lit("A."), "source").alias("program_id"), F.col("src").cast("string").alias("func_entry"), *ref("call", F.col("dst").cast("string"), F.concat("source", F.lit(".f"), "dst"), False, blank))
    imports = docs.select(*key, F.explode("imports").alias("_i")).select("program_id", "func_entry", *ref("call", blank, F.col("_i"), True, blank))
    strings = docs.select(*key, F.explode("string_refs").alias("_s")).select("program_id", "func_entry", *ref("data", blank, blank, False, F.col("_s")))
    return functions, instructions, calls.unionByName(imports).unionByName(strings)


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build A as materialize events: for each program a header, then one event a function with its callees' addresses."""
    docs, none = _documents(spark, sf_dir), F.array().cast("array<string>")
    at = lambda doc: F.concat(F.lit("0x"), F.lower(F.hex(4096 + 16 * doc)))
    calls = _edges(docs).groupBy("source", F.col("src").alias("doc_id")).agg(F.array_sort(F.collect_list(at(F.col("dst")))).alias("callees"))  # a document has three at most
    program = F.concat(F.lit("A."), F.col("source")).alias("program_id")
    function = F.struct(
        at(F.col("doc_id")).alias("entry"), F.concat("source", F.lit(".f"), "doc_id").alias("name"), "size", "bb_count", F.size("ordered").cast("bigint").alias("mnemonic_count"), F.coalesce("callees", none).alias("callees"),
        "imports", "string_refs", none.alias("callee_names"), F.array().cast("array<array<bigint>>").alias("bsim_vector"), F.col("ordered").alias("mnemonics"),
    )
    functions = docs.join(calls, ["source", "doc_id"], "left").select(program, F.col("doc_id").alias("seq"), F.lit("function").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("language"), function.alias("f"))
    heads = docs.select("source").distinct().select(program, F.lit(-1).cast("bigint").alias("seq"), F.lit("info").alias("kind"), F.upper("source").alias("name"), F.lit("text").alias("language"))
    return functions.unionByName(heads, allowMissingColumns=True)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the document (doc_id, source) each is about: the event's number among the documents' ids, round and round."""
    docs = _table(spark, sf_dir, "documents").where("doc_id is not null and source is not null").select("doc_id", "source")
    ids = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    return _table(spark, sf_dir, "events").withColumn("doc_id", F.pmod("event_id", F.lit(ids))).join(docs, "doc_id")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges seen at run time, from events: a document calls the one 20 on, or after an error something unknown."""
    to = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(F.concat("source", F.lit(".f"), F.col("doc_id") + 20))
    return event_documents(spark, sf_dir).select(F.concat(F.lit("A."), "source").alias("program_id"), F.col("user_id").alias("run_id"), F.concat("source", F.lit(".f"), "doc_id").alias("from_name"), to.alias("to_name"), F.lit(90).alias("confidence"))


def import_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved at run time, from events: a document's import is the event's type; of every 17 documents one has a name that nobody knows."""
    name = F.concat("source", F.lit(".f"), "doc_id", F.when(F.col("doc_id") % 17 == 5, "?").otherwise("")).alias("function")
    return event_documents(spark, sf_dir).select(F.concat(F.lit("A."), "source").alias("program_id"), name, F.col("event_type").alias("import"), "event_id")


RUN, CHUNK = 500, 100  # events of one run, functions of one snapshot


def import_trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import traces as JSON texts (program_id, run_id, text), one for each run of a program; every eighth run's text is cut off."""
    run = F.floor(F.col("event_id") / RUN).alias("run_id")
    grouped = import_traces(spark, sf_dir).groupBy("program_id", run).agg(F.array_sort(F.collect_list(F.struct("event_id", "function", "import"))).alias("e"))  # RUN events at most
    text = F.to_json(F.struct(F.transform("e", lambda e: F.struct(e["function"].alias("function"), e["import"].alias("import"))).alias("resolved_imports")))
    return grouped.select("program_id", "run_id", F.when(F.col("run_id") % 8 == 7, F.substring(text, 1, 25)).otherwise(text).alias("text"))


def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build A as JSON snapshots (program_id, text) of at most CHUNK functions each.

    By chunk % 5: 1 has no language, 2 is cut off, 3 names no program, 4 has a function without an entry.
    """
    rows = engine_events(spark, sf_dir).where("kind = 'function'").select("program_id", F.floor(F.col("seq") / CHUNK).alias("chunk"), "seq", "f")
    v = F.col("chunk") % 5
    f = F.when((v == 4) & (F.col("seq") % CHUNK < 25), F.col("f").withField("entry", F.lit(None).cast("string"))).otherwise(F.col("f"))
    held = rows.groupBy("program_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", f.alias("f")))).alias("l"))
    text = F.to_json(F.struct(F.when(v != 3, F.col("program_id")).alias("program"), F.when(v != 1, "text").alias("language"), F.col("l.f").alias("functions")))
    cut = F.when(v == 2, F.expr("left(_text, length(_text) - 1)")).otherwise(F.col("_text"))
    return held.withColumn("_text", text).select(F.concat("program_id", F.lit("."), "chunk").alias("program_id"), cut.alias("text"))


def _framed(payload: Column, size: Column, mark: Column, end: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"[\r\n]", ""), "(.{4000})", "$1\n")
    return F.concat(F.lit("TRACE-V1 BEGIN\r\n"), body, F.lit("\n  TRACE-V1 "), end, F.lit(" len="), size, F.lit(" fnv="), mark, F.lit("\n"))


@F.arrow_udf(StringType())
def _marks(payloads: pa.Array) -> pa.Array:
    raw, few = payloads.cast(pa.binary()), 128  # at a time: a payload may have a quarter of a megabyte
    return pa.array([f"{h:016x}" for at in range(0, len(raw), few) for h in checksums(raw.slice(at, few).to_pylist())], pa.string())


def observation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed calls as framed logs (program_id, run_id, log), one for each run of a program.

    By run % 16: 0, 13 (amid noise), 14 (after a stray end) and 15 (before a second frame, which is none) are sound; the others
    are wrong in one way each, in the order of the cases below.
    """
    to = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(F.concat("source", F.lit(".f"), F.col("doc_id") + 20))
    run = F.floor(F.col("event_id") / RUN)
    sure = F.when(run % 16 == 12, 101).otherwise(90)
    edge = F.struct("event_id", F.struct(F.concat("source", F.lit(".f"), "doc_id").alias("from"), to.alias("to"), sure.alias("confidence")).alias("e"))
    runs = event_documents(spark, sf_dir).groupBy(F.concat(F.lit("A."), "source").alias("program_id"), run.alias("run")).agg(F.array_sort(F.collect_list(edge)).alias("l"))  # RUN events at most
    v = F.col("run") % 16
    json = F.to_json(F.struct(F.col("l.e").alias("edges")))
    payload = (
        F.when(v == 6, F.concat(json, F.repeat(F.lit(" "), 262_145))).when(v == 9, F.substring(json, 1, 20)).when(v == 10, '{"edges":{}}')
        .when(v == 11, F.concat(F.lit('{"edges":['), F.repeat(F.lit("{},"), 4_096), F.lit("{}]}"))).otherwise(json)
    )
    rows = runs.select("program_id", F.col("run").cast("string").alias("run_id"), v.alias("v"), payload.alias("payload")).withColumn("mark", _marks("payload"))
    v = F.col("v")
    size = (F.octet_length("payload") + F.when(v == 7, 1).otherwise(0)).cast("string")
    frame = _framed(F.col("payload"), size, F.when(v == 8, "0").otherwise(F.col("mark")), F.when(v == 4, "STOP").otherwise("END"))
    before = (
        F.when(v == 1, F.repeat(F.lit("x\n"), 524_289)).when(v == 2, F.concat(F.repeat(F.lit("y"), 16_385), F.lit("\n"))).when(v == 3, F.repeat(F.lit("\n"), 20_000))
        .when(v == 13, "booting\n\nTRACE-V1 BEGINNING\n").when(v == 14, "TRACE-V1 END len=0 fnv=0\n").otherwise("")
    )
    frame = F.when(v == 5, F.replace(frame, F.lit("BEGIN\r\n"), F.lit("BEGIN\r\n!!\n"))).otherwise(frame)
    after = F.when(v == 13, "halted").when(v == 15, "TRACE-V1 BEGIN\n!!\nTRACE-V1 END len=2 fnv=0").otherwise("")
    return rows.select("program_id", "run_id", F.encode(F.concat(before, frame, after), "UTF-8").alias("log"))


__all__ = ["both", "build_a", "build_b", "event_documents", "import_trace_texts", "import_traces", "incoming", "observation_logs", "observed", "pairs", "snapshot_texts"]
