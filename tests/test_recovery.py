"""Notes carried between builds of small programs, from snapshot files to scores, and the rules of the diff ladder on them."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from twinbuild.functions import similarity
from twinbuild.operators import diff, evaluate, matching, merge, navigate
from twinbuild.plans.queries import QUERIES, _both
from twinbuild.sources import observations, snapshots

TRUTH = ("main", "gcd", "fib", "fact", "sum")


def bits(x):
    return struct.unpack("<I", struct.pack("<f", x))[0]


def vector(*weights):
    return [[k + 1, bits(w)] for k, w in enumerate(weights) if w]


def function(entry, name, mnemonics, callees=(), size=10, bb=1, strings=(), imports=(), vec=()):
    return {"entry": f"{entry:x}", "name": name, "size": size, "bb_count": bb, "callees": [f"{c:x}" for c in callees], "string_refs": list(strings), "imports": list(imports), "bsim_vector": list(vec), "mnemonics": list(mnemonics)}


def stubs(base):
    """Start-up code; the two last are twins."""
    return [function(base, "_init", ["SUB", "TEST", "RET"], size=23), function(base + 16, "pad1", ["NOP"], size=1), function(base + 32, "pad2", ["NOP"], size=1)]


TEXTS, CALLS = ("usage: calc", "bad number"), ("printf", "atoi")


def plain(base=0x1000, extra=(), main_body=(), main_calls=()):
    at = lambda k: base + 256 * k
    return [
        function(at(0), "main", ["PUSH", "MOV", "CALL", "CALL", "CALL", "CALL", "RET", *main_body], [at(1), at(2), at(3), at(4), *main_calls], 90, 7, TEXTS, CALLS, vector(3, 1, 0, 2, 1)),
        function(at(1), "gcd", ["MOV", "CDQ", "IDIV", "CMP", "JNE", "RET"], (), 40, 4, vec=vector(1, 0, 0, 0, 9, 0, 0, 3)),
        function(at(2), "fib", ["PUSH", "CMP", "JG", "CALL", "CALL", "ADD", "RET"], [at(2)], 55, 4, vec=vector(0, 2, 5, 1, 0, 0, 4)),
        function(at(3), "fact", ["PUSH", "MOV", "IMUL", "SUB", "CMP", "RET"], (), 48, 3, vec=vector(2, 2, 2, 7, 0, 1)),
        function(at(4), "sum", ["PUSH", "MOV", "ADD", "INC", "CMP", "JLE", "RET"], (), 51, 3, vec=vector(2, 7, 1, 2, 0, 1)),
        *stubs(base + 0x900), *extra,
    ]


def edited():
    lcm = function(0x1a00, "lcm", ["PUSH", "IMUL", "CALL", "IDIV", "RET"], [0x1100], 60, 2)
    return plain(extra=[lcm], main_body=["CALL", "NOP"], main_calls=[0x1a00])


def optimised():
    """Small functions are gone into main, and nothing keeps its body; main still has its strings, fib calls itself."""
    return [
        function(0x2000, "main", ["ENDBR64", "LEA", "IMUL", "JNE", "SUB", "JMP", "RET"] * 9, [0x2100], 310, 31, TEXTS, CALLS),
        function(0x2100, "fib", ["TEST", "LEA", "XOR", "JMP"] * 22, [0x2100], 280, 19), *stubs(0x2900),
    ]


def other_machine():
    """Every mnemonic, size and block count differs; vectors of fact and sum stay, gcd's is near another's."""
    return [
        function(0x4000, "main", ["stp", "mov", "bl", "bl", "bl", "bl", "ldp", "ret"], [0x4100, 0x4200, 0x4300, 0x4400], 130, 9, TEXTS, CALLS, vector(3, 1, 0, 2, 2)),
        function(0x4100, "gcd", ["sdiv", "msub"] * 3, (), 300, 21, vec=vector(0, 0, 0, 0, 1, 0, 8, 9)),
        function(0x4200, "fib", ["stp", "cmp", "b.gt"] * 11, [0x4200], 410, 33, vec=vector(0, 2, 5, 1, 3, 0, 4)),
        function(0x4300, "fact", ["mul", "subs"] * 7, (), 290, 17, vec=vector(2, 2, 2, 7, 0, 1)),
        function(0x4400, "sum", ["add", "cbnz"] * 5, (), 260, 15, vec=vector(2, 7, 1, 2, 0, 1)),
        function(0x4900, "start", ["b"], size=4, vec=vector(0, 0, 0, 0, 7, 0, 7, 7)),
    ]


BUILDS = {"old": plain(), "same": plain(), "moved": plain(0x7000), "edit": edited(), "fast": optimised(), "arm": other_machine()}
# pair: (ok, wrong, orphan, floor)
EXPECTED = {"same": (5, 0, 0, 1.0), "moved": (5, 0, 0, 1.0), "edit": (5, 0, 0, 1.0), "fast": (2, 0, 3, 0.4), "arm": (4, 0, 1, 0.8)}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("snapshots")
    for name, functions in BUILDS.items():
        (folder / f"{name}.json").write_text(json.dumps({"program": name, "language": "x", "function_count": len(functions), "functions": functions}))
    good, bad = snapshots.read_snapshots(spark, str(folder))
    assert bad.isEmpty()
    return snapshots.build_model(good), spark.createDataFrame([(x, "old", x) for x in EXPECTED], "pair_id string, prog_a string, prog_b string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(x,) for x in TRUTH], "name string")


def test_recovery_gate(spark, loaded, names):
    model, pairs = loaded
    floors = spark.createDataFrame([(k, v[3]) for k, v in EXPECTED.items()], "pair_id string, floor double")
    rows = {r["pair_id"]: r for r in evaluate.score_reanchoring(model, pairs, names, floors).collect()}
    assert {k: (r["ok"], r["wrong"], r["orphan"]) for k, r in rows.items()} == {k: v[:3] for k, v in EXPECTED.items()}
    assert all(r["gate_ok"] for r in rows.values())


def test_ablation_loses_what_anchors_gave(loaded, names):
    model, pairs = loaded
    rows = {r["pair_id"]: r for r in evaluate.score_reanchoring(model, pairs, names, anchor_features=("imports",)).collect()}
    full = {r["pair_id"]: r for r in evaluate.score_reanchoring(model, pairs, names, anchor_features=("string_refs", "imports")).collect()}
    none = {r["pair_id"]: r for r in evaluate.score_reanchoring(model, pairs, names, anchor_features=()).collect()}
    assert full["fast"]["ok"] == rows["fast"]["ok"] == 2 and none["fast"]["ok"] == 0 and none["edit"]["ok"] == 5 and all(r["wrong"] == 0 for r in none.values())


def test_ladder(loaded):
    model, pairs = loaded
    found = diff.diff_programs(model, pairs)
    by = {}
    for r in diff.method_counts(found).collect():
        by.setdefault(r["pair_id"], {})[r["method"]] = r["n"]
    assert by["same"] == by["moved"] == {"exact": 6} and by["edit"]["exact"] == 5 and sum(by["edit"].values()) == 6
    rows = diff.diff_rows(found, navigate.display_names(model), pairs)
    kinds = {(r["pair_id"], r["kind"], r["b_name"] or r["a_name"]) for r in rows.collect()}
    assert ("edit", "modified", "main") in kinds and ("edit", "added", "lcm") in kinds and ("same", "removed", "pad1") in kinds and ("same", "added", "pad1") in kinds
    status = {(r["pair_id"], r["program_id"], r["func_id"]): r["status"] for r in diff.graph_diff_status(model, rows, pairs).collect()}
    assert status["edit", "edit", 9] == "only-here" and status["edit", "edit", 1] == "changed" and status["edit", "old", 2] == "unchanged" and len(status) == sum(len(BUILDS["old"]) + len(BUILDS[k]) for k in EXPECTED)
    # a function is matched once, and what is exact has the same signature
    for side in ("a_id", "b_id"):
        assert found.matches.groupBy("pair_id", side).count().where("count > 1").isEmpty()
    assert found.matches.where("method = 'exact' and (status <> 'matched' or confidence <> 100)").isEmpty()


def test_matrix_of_vectors(loaded):
    model, pairs = loaded
    a, b = matching.two_sides(model, pairs.where("pair_id = 'arm'"))
    rows = {r["a_id"]: r for r in evaluate.similarity_matrix(a, b).collect()}
    assert {k: (rows[k]["b_id"], rows[k]["outcome"]) for k in (3, 4, 5)} == {3: (3, "matched"), 4: (4, "matched"), 5: (5, "matched")}
    assert rows[2]["b_id"] == 6 and abs(rows[4]["score"] - 1) < 1e-9


def test_lists_and_summaries(loaded):
    model, _ = loaded
    listed = navigate.list_functions(model).where("program_id = 'edit'").collect()
    assert [r["name"] for r in listed] == sorted(f["name"] for f in BUILDS["edit"])
    assert {r["name"] for r in navigate.search(model, "5 out-call", in_summary=True).collect()} == {"main"} and navigate.search(model, "5 out-call").isEmpty()
    assert [r["name"] for r in navigate.symbol_search(model, "LCM").collect()] == ["lcm"]


def test_import_traces_of_files(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"resolved_imports": [{"function": "main", "import": "puts"}, {"function": None, "import": "x"}]}))
    (tmp_path / "none.json").write_text(json.dumps({"other": 1}))
    assert [tuple(r) for r in observations.read_import_traces(spark, str(tmp_path)).collect()] == [("old", "main", "puts")]


@pytest.mark.parametrize("name", ["exact_matches", "propagation_round", "anchor_round", "vector_round", "fuzzy_round"])
def test_rounds_are_one_to_one_and_do_not_depend_on_partitions(spark, sf_dir, name):
    query = QUERIES[name]
    got = []
    for n in ("3", "11"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(sorted(tuple(r) for r in query(spark, sf_dir).select("pair_id", "a_id", "b_id").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len({x[:2] for x in got[0]}) == len({(x[0], x[2]) for x in got[0]}) == len(got[0])


def test_scores_do_not_depend_on_blocks(spark, loaded):
    model, pairs = loaded
    a, b = matching.two_sides(model, pairs)
    rows = lambda block: {(r["pair_id"], r["a_id"], r["b_id"]): round(r["score"], 9) for r in matching.fuzzy_scores(a, b, block=block).collect()}
    want = {
        (r["pair_id"], r["a_id"], r["b_id"]): round(r["s"], 9)
        for r in a.select("pair_id", F.col("func_id").alias("a_id"), F.struct("mnemonics", "trigrams", "bb_count", "out_degree").alias("x"))
        .join(b.select("pair_id", F.col("func_id").alias("b_id"), F.struct("mnemonics", "trigrams", "bb_count", "out_degree").alias("y")), "pair_id")
        .select("pair_id", "a_id", "b_id", similarity.similarity("x", "y").alias("s")).where("s >= 0.5 - 1e-9").collect()
    }
    assert rows(2) == rows(1000) == want


def test_queries_without_sql_add_up(spark):
    """Each function is in a diff once, each fact in a merge once, and the counts are those of the rows."""
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    model, pairs = _both(spark, sf_dir)
    functions = {r["program_id"]: r["count"] for r in model.functions.groupBy("program_id").count().collect()}
    rows = QUERIES["diff_rows"](spark, sf_dir).cache()
    for side, gone in (("a", "added"), ("b", "removed")):
        own = rows.where(F.col("kind") != gone)
        assert own.where(f"{side}_id is null").isEmpty() and own.groupBy("pair_id", f"{side}_id").count().where("count > 1").isEmpty()
        assert {r["pair_id"]: r["count"] for r in own.groupBy("pair_id").count().collect()} == {p[2:]: n for p, n in functions.items() if p.startswith(f"{side.upper()}.")}
    kinds = {(r["pair_id"], r["kind"]): r["count"] for r in rows.groupBy("pair_id", "kind").count().collect()}
    for r in diff.diff_summary(rows).collect():
        assert all(r[k] == kinds.get((r["pair_id"], k), 0) for k in ("unchanged", "renamed", "modified", "added", "removed"))
    facts = {r["pair_id"]: r["count"] for r in model.facts.groupBy(F.expr("substring(program_id, 3)").alias("pair_id")).count().collect()}
    merged, flagged, _ = merge.reanchor_facts(model, pairs)
    assert {r["pair_id"]: r["count"] for r in merged.select("pair_id").unionByName(flagged.select("pair_id")).groupBy("pair_id").count().collect()} == facts
    assert merged.groupBy("pair_id", "fact_seq").count().where("count > 1").isEmpty()


def test_snapshot_and_trace_texts(spark):
    f = {"entry": "0x10", "name": "main", "size": 3, "bb_count": 1, "callees": ["0x10", "0x99"]}
    rows = [
        ("good", json.dumps({"program": "p", "language": "c", "functions": [f]})), ("bare", json.dumps({"program": "p", "functions": []})), ("cut", json.dumps({"program": "p", "functions": [f]})[:-1]),
        ("nameless", json.dumps({"functions": [f]})), ("negative", json.dumps({"program": "p", "functions": [f | {"size": -1}]})), ("typed", json.dumps({"program": "p", "functions": [f | {"size": "x"}]})), ("null", None), ("empty", ""),
    ]
    sound, rejected = snapshots.parse_snapshots(spark.createDataFrame(rows, "program_id string, text string"))
    assert {r["program_id"]: r["language"] for r in sound.collect()} == {"good": "c", "bare": ""}
    assert {r["program_id"]: r["reason"] for r in rejected.collect()} == {"cut": "malformed", "nameless": "missing_field", "negative": "bad_function", "typed": "malformed", "null": "missing_field", "empty": "missing_field"}
    assert [tuple(r) for r in snapshots.build_model(sound).call_edges.select("program_id", "src_id", "dst_id").collect()] == [("good", 1, 1)]
    traces = [("a", json.dumps({"resolved_imports": [{"function": "f", "import": "i"}, {"function": "g"}, None]})), ("b", '{"resolved_imports":[{"fun'), ("c", None), ("d", "[]")]
    assert [tuple(r) for r in observations.parse_import_traces(spark.createDataFrame(traces, "program_id string, text string")).collect()] == [("a", "f", "i")]


def test_checksums_together_are_those_of_each():
    import random

    rng = random.Random(2)
    values = [rng.randbytes(rng.choice((0, 1, 7, 300))) for _ in range(120)] + [rng.randbytes(5_000)]
    assert observations.checksums(values) == [observations.checksum(v) for v in values]
    assert observations.checksums([]) == [] and observations.checksums([b"a"]) == [0xAF63DC4C8601EC8C]
