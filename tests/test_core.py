"""Operators on small hand-made programs."""

import base64
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinbuild.functions import guards, similarity
from twinbuild.functions.features import decode_f32_bits, histogram_fingerprint
from twinbuild.operators import diff, evaluate, facts, matching, merge, navigate, observe, validate
from twinbuild.plans.model import empty, read_model, write_model
from twinbuild.sources import observations, snapshots
from twinbuild.streaming import jobs
from twinbuild.streaming.keyed import KeyedTable

F_DDL = snapshots.FUNCTION


def fn(entry, name, mnemonics=(), callees=(), size=10, bb=1, strings=(), imports=(), names=(), vector=()):
    return {"entry": entry, "name": name, "size": size, "bb_count": bb, "mnemonic_count": len(mnemonics), "callees": list(callees), "imports": list(imports), "string_refs": list(strings), "callee_names": list(names), "bsim_vector": [list(v) for v in vector], "mnemonics": list(mnemonics)}


def programs(spark, **lists):
    rows = [(k, k, "x86", v) for k, v in lists.items()]
    return snapshots.build_model(spark.createDataFrame(rows, f"program_id string, program string, language string, functions array<{F_DDL}>"))


def one_pair(spark):
    return spark.createDataFrame([("p", "a", "b")], "pair_id string, prog_a string, prog_b string")


def with_facts(spark, model, *rows):
    return model.with_(facts=spark.createDataFrame([(p, k, t, kind, v, None, "user", c) for k, (p, t, kind, v, c) in enumerate(rows)], empty(spark, "facts").schema))


def test_ambiguous_and_dangling_calls_are_dropped(spark):
    m = programs(spark, a=[fn("10", "f", callees=["0x20", "30", "99", "zz"]), fn("20", "g"), fn("30", "h"), fn("0x30", "twin")])
    assert [(r["src_id"], r["dst_id"]) for r in m.call_edges.collect()] == [(1, 2)]
    assert {r["func_id"]: r["out_degree"] for r in m.functions.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_addresses(spark):
    rows = [("10", 16), (" 0xFFFFFFFFFFFFFFFF ", 2**64 - 1), ("0x0x1", None), ("", None), ("xyz", None), ("+1f", 31), ("1" * 17, None), ("0" * 20 + "1", 1)]
    got = spark.createDataFrame([(t, None if w is None else Decimal(w)) for t, w in rows], "t string, w decimal(20,0)").select(snapshots.parse_addr(F.col("t")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_fingerprint_values(spark):
    rows = [([("MOV", 2), ("PUSH", 1), ("RET", 1)], 0x9CEA346BBBB5F162 - (1 << 64)), ([("MOV", 2), ("RET", 1)], 4610646521357419491), ([], 0)]
    got = spark.createDataFrame(rows, "h array<struct<mnemonic:string,count:bigint>>, w bigint").select(histogram_fingerprint("h").alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_float_bits(spark):
    rows = [(0x3F800000, 1.0), (0xC0490FDB, -3.1415927410125732), (1, 2.0**-149), (0x7F800000, None), (0x7FC00000, None), (0, 0.0)]
    assert all(r["g"] == r["w"] for r in spark.createDataFrame(rows, "b bigint, w double").select(decode_f32_bits(F.col("b")).alias("g"), "w").collect())


def test_snapshot_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"program": "g", "language": "x", "functions": [{"entry": "1", "name": "f", "size": 1, "bb_count": 1}]}))
    (tmp_path / "broken.json").write_text('{"program": "g", "functions": [')
    (tmp_path / "wrong.json").write_text(json.dumps({"program": "g", "functions": [{"entry": "1", "name": "f", "size": "x", "bb_count": 1}]}))
    (tmp_path / "short.json").write_text(json.dumps({"program": "g", "functions": [{"entry": "1", "name": "f", "size": 1}]}))
    good, bad = snapshots.read_snapshots(spark, str(tmp_path))
    assert [r["program_id"] for r in good.collect()] == ["good"] and {r["program_id"] for r in bad.collect()} == {"broken", "wrong", "short"}


def test_events_and_caps(spark):
    f = fn("1", "f", ["A", "B"])
    events = spark.createDataFrame([("p", 1, "info", "x", "l", None), ("p", 2, "function", None, None, f), ("p", 3, "none", None, None, None), ("p", 4, "function", None, None, f), ("p", 5, "info", "", "m", None)], jobs.EVENTS)
    m = snapshots.model_from_events(events, "fallback")
    assert m.programs.collect()[0]["name"] == "fallback" and sorted(r["func_id"] for r in m.functions.collect()) == [1, 2]
    ok, refused = snapshots.enforce_caps(events.where("f is not null"), functions=2)
    assert ok.count() == 2 and refused.count() == 0
    assert snapshots.enforce_caps(events.where("f is not null"), mnemonics=3)[1].collect()[0]["refused"] == "mnemonics"


def test_rows_to_features(spark):
    functions = spark.createDataFrame([("p", "1", False, False), ("p", "2", True, False)], "program_id string, func_entry string, external boolean, thunk boolean")
    instructions = spark.createDataFrame([("p", "1", 2, "B"), ("p", "1", 1, "A"), ("p", "2", 1, "X")], "program_id string, func_entry string, ord int, mnemonic string")
    refs = spark.createDataFrame(
        [("p", "1", 1, "call", "9", "fmt.Print", False, None), ("p", "1", 2, "call", "8", "puts", True, None), ("p", "1", 3, "data", None, None, False, "hello"), ("p", "1", 4, "call", "7", "FUN_1.x", False, None), ("p", "1", 5, "call", "6", "a::b.c", False, None)],
        "program_id string, func_entry string, ord int, ref_kind string, target_entry string, target_name string, target_external boolean, string_value string",
    )
    (r,) = snapshots.function_features(functions, instructions, refs).collect()
    assert (r["mnemonics"], r["callees"], r["imports"], r["string_refs"], r["callee_names"]) == (["A", "B"], ["6", "7", "9"], ["puts"], ["hello"], ["fmt.Print"])


def test_round_trip_and_legacy_facts(spark, tmp_path):
    m = with_facts(spark, programs(spark, a=[fn("1", "f", ["A", "B", "C"])]), ("a", 1, "rename", "x", 100))
    m = m.with_(facts=m.facts.withColumn("producer", F.lit("")).withColumn("kind", F.lit("novel")))
    write_model(m, str(tmp_path))
    back = read_model(spark, str(tmp_path))
    assert back.functions.collect() == m.functions.collect()
    assert [(r["producer"], r["confidence"], r["kind"]) for r in back.facts.collect()] == [("user", 100, "comment")]


def test_validation_repairs_and_counts(spark):
    m = with_facts(spark, programs(spark, a=[fn("1", "é" * 40_000, ["A"], callees=["2"], strings=["s" * 70_000, "t"]), fn("2", "g")]), ("a", 1, "rename", "x", 101), ("a", 9, "rename", "x", 1))
    twin = m.functions.where("func_id = 2").withColumns({"func_seq": F.lit(7).cast("bigint"), "name": F.lit("late")})
    calls = spark.createDataFrame([("a", 1, 77, 5)], m.call_edges.schema)
    stamps = spark.createDataFrame([("a", 1, 2, 0, "dynamic", 200), ("a", 2, 1, 0, "dynamic", 90)], m.edge_provenance.schema)
    fixed, report = validate.validate_model(m.with_(functions=m.functions.unionByName(twin), call_edges=m.call_edges.unionByName(calls), edge_provenance=stamps))
    (r,) = report.collect()
    assert [r[c] for c in validate.REPORT] == [1, 1, 1, 1, 2] and not r["clean"]
    names = {x["func_id"]: x for x in fixed.functions.collect()}
    assert len(names[1]["name"].encode()) <= 65_536 and names[2]["name"] == "g" and [len(s) for s in names[1]["string_refs"]] == [65_536, 1]
    assert [x["confidence"] for x in fixed.facts.collect()] == [100] and [x["confidence"] for x in fixed.edge_provenance.collect()] == [100]
    assert all(r["clean"] for r in validate.validate_model(fixed)[1].collect())


def test_views_names_and_callers(spark):
    m = programs(spark, a=[fn("1", "main", callees=["2", "3"]), fn("2", "f", callees=["2"]), fn("3", "g")])
    m = with_facts(spark, m, ("a", 2, "rename", "first", 100), ("a", 2, "rename", "second", 100), ("a", 3, "comment", "note", 100))
    views = {r["func_id"]: r for r in navigate.function_views(m, "detail").collect()}
    assert views[1]["callees"] == ["first", "g"] and views[2]["callers"] == ["main", "first"] and views[2]["summary"] == "first — 1 block(s), 1 out-call(s), 2 caller(s)"
    assert navigate.function_views(m, "intent").where("addr is not null or size is not null or callees is not null").count() == 0
    assert [r["name"] for r in navigate.search(m, "FIR").collect()] == ["first"] and navigate.search(m, "").count() == 3 and navigate.search(m, "%").count() == 0
    ids = spark.createDataFrame([("a", 3), ("a", 8)], "program_id string, func_id bigint")
    assert {(r["func_id"], r["found"], r["caller_name"]) for r in navigate.callers(m, ids).collect()} == {(3, True, "main"), (8, False, None)}
    assert {r["func_id"]: r["found"] for r in navigate.view(m, ids).collect()} == {3: True, 8: False}
    assert {(r["src_id"], r["dst_id"]) for r in navigate.neighbourhood(m, ids).collect()} == {(1, 3)}
    assert {r["func_id"]: r["comment"] for r in navigate.annotated_views(m).collect()}[3] == "note"
    assert [r["text"] for r in navigate.listing(m).orderBy("line").collect()][0] == "0x00000001  main"


def test_call_depth(spark):
    m = programs(spark, a=[fn("1", "r", callees=["2", "3"]), fn("2", "x", callees=["3", "2"]), fn("3", "y"), fn("4", "c", callees=["5"]), fn("5", "d", callees=["4", "6"]), fn("6", "behind")])
    got = {r["func_id"]: (r["depth"], r["cyclic"]) for r in navigate.call_depth(m).collect()}
    assert got == {1: (0, False), 2: (1, False), 3: (2, False), 4: (None, True), 5: (None, True), 6: (None, True)}


def test_edits(spark):
    m = with_facts(spark, programs(spark, a=[fn("1", "f")]), ("a", 1, "rename", "old", 100), ("a", 1, "comment", "c", 100))
    edits = spark.createDataFrame([("a", 1, 1, "rename", "x", "me"), ("a", 2, 1, "rename", "y", "me"), ("a", 3, 1, "retype", " \t", "me"), ("a", 4, 7, "comment", "", "me"), ("a", 5, 1, "comment", "", "me")], jobs.EDITS)
    new, bad = facts.annotate(m, edits)
    assert {(r["kind"], r["value"]) for r in new.facts.collect()} == {("rename", "y"), ("comment", "")}
    assert {(r["edit_seq"], r["reason"]) for r in bad.collect()} == {(3, "invalid_input"), (4, "no_such_function")}


BODY = ["PUSH", "MOV", "ADD", "CMP", "JNE", "RET"]


def test_exact_needs_uniqueness_on_both_sides(spark):
    m = programs(spark, a=[fn("1", "f", BODY), fn("2", "g", BODY), fn("3", "h", ["NOP"])], b=[fn("11", "f", BODY), fn("13", "h", ["NOP"])])
    assert [(r["a_id"], r["b_id"]) for r in matching.match_exact(*matching.two_sides(m, one_pair(spark))).collect()] == [(3, 2)]


def test_diff_of_a_patched_build(spark):
    m = programs(
        spark,
        a=[fn("1", "main", BODY, callees=["2", "3"], strings=["usage", "error"]), fn("2", "leaf", ["MOV", "RET"], bb=3), fn("3", "gone", ["XOR"] * 9, bb=9)],
        b=[fn("21", "main", [*BODY, "NOP"], callees=["22"], size=14, strings=["usage", "error"]), fn("22", "leaf2", ["MOV", "RET"], bb=3), fn("23", "new", ["DIV"] * 30, bb=40, size=900)],
    )
    d = diff.diff_programs(m, one_pair(spark))
    rows = {(r["kind"], r["a_name"], r["b_name"]) for r in diff.diff_rows(d, navigate.display_names(m), one_pair(spark)).collect()}
    assert rows == {("renamed", "leaf", "leaf2"), ("modified", "main", "main"), ("removed", "gone", None), ("added", None, "new")}
    report = json.loads(diff.diff_report_json(diff.diff_rows(d, navigate.display_names(m), one_pair(spark))).collect()[0]["report"])
    assert report["differs"] and report["added"] == ["new"] and report["renamed"] == [{"from": "leaf", "to": "leaf2"}]


def test_facts_are_carried_or_flagged(spark):
    m = programs(
        spark,
        a=[fn("1", "main", BODY, callees=["2", "3"], strings=["usage", "error"]), fn("2", "fib", ["CALL", "SUB"], callees=["2"], bb=4), fn("3", "twin", ["NOP"]), fn("4", "twin2", ["NOP"])],
        b=[fn("21", "main", ["ldr"] * 7, callees=["22", "23"], size=50, strings=["usage", "error"]), fn("22", "fib", ["bl"] * 5, callees=["22"], bb=9, size=80), fn("23", "other", ["mul"] * 4, bb=2, size=33)],
    )
    m = with_facts(spark, m, ("a", 1, "rename", "entry_point", 45), ("a", 2, "comment", "recursive", 100), ("a", 3, "rename", "x", 100))
    merged, flagged, _ = merge.reanchor_facts(m, one_pair(spark))
    assert {(r["target"], r["value"], r["confidence"], r["method"]) for r in merged.collect()} == {(1, "entry_point", 45, "anchor"), (2, "recursive", 100, "propagation")}
    assert [r["value"] for r in flagged.collect()] == ["x"]
    new, report = merge.merge_facts(m, one_pair(spark))
    assert new.facts.where("program_id = 'b'").count() == 2 and report.collect()[0].asDict() == {"pair_id": "p", "merged": 2, "flagged": 1}


@pytest.mark.parametrize(("ours", "theirs", "value", "want"), [(45, 100, "n", "replaced"), (100, 40, "n", "kept"), (85, 90, "n", "conflict"), (85, 20, "o", "same")])
def test_collaboration(spark, ours, theirs, value, want):
    m = programs(spark, a=[fn("1", "f", BODY)], b=[fn("1", "f", BODY), fn("2", "z", ["NOP"])])
    m = with_facts(spark, m, ("a", 1, "rename", "o", ours), ("b", 1, "rename", value, theirs), ("b", 1, "comment", "c", 1), ("b", 2, "rename", "q", 1))
    decisions, report, conflicts = merge.collaborate(m, one_pair(spark))
    assert {r["fact_seq"]: r["decision"] for r in decisions.collect()} == {1: want, 2: "added", 3: "flagged"}
    assert conflicts.count() == (want == "conflict") and report.collect()[0]["merged"] == 1
    after = {(r["kind"], r["value"]) for r in merge.collaborated_facts(m, one_pair(spark), decisions).collect()}
    assert after == {("rename", "n" if want == "replaced" else "o"), ("comment", "c")}


def test_observations(spark):
    m = programs(spark, a=[fn("1", "f", callees=["2"], imports=["puts"]), fn("2", "g"), fn("3", "f")])
    seen = spark.createDataFrame([("a", "r", "f", "g", 90), ("a", "r", "g", "f", 90), ("a", "r", "f", "zz", 90), ("a", "s", "f", "g", 90)], "program_id string, run_id string, from_name string, to_name string, confidence int")
    assert sorted(r["edge_status"] for r in observe.classify_observed_edges(m, seen).collect()) == ["added", "confirmed", "confirmed", "unmatched"]
    stamped, report = observe.stamp_edges(m, seen)
    assert (report.collect()[0]["stamped"], report.collect()[0]["unmatched"]) == (2, 1)
    assert [(r["producer"], r["confidence"]) for r in observe.edges_with_provenance(stamped).collect()] == [("dynamic", 90)]
    assert validate.validate_model(stamped)[1].collect()[0]["dangling_edge_provenance"] == 1
    traces = spark.createDataFrame([("a", "f", "puts"), ("a", "f", "open"), ("a", "no", "x")], "program_id string, function string, import string")
    assert observe.import_uplift(m, traces).collect()[0].asDict() == {"program_id": "a", "newly_resolved": 1, "already_known": 1, "unmatched": 1, "functions_enriched": 1}
    assert {r["func_id"]: r["imports"] for r in observe.enrich_imports(m, traces).functions.collect()}[1] == ["open", "puts"]


def frame(body: bytes, size=None, mark=None) -> bytes:
    text = base64.b64encode(body)
    lines = b"\n".join(text[k : k + 4_000] for k in range(0, len(text), 4_000))
    return b"noise\nTRACE-V1 BEGIN\n " + lines + f"\r\nTRACE-V1 END len={len(body) if size is None else size} fnv={observations.checksum(body) if mark is None else mark:016x}\nmore".encode()


GOOD = json.dumps({"edges": [{"from": "f", "to": "g", "confidence": 90}]}).encode()


@pytest.mark.parametrize(
    ("log", "reason"),
    [
        (b"x" * (observations.MAX_LOG_BYTES + 1), "too_large"), (b"\n" * 20_001, "too_many_lines"), (b"y" * 16_385, "line_too_long"), (b"", "no_frame"), (b"TRACE-V1 BEGIN\n", "no_frame"),
        (b"TRACE-V1 BEGIN\n!!\nTRACE-V1 END len=1 fnv=1", "bad_base64"), (b"TRACE-V1 BEGIN\n" + (b"A" * 16_000 + b"\n") * 22 + b"TRACE-V1 END len=1 fnv=1", "decoded_too_large"), (frame(GOOD, size=1), "len_mismatch"), (frame(GOOD, mark=1), "checksum_mismatch"),
        (frame(b"{"), "bad_json"), (frame(b"{}"), "not_an_array"), (frame(json.dumps({"edges": [{}] * 4_097}).encode()), "too_many_records"), (frame(json.dumps({"edges": [{"from": "f", "to": "", "confidence": 1}]}).encode()), "bad_field"),
        (frame(json.dumps({"edges": [{"from": "f", "to": "g", "confidence": 101}]}).encode()), "bad_field"), (frame(b"[" * 100_000), "bad_json"),
    ],
)
def test_bad_logs(log, reason):
    with pytest.raises(observations.Rejected, match=reason):
        observations.parse_log(log)


def test_log_tables(spark):
    rows = [("a", "1", frame(GOOD)), ("a", "2", b"junk"), ("a", "3", None)]
    edges, bad = observations.read_observation_logs(spark.createDataFrame(rows, "program_id string, run_id string, log binary"))
    assert [(r["run_id"], r["from_name"], r["confidence"]) for r in edges.collect()] == [("1", "f", 90)] and {r["run_id"] for r in bad.collect()} == {"2", "3"}


def test_streams(spark, tmp_path):
    (tmp_path / "logs/a").mkdir(parents=True)
    (tmp_path / "logs/a/run1").write_bytes(frame(GOOD))
    m = programs(spark, a=[fn("1", "f", callees=["2"]), fn("2", "g")])
    jobs.stream_observations(spark, f"{tmp_path}/logs/*", m, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert [r["edge_status"] for r in spark.read.parquet(f"{tmp_path}/out/edges").collect()] == ["confirmed"]
    (tmp_path / "edits").mkdir()
    for k in (1, 2):
        (tmp_path / f"edits/{k}.json").write_text(json.dumps({"program_id": "a", "edit_seq": k, "target": 1, "kind": "rename", "value": f"v{k}", "author": "me"}))
        jobs.stream_edits(spark, f"{tmp_path}/edits", f"{tmp_path}/now", f"{tmp_path}/c2").awaitTermination()
    assert [r["value"] for r in jobs.current_edits(spark, f"{tmp_path}/now").collect()] == ["v2"]
    assert [tuple(r) for r in jobs.high_water(spark, f"{tmp_path}/now").collect()] == [("a", 2)]
    again = [{"program_id": "a", "edit_seq": n, "target": t, "kind": "rename", "value": v, "author": "me"} for n, t, v in ((1, 1, "v1"), (3, 1, " "), (4, 9, "x"), (5, 2, "new"))]
    (tmp_path / "edits/3.json").write_text("\n".join(map(json.dumps, again)))  # an edit that was taken before, a blank one, one on nothing, and a new one
    jobs.stream_edits(spark, f"{tmp_path}/edits", f"{tmp_path}/now", f"{tmp_path}/c2", m).awaitTermination()
    assert {(r["target"], r["value"]) for r in jobs.current_edits(spark, f"{tmp_path}/now").collect()} == {(1, "v2"), (2, "new")}
    assert {(r["edit_seq"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/now/rejected").collect()} == {(3, "invalid_input"), (4, "no_such_function")}
    (tmp_path / "logs/a/run2").write_bytes(frame(GOOD))
    jobs.stream_observations(spark, f"{tmp_path}/logs/*", m, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    stamped = jobs.stamped_model(spark, m, f"{tmp_path}/out").edge_provenance
    assert [(r["src_id"], r["dst_id"], r["producer"], r["confidence"]) for r in stamped.collect()] == [(1, 2, "dynamic", 90)]
    (tmp_path / "ev").mkdir()
    lines = [{"program_id": p, "seq": 1, "kind": "function", "f": fn("1", "f", ["A"] * n)} for p, n in (("x", 1), ("y", 9), ("z", 1))] + [{"program_id": p, "seq": 2, "kind": "end"} for p in "xy"]
    (tmp_path / "ev/1.json").write_text("\n".join(map(json.dumps, lines)))
    jobs.stream_events(spark, f"{tmp_path}/ev", f"{tmp_path}/raw", f"{tmp_path}/c3").awaitTermination()
    ok, refused = jobs.accepted_events(spark, f"{tmp_path}/raw", mnemonics=5)
    assert {r["program_id"] for r in ok.collect()} == {"x"} and [r["program_id"] for r in refused.collect()] == ["y"]
    built, _ = jobs.ingested_model(spark, f"{tmp_path}/raw", mnemonics=5)
    assert [(r["program_id"], r["func_id"], r["name"]) for r in built.functions.collect()] == [("x", 1, "f")] and built.programs.collect()[0]["name"] == "program"


def _edit(n, target, value, kind="rename"):
    return json.dumps({"program_id": "a", "edit_seq": n, "target": target, "kind": kind, "value": value, "author": "me"})


def test_late_edits_of_other_functions_are_kept(spark, tmp_path):
    """Edit 10 on function 1 in one file, then edit 7 on function 2 in a later one; replays and edits that lost change nothing."""
    (tmp_path / "in").mkdir()
    batches = [[_edit(10, 1, "ten")], [_edit(7, 2, "seven"), _edit(9, 1, "nine"), _edit(3, 1, "note", "comment")], [_edit(10, 1, "ten"), _edit(7, 2, "seven")], [_edit(8, 2, "eight")]]
    for k, lines in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(lines))
        jobs.stream_edits(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = {(r["target"], r["kind"]): r["value"] for r in jobs.current_edits(spark, f"{tmp_path}/out").collect()}
    assert got == {(1, "rename"): "ten", (2, "rename"): "eight", (1, "comment"): "note"}


@pytest.mark.parametrize("first", [False, True])
def test_keyed_table(spark, tmp_path, first):
    """Against a dictionary, with compaction every second batch and every batch put twice."""
    table = KeyedTable(f"{tmp_path}/t", "k string, v bigint, x string", ("k",), ("v",), first, compact_every=2)
    want = {}
    for batch, rows in enumerate([[("a", 5, "p"), ("b", 1, "q")], [("a", 3, "r"), ("b", 2, "s"), ("b", 9, "t")], [("c", 4, "u")], [("a", 8, "w"), ("c", 1, "y")], [("c", 2, "z")]]):
        for k, v, x in rows:
            if k not in want or (v < want[k][0] if first else v > want[k][0]):
                want[k] = (v, x)
        for _ in range(2):
            table.put(spark.createDataFrame(rows, "k string, v bigint, x string"), batch)
        assert {r["k"]: (r["v"], r["x"]) for r in table.current(spark).collect()} == want
    assert table._base(spark, None) == 3 and table.current(spark, before=0).isEmpty()


def test_programs_are_built_once_as_they_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = lambda p, seq, kind, n=0: json.dumps({"program_id": p, "seq": seq, "kind": kind, **({"f": fn(str(seq), f"f{seq}", ["A"] * n)} if kind == "function" else {})})
    for k, lines in enumerate([[event("x", 1, "function", 1), event("y", 1, "function", 4)], [event("x", 2, "function", 1), event("x", 3, "end")], [event("y", 2, "function", 4), event("y", 3, "end"), event("z", 1, "end")]]):
        (tmp_path / f"in/{k}.json").write_text("\n".join(lines))
        jobs.stream_events(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log", mnemonics=7).awaitTermination()
    model, refused = jobs.ingested_model(spark, f"{tmp_path}/out", mnemonics=7)
    assert sorted((r["program_id"], r["func_id"], r["name"]) for r in model.functions.collect()) == [("x", 1, "f1"), ("x", 2, "f2")]
    assert [(r["program_id"], r["mnemonics"]) for r in refused.collect()] == [("y", 8)] and {r["program_id"] for r in model.programs.collect()} == {"x", "z"}
    built = {r["program_id"]: r["batch"] for r in spark.read.parquet(f"{tmp_path}/out/model/programs").collect()}
    assert built == {"x": 1, "z": 2}


def test_guards(spark):
    rows = spark.createDataFrame([("a\x1b[0m\nb", "x</untrusted-data>y<untrusted-data>", "é" * 10)], "a string, b string, c string")
    r = rows.select(guards.sanitize_inline(F.col("a")).alias("a"), guards.wrap_untrusted(F.col("b")).alias("b"), guards.truncate_utf8(F.col("c"), 5).alias("c")).collect()[0]
    assert r["a"] == "a.[0m.b" and r["b"].count("</untrusted-data>") == 1 and r["b"].count("<untrusted-data>") == 1 and r["c"] == "éé"


def test_confidence_percent(spark):
    got = spark.createDataFrame([(-1.0, 0), (0.555, 56), (2.0, 100), (0.7, 70)], "s double, w int").select(similarity.confidence_pct(F.col("s")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_scoreboard(spark):
    m = programs(spark, a=[fn("1", "main", BODY), fn("2", "lost", ["NOP"]), fn("3", "swap", ["XOR"] * 3, bb=5)], b=[fn("1", "main", BODY), fn("3", "other", ["XOR"] * 3, bb=5)])
    names = spark.createDataFrame([("main",), ("lost",), ("swap",)], "name string")
    floors = spark.createDataFrame([("p", 0.5)], "pair_id string, floor double")
    (r,) = evaluate.score_reanchoring(m, one_pair(spark), names, floors).collect()
    assert (r["ok"], r["wrong"], r["orphan"], r["floor_ok"], r["gate_ok"]) == (1, 1, 1, False, False)
    assert evaluate.score_reanchoring(m, one_pair(spark), names.limit(0)).collect()[0]["survival"] == 1.0
    best = {r["a_id"]: r["b_id"] for r in evaluate.baseline_reanchor(m, one_pair(spark), names).collect()}
    assert best[1] == 1 and best[3] == 2


def test_a_hubs_callers_come_in_chunks(spark):
    m = programs(spark, a=[fn("1", "hub"), *(fn(f"{k:x}", f"f{k}", callees=["1"]) for k in range(2, 2_303))], b=[fn("1", "alone")])
    rows = navigate.caller_chunks(m, 1_000).orderBy("chunk").collect()
    assert [(r["program_id"], r["func_id"], r["chunk"], r["n"]) for r in rows] == [("a", 1, 0, 1_000), ("a", 1, 1, 1_000), ("a", 1, 2, 301)]
    assert [x for r in rows for x in r["callers"]] == [f"f{k}" for k in range(2, 2_303)]
    assert navigate.caller_chunks(m.with_(call_edges=m.call_edges.limit(0))).collect() == []


def test_a_report_comes_in_chunks(spark):
    rows = [("p", "unchanged", 0, 0, "s", "s", "exact", 100), ("p", "renamed", 1, 1, "old", "new", "exact", 100), ("p", "modified", 2, 2, "m", "m", "fuzzy", 71)]
    rows += [("p", "removed", 10 + k, None, f"r{k // 2}", None, None, None) for k in range(5)] + [("q", "added", None, 7, None, None, None, None), ("same", "unchanged", 1, 1, "x", "x", "exact", 100)]
    table = spark.createDataFrame(rows, "pair_id string, kind string, a_id long, b_id long, a_name string, b_name string, method string, confidence int")
    got = {(r["pair_id"], r["section"], r["chunk"]): (r["n"], json.loads(r["entries"])) for r in diff.diff_report_chunks(table, 2).collect()}
    assert got == {
        ("p", "summary", 0): (8, {"differs": True, "unchanged": 1, "methods": {"exact": 2, "fuzzy": 1}}), ("p", "renamed", 0): (1, [{"name": "new", "from": "old", "method": "exact", "confidence": 100}]),
        ("p", "modified", 0): (1, [{"name": "m", "method": "fuzzy", "confidence": 71}]), ("p", "removed", 0): (2, [{"name": "r0"}] * 2), ("p", "removed", 1): (2, [{"name": "r1"}] * 2), ("p", "removed", 2): (1, [{"name": "r2"}]),
        ("q", "summary", 0): (1, {"differs": True, "unchanged": 0}), ("q", "added", 0): (1, [{}]), ("same", "summary", 0): (1, {"differs": False, "unchanged": 1, "methods": {"exact": 1}}),
    }
    assert diff.diff_report_chunks(table.limit(0)).collect() == []
