"""The joins and the ladder against plain versions: all pairs, all rounds from scratch."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinbuild.functions import features, similarity
from twinbuild.operators import diff, evaluate, matching, merge, navigate
from twinbuild.plans.model import Model, empty
from twinbuild.plans.store import stored

EDGE = "pair_id string, src_id bigint, dst_id bigint"
ID = "pair_id string, func_id bigint"
MATCH = "pair_id string, a_id bigint, b_id bigint, method string, score double"


def all_pairs_agreement(targets, edges_a, edges_b, matched):
    """One round of scored propagation by comparing every target with every function."""
    image = dict(matched)

    def tokens(edges, name):
        out = {}
        for s, d in set(edges):
            out.setdefault(s, set()).add((0, name(d)))
            out.setdefault(d, set()).add((1, name(s)))
        return {k: {t for t in v if t[1] is not None} for k, v in out.items()}

    ta, tb = tokens(edges_a, image.get), tokens(edges_b, lambda x: x)
    loops_a, loops_b = ({s for s, d in e if s == d} for e in (edges_a, edges_b))
    score = lambda a, b: (n := len(ta.get(a, set()) & tb.get(b, set()))) and n + 2 * (a in loops_a and b in loops_b)

    def best(scores):
        ranked = sorted(((s, x) for x, s in scores.items() if s), reverse=True)
        return ranked[0][1] if ranked and ranked[0][0] >= 2 and (len(ranked) == 1 or ranked[0][0] - ranked[1][0] >= 1) else None

    taken, out = set(image.values()), set()
    for a in set(targets) - set(image):
        b = best({x: score(a, x) for x in tb if x not in taken})
        if b is not None and best({x: score(x, b) for x in ta}) == a:
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_scored_propagation_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges_a = [(rng.randrange(n), rng.randrange(n) if rng.random() < 0.7 else 0) for _ in range(150)] + [(k, k) for k in range(0, n, 7)]
    edges_b = [(s + 100, d + 100) for s, d in edges_a if rng.random() < 0.85] + [(rng.randrange(n) + 100, rng.randrange(n) + 100) for _ in range(10)]
    matched = [(k, k + 100) for k in range(n) if rng.random() < 0.5]
    frame = lambda rows, ddl: spark.createDataFrame([("p", *r) for r in rows], ddl)
    matches = frame([(a, b, "exact", 1.0) for a, b in matched], MATCH)
    got = merge.propagate_scored(frame([(k,) for k in range(n)], ID), frame(edges_a, EDGE), frame(edges_b, EDGE), matches).collect()
    want = all_pairs_agreement(range(n), edges_a, edges_b, matched)
    assert {(r["a_id"], r["b_id"]) for r in got} == want and (seed or want)


def test_a_hub_makes_no_pairs_of_its_callers(spark):
    """100,000 functions call one hub and a helper of their own: each meets its own image only."""
    n, hub = 100_000, 10_000_000
    callers = spark.range(n).select(F.lit("p").alias("pair_id"), F.col("id").alias("func_id"))
    tokens = callers.withColumns({"d": F.lit(0), "n": F.lit(hub)}).unionByName(callers.withColumns({"d": F.lit(0), "n": F.col("func_id") + 20_000_000}))
    none = spark.createDataFrame([], ID)
    met = stored(merge.agreeing_candidates(tokens.withColumn("n", F.col("n").cast("long")), tokens.withColumn("n", F.col("n").cast("long")), none, none), "met")
    assert met.count() == n and met.where("func_id <> candidate").isEmpty()


def functions_of(rng, n, first, letters="abcde"):
    """Random functions of very different sizes; some alike, some empty."""
    rows = []
    for k in range(n):
        size = rng.choice([0, 1, 2, 3, 8, 30, 200])
        pool = letters[: rng.choice([2, 5])] if size < 30 else [f"m{i}" for i in range(40)]
        rows.append(("p", first + k, [rng.choice(pool) for _ in range(size)], max(1, size // rng.choice([3, 9])), rng.randrange(6)))
    return rows + [("p", first + n + k, *rows[k][2:]) for k in range(3)]


def side_of(spark, rows):
    df = spark.createDataFrame(rows, "pair_id string, func_id bigint, ordered array<string>, bb_count bigint, out_degree int")
    return stored(features.with_counts(df).drop("ordered"), "side")


def test_counts_of_lists(spark):
    lists = [["b", "a", "b"], [], None, ["x"], ["é", "b", "a", "b", "a", "b"], ["a b", "c", "d"], ["a", "b c", "d"]]
    rows = features.with_counts(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ordered array<string>").coalesce(1)).orderBy("k").collect()
    for r, x in zip(rows, lists, strict=True):
        x = x or []
        windows = [" ".join(x[k : k + 3]) for k in range(len(x) - 2)]
        for got, items in ((r["mnemonics"], x), (r["trigrams"], windows)):
            assert [tuple(e) for e in got] == sorted((w, items.count(w)) for w in set(items))


@pytest.mark.parametrize("block", [3, 1000])
def test_fuzzy_scores_with_ranges_equal_all_pairs(spark, block):
    rng = random.Random(block)
    a, b = (side_of(spark, functions_of(rng, 40, first)) for first in (0, 1000))
    columns = F.struct("mnemonics", "trigrams", "bb_count", "out_degree")
    pairs = a.select("pair_id", F.col("func_id").alias("a_id"), columns.alias("x")).join(b.select("pair_id", F.col("func_id").alias("b_id"), columns.alias("y")), "pair_id")
    want = {(r["a_id"], r["b_id"]): round(r["s"], 9) for r in pairs.select("a_id", "b_id", similarity.similarity("x", "y").alias("s")).where("s >= 0.5 - 1e-9").collect()}
    got = {(r["a_id"], r["b_id"]): round(r["score"], 9) for r in matching.fuzzy_scores(a, b, block=block).collect()}
    assert got == want
    meets = [r["meets"] for r in matching.range_pairs(matching._with_range(a), matching._with_range(b), 0.5, block).collect()]
    assert not all(meets) and any(meets)


def test_bounds_hold_for_every_pair(spark):
    rng = random.Random(5)
    a, b = (matching._with_range(side_of(spark, functions_of(rng, 40, first))) for first in (0, 1000))
    bound = {(r["range_x"], r["range_y"]): r["bound"] for r in matching.range_pairs(a, b, 0.5, 10).withColumn("bound", matching.range_bound()).collect()}
    columns = F.struct("mnemonics", "trigrams", "bb_count", "out_degree")
    rows = a.select("pair_id", F.col("range").alias("i"), columns.alias("x")).join(b.select("pair_id", F.col("range").alias("j"), columns.alias("y")), "pair_id")
    assert all(r["s"] <= bound[r["i"], r["j"]] + 1e-9 for r in rows.select("i", "j", similarity.similarity("x", "y").alias("s")).collect())


def ladder_from_scratch(model, pairs):
    """All rungs over all leftovers in every round."""
    a, b, pairs = matching.stored_sides(model, pairs)
    edges_a, edges_b = (stored(matching.edges_of(model, pairs, p), "edges") for p in ("prog_a", "prog_b"))
    matches, found = stored(matching.match_exact(a, b), "matches"), True
    while found:
        found = False
        for rung in ("propagation", "anchor", "bsim", "fuzzy"):
            left_a, left_b = matching.left_over(a, matches, "a_id"), matching.left_over(b, matches, "b_id")
            new = matching.propagate_round(left_a, left_b, edges_a, edges_b, matches) if rung == "propagation" else matching.feature_round(left_a, left_b, rung)
            new = stored(new, "new")
            if not new.isEmpty():
                found, matches = True, stored(matches.unionByName(new), "matches")
    return {(r["pair_id"], r["a_id"], r["b_id"], r["method"]) for r in matches.collect()}


def random_model(spark, rng, n=50):
    """A program and a copy of it in which bodies are cut and calls are lost, and many functions look alike."""
    old = functions_of(rng, n, 0, "abcdefgh")
    new = []
    for _, k, body, blocks, degree in old:
        if rng.random() < 0.9:
            body = [t for t in body if rng.random() > 0.15] if rng.random() < 0.7 else body
            new.append(("p", k + 1000, body, blocks + rng.randrange(2), degree))
    calls = [(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)]
    kept = {k - 1000 for _, k, *_ in new}
    calls_b = [(s + 1000, d + 1000) for s, d in calls if s in kept and d in kept and rng.random() < 0.95]
    tables = []
    for name, rows in (("A", old), ("B", new)):
        df = side_of(spark, rows).drop("pair_id")
        words = F.when(F.col("func_id") % 3 == 0, F.array(F.concat(F.lit("s"), (F.col("func_id") % 1000 % 20).cast("string")), F.lit("usage"))).otherwise(F.array().cast("array<string>"))
        tables.append(df.select(
            F.lit(name).alias("program_id"), "func_id", F.col("func_id").alias("func_seq"), F.col("func_id").cast("decimal(20,0)").alias("addr"), F.concat(F.lit("f"), "func_id").alias("name"), F.size("trigrams").cast("bigint").alias("size"),
            "bb_count", "out_degree", F.xxhash64("mnemonics").alias("fingerprint"), "mnemonics", "trigrams", words.alias("string_refs"), F.array().cast("array<string>").alias("imports"), F.array().cast("array<string>").alias("callee_names"),
            F.array().cast("array<struct<hash:bigint,weight_bits:bigint>>").alias("bsim_vector"),
        ))
    edges = spark.createDataFrame([("A", s, d, k) for k, (s, d) in enumerate(calls)] + [("B", s, d, k) for k, (s, d) in enumerate(calls_b)], "program_id string, src_id bigint, dst_id bigint, edge_seq bigint")
    programs = spark.createDataFrame([("A", "A", "x"), ("B", "B", "x")], "program_id string, name string, language string")
    return Model(programs, tables[0].unionByName(tables[1]), stored(edges, "edges"), empty(spark, "facts"), empty(spark, "edge_provenance"))


@pytest.mark.parametrize("best", [1, 16])
def test_semi_naive_ladder_equals_rounds_from_scratch(spark, monkeypatch, best):
    """With lists cut at one row nearly every function runs out and is scored again."""
    model = random_model(spark, random.Random(4))
    pairs = spark.createDataFrame([("p", "A", "B")], "pair_id string, prog_a string, prog_b string")
    start = matching.Rung.__init__
    monkeypatch.setattr(matching.Rung, "__init__", lambda self, kind, a, b: start(self, kind, a, b, best))
    found = diff.diff_programs(model, pairs)
    assert {(r["pair_id"], r["a_id"], r["b_id"], r["method"]) for r in found.matches.collect()} == ladder_from_scratch(model, pairs)
    again = sum(n for rounds, kind, n, _ in found.work if kind == "fuzzy" and rounds > 1)
    assert again == 0 if best == 16 else again > 0


def test_baseline_takes_the_best_of_all(spark, monkeypatch):
    model = random_model(spark, random.Random(6))
    pairs = spark.createDataFrame([("p", "A", "B")], "pair_id string, prog_a string, prog_b string")
    names = model.functions.where("program_id = 'A'").select("name")
    base = features.with_baseline_features(model.functions, model.call_edges)
    columns = F.struct("mnemonics", "trigram_set", "bb_count", "out_degree", "in_degree")
    x, y = (base.where(f"program_id = '{p}'").select("func_id", columns.alias(c)) for p, c in (("A", "x"), ("B", "y")))
    rows = x.withColumnRenamed("func_id", "a").withColumn("k", F.lit(1)).join(y.withColumnRenamed("func_id", "b").withColumn("k", F.lit(1)), "k").select("a", "b", F.round(similarity.baseline_similarity("x", "y"), 9).alias("s")).collect()
    want = {}
    for r in rows:
        if r["s"] >= 0.55 and (r["a"] not in want or (-r["s"], r["b"]) < want[r["a"]]):
            want[r["a"]] = (-r["s"], r["b"])
    for block in (7, 1000):
        got = {r["a_id"]: (-round(r["score"], 9), r["b_id"]) for r in evaluate.baseline_reanchor(model, pairs, names, block=block).collect()}
        assert got == want


def test_bit_maps():
    rng = np.random.default_rng(0)
    sets = [[sorted(set(rng.integers(0, 150, rng.integers(0, 40)).tolist())) for _ in range(9)] for _ in range(2)]
    lists = [pa.array([[str(v) for v in s] for s in side], pa.list_(pa.string())) for side in sets]
    (x, y), (n, m) = evaluate._bit_maps(*lists)
    assert n.tolist() == [len(s) for s in sets[0]] and m.tolist() == [len(s) for s in sets[1]]
    for i, s in enumerate(sets[0]):
        assert np.bitwise_count(y & x[i]).sum(1).tolist() == [len(set(s) & set(t)) for t in sets[1]]


def test_best_two_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = lambda first: [("p", first + k, None if k == 7 else [(int(h), float(w)) for h, w in zip(rng.permutation(9)[:4], rng.integers(0, 3, 4), strict=True)]) for k in range(40)]
    a, b = (spark.createDataFrame(rows(first), "pair_id string, func_id bigint, vector array<struct<hash:bigint,weight:double>>") for first in (0, 1000))
    pairs = a.where("vector is not null").select(F.col("func_id").alias("a"), F.col("vector").alias("x")).join(b.where("vector is not null").select(F.col("func_id").alias("b"), F.col("vector").alias("y")), F.lit(True))
    scores = {(r["a"], r["b"]): r["s"] for r in pairs.select("a", "b", F.round(similarity.vector_cosine(F.col("x"), F.col("y")), 9).alias("s")).collect() if r["s"] > 0}
    best = lambda k: {i: sorted((-s, p[1 - k]) for p, s in scores.items() if p[k] == i) for i in {p[k] for p in scores}}
    rows_a, rows_b = best(0), best(1)
    want = {i: (x[0][1], -x[0][0], rows_b[x[0][1]][0][1] == i) for i, x in rows_a.items()}
    clear = lambda x: len(x) == 1 or x[1][0] - x[0][0] >= similarity.VECTOR_MARGIN
    gated = {i for i, x in rows_a.items() if -x[0][0] >= similarity.VECTOR_THRESHOLD and clear(x) and clear(rows_b[x[0][1]]) and rows_b[x[0][1]][0][1] == i}
    for block in (6, 1000):
        got = evaluate.similarity_matrix(a, b, block).collect()
        assert {r["a_id"]: (r["b_id"], round(r["score"], 9), r["mutual"]) for r in got} == want
        assert {r["a_id"] for r in got if r["outcome"] == "matched"} == gated


def test_places_in_a_large_program(spark):
    """One program with most of the rows, spread over partitions; places are those of a sort."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).otherwise("big").alias("g"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = navigate.numbered(rows, "g", ("v",), "place")
    by = {}
    for r in got.collect():
        by.setdefault(r["g"], []).append((r["place"], r["v"]))
    assert all([p for p, _ in sorted(x)] == list(range(len(x))) and sorted(x) == sorted(x, key=lambda e: e[1]) for x in by.values()) and len(by["big"]) == 18_000
    assert navigate.numbered(rows.limit(0), "g", ("v",), "place").collect() == []


def peeled(n, edges):
    """Depths by taking off, level by level, what no remaining function calls."""
    callers = {v: {s for s, d in edges if d == v and s != v} for v in range(n)}
    depth, left, level = {}, set(range(n)), 0
    while free := {v for v in left if not callers[v] & left}:
        depth |= dict.fromkeys(free, level)
        left -= free
        level += 1
    return {v: (depth.get(v), v in left) for v in range(n)}


def graph(spark, graphs):
    """A model with one program for each list of calls."""
    functions = spark.createDataFrame([(p, k) for p, (n, _) in graphs.items() for k in range(n)], "program_id string, func_id bigint")
    edges = spark.createDataFrame([(p, s, d, 0) for p, (_, calls) in graphs.items() for s, d in calls], "program_id string, src_id bigint, dst_id bigint, edge_seq bigint")
    return Model(None, functions, edges, None, None)


def test_depths_equal_peeling(spark):
    rng = random.Random(9)
    graphs = {"ring": (4, [(0, 1), (1, 2), (2, 0), (2, 3)]), "two": (3, [(0, 1), (0, 2), (1, 2)]), "alone": (2, [(0, 0)]), "tail": (5, [(0, 1), (1, 0), (1, 2), (2, 3), (4, 3)])}
    for k in range(25):
        n = rng.randrange(2, 14)
        calls = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))]
        graphs[f"g{k}"] = (n, [(min(e), max(e)) for e in calls] if k % 2 else calls)
    got = {}
    for r in navigate.call_depth(graph(spark, graphs)).collect():
        got.setdefault(r["program_id"], {})[r["func_id"]] = (r["depth"], r["cyclic"])
    assert got == {p: peeled(n, calls) for p, (n, calls) in graphs.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 100_000, []
    monkeypatch.setattr(navigate, "stored", lambda df, name: written.append(name) or stored(df, name))
    ids = spark.range(n).select(F.lit("p").alias("program_id"), F.col("id").alias("func_id"))
    calls = ids.where(F.col("func_id") < n - 1).select("program_id", F.col("func_id").alias("src_id"), (F.col("func_id") + 1).alias("dst_id"), F.lit(0).cast("long").alias("edge_seq"))
    rows = navigate.call_depth(Model(None, ids, calls, None, None))
    assert rows.where("depth = func_id and not cyclic").count() == n and len(written) < 40
