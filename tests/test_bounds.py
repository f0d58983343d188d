"""What moves, what is written and what is held at once stays bounded, and gives the same rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from twinbuild.functions import features, similarity
from twinbuild.operators import matching, merge
from twinbuild.plans import store
from twinbuild.sources import observations, tables


def test_packed_lists_score_as_lists_do(spark):
    rng = random.Random(2)
    lists = [[], ["a", "a", "a", "a"], ["x" * 40, "é", "b", "b c"], ["m"] * 300, *[[rng.choice("abcdefg") for _ in range(rng.randrange(30))] for _ in range(40)]]
    rows = features.with_counts(spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ordered array<string>"))
    rows = rows.withColumns({"pm": features.packed("mnemonics"), "pg": features.packed("trigrams"), "ps": features.packed_trigram_set("trigrams", "mnemonics"), "set": features.trigram_set()})
    both = rows.select(*(F.col(c).alias(f"x_{c}") for c in rows.columns)).crossJoin(rows.select(*(F.col(c).alias(f"y_{c}") for c in rows.columns)))
    got = both.select(
        *(F.struct(similarity.cosine(F.col(f"x_{c}"), F.col(f"y_{c}")).alias("want"), features.packed_cosine(f"x_{p}", f"y_{p}").alias("got")).alias(c) for c, p in (("mnemonics", "pm"), ("trigrams", "pg"))),
        F.struct(similarity.jaccard(F.col("x_set"), F.col("y_set"), 1.0).alias("want"), features.packed_jaccard("x_ps", "y_ps").alias("got")).alias("set"),
    ).collect()
    assert all(r[c]["want"] == r[c]["got"] for r in got for c in ("mnemonics", "trigrams", "set")) and len(got) == len(lists) ** 2


def test_lists_of_a_build_do_not_move(spark, sf_dir):
    """Texts meet ids and calls before they are taken apart: nothing is joined or dealt out after that."""
    plan = matching.two_sides(tables.build_a(spark, sf_dir), tables.pairs(tables.build_a(spark, sf_dir)), ("func_id", "mnemonics", "trigrams", "out_degree"))[0]
    lines = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    first = next(k for k, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[:first]) and any("Exchange hashpartitioning" in line for line in lines[first:])


def test_shuffles_end_with_the_table_they_were_made_for(spark):
    rows = spark.range(1_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    assert store.stored(rows, "counts").count() == 7
    assert spark.conf.get(store.SHUFFLES_END) == "true"


def test_released_tables_are_gone(spark):
    kept, gone = store.stored(spark.range(5), "kept"), store.stored(spark.range(5), "gone")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone.inputFiles()[0].rpartition("/")[0])
    store.released(gone)
    assert kept.count() == 5 and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def side(spark, n, first):
    rng = random.Random(first)
    rows = [("p", first + k, [rng.choice("abcde") for _ in range(rng.choice([3, 20, 60]))], 4, 2) for k in range(n)]
    df = spark.createDataFrame(rows, "pair_id string, func_id bigint, ordered array<string>, bb_count bigint, out_degree int")
    return store.stored(features.with_counts(df).drop("ordered"), "side")


def test_a_fuzzy_round_keeps_the_best_and_goes_class_by_class(spark, monkeypatch):
    """All of these are alike enough: only the two best of each are written, and each class of one side is dealt out for itself."""
    n, names = 120, []
    monkeypatch.setattr(matching, "stored", lambda df, name: names.append(name) or store.stored(df, name))
    a, b = side(spark, n, 0), side(spark, n, 1_000)
    every = matching.fuzzy_scores(a, b, block=20)
    whole = every.count()
    rounds = names.count("fuzzy-blocks")
    two = matching.leaders("fuzzy", a, b)
    assert rounds > 1 and whole > n * n / 2 and two.count() <= 3 * 2 * 2 * n
    best = lambda table: {(r["a_id"], r["b_id"]) for r in similarity.reciprocal(table, 0.55, 0.001).collect()}
    assert best(two) == best(every)


def test_dense_vectors_meet_by_matrix_product(spark):
    rng = np.random.default_rng(1)
    a, b = (spark.createDataFrame([("p", first + k, [(h, float(w)) for h, w in enumerate(rng.random(12) ** 6)]) for k in range(60)], "pair_id string, func_id bigint, vector array<struct<hash:bigint,weight:double>>") for first in (0, 1000))
    assert matching.vectors_are_dense(a, b)
    apart = lambda df: df.withColumn("vector", F.transform("vector", lambda e: F.struct((e["hash"] + 100 * (F.col("func_id") % 1000)).alias("hash"), e["weight"].alias("weight"))))
    assert not matching.vectors_are_dense(apart(a), apart(b))
    best = lambda table: {(r["a_id"], r["b_id"], r["score"]) for r in similarity.reciprocal(table, 0.7, 0.01).collect()}
    assert best(matching.leaders("bsim", a, b)) == best(matching.vector_scores(a, b)) != set()


def test_logs_are_read_once(spark):
    """Logs may be large and costly to make: the calls and the refusals come from one pass over them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    logs = spark.range(10).select(F.lit("p").alias("program_id"), F.col("id").cast("string").alias("run_id"), F.encode(F.lit("noise"), "UTF-8").alias("log"))
    edges, rejected = observations.read_observation_logs(logs.mapInPandas(counted, logs.schema))
    assert edges.count() == 0 and rejected.count() == 10 and seen.value == 10


def test_a_merge_rung_with_short_lists_chooses_the_same(spark, monkeypatch):
    """Lists of one score run out where an earlier target took the best; then they are made again, longer."""
    bodies = [["a"] * 9 + ["b"] * k for k in (1, 1, 4, 8)]
    ddl = "pair_id string, func_id bigint, ordered array<string>, bb_count bigint, out_degree int"
    a, b = (store.stored(features.with_counts(spark.createDataFrame([("p", first + k, x, 4 + 9 * k, 2) for k, x in enumerate(bodies)], ddl)).drop("ordered"), "side") for first in (0, 1_000))
    targets = a.select("pair_id", "func_id", F.col("func_id").alias("place"))
    none = spark.createDataFrame([], merge.NO_MATCH)
    written = []
    monkeypatch.setattr(merge, "stored", lambda df, name: written.append((name, t := store.stored(df, name))) or t)
    rows = lambda best: {(r["a_id"], r["b_id"]) for r in merge._rung("fuzzy", targets, a, b, none, best=best).collect()}
    short = rows(1)
    assert all(t.count() <= 5 * 2 * len(bodies) for name, t in written if name == "fuzzy-forward") and short == rows(64) != set()
