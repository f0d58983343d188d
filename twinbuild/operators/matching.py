"""Matching the functions of two builds: exact signatures, call-graph propagation, and feature rungs.

Every rung takes `sides`: the functions of a pair's two programs (see `two_sides`), and gives rows
(pair_id, a_id, b_id, method, score). Whatever is ambiguous stays unmatched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbuild.functions import similarity as S
from twinbuild.functions.features import SIGNATURE, anchor_set, packed, squared_norm, unpack
from twinbuild.operators.vectors import SCORES, best_vector_pairs
from twinbuild.plans.model import Model
from twinbuild.plans.store import stored, stored_together

WANTED = ("func_id", "func_seq", "name", *SIGNATURE, "mnemonics", "trigrams", "anchors", "vector")


def with_vector(functions: DataFrame) -> DataFrame:
    """A `vector` of (hash, weight) where functions has stored bits."""
    from twinbuild.functions.features import vector_weights

    return functions if "vector" in functions.columns else functions.withColumn("vector", vector_weights(F.col("bsim_vector")))


def side_of(model: Model, pairs: DataFrame, program: str, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """The functions of the pairs' program (prog_a or prog_b) with their pair_id and the wanted columns."""
    functions = with_vector(model.functions) if "vector" in wanted else model.functions
    functions = functions.withColumn("anchors", anchor_set()) if "anchors" in wanted and "anchors" not in functions.columns else functions
    p = F.broadcast(pairs.select("pair_id", F.col(program).alias("program_id")))  # a row a program: functions stay where they are
    return functions.join(p, "program_id").select("pair_id", *wanted)


def two_sides(model: Model, pairs: DataFrame, wanted: tuple[str, ...] = WANTED) -> tuple[DataFrame, DataFrame]:
    """The functions of prog_a and of prog_b with their pair_id and the wanted columns."""
    return side_of(model, pairs, "prog_a", wanted), side_of(model, pairs, "prog_b", wanted)


def stored_sides(model: Model, pairs: DataFrame, wanted: tuple[str, ...] = WANTED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides and the pairs; functions of either side are made and stored once."""
    pairs = stored(pairs, "pairs")
    programs = pairs.select(F.explode(F.array("prog_a", "prog_b")).alias("program_id")).distinct()
    functions = with_vector(model.functions).join(programs, "program_id", "left_semi").withColumn("anchors", anchor_set())
    a, b = two_sides(model.with_(functions=stored(functions.select("program_id", *wanted), "functions")), pairs, wanted)
    return a, b, pairs


def edges_of(model: Model, pairs: DataFrame, program: str) -> DataFrame:
    return model.call_edges.join(pairs.select("pair_id", F.col(program).alias("program_id")), "program_id").select("pair_id", "src_id", "dst_id")


def unique_on(rows: DataFrame, key: list, id_name: str) -> DataFrame:
    """The id of every key that only one row has; counted first, so big groups never meet in a join."""
    return rows.groupBy("pair_id", *key).agg(F.count("*").alias("_n"), F.min("func_id").alias(id_name)).where("_n = 1").drop("_n")


def match_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures that are unique on both sides."""
    key = ["pair_id", *SIGNATURE]
    both = unique_on(a, list(SIGNATURE), "a_id").join(unique_on(b, list(SIGNATURE), "b_id"), key)
    return both.select("pair_id", "a_id", "b_id", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))


def left_over(side: DataFrame, matches: DataFrame, id_name: str) -> DataFrame:
    return side.join(matches.select("pair_id", F.col(id_name).alias("func_id")), ["pair_id", "func_id"], "left_anti")


def _neighbourhood(ids: DataFrame, edges: DataFrame, image: DataFrame) -> DataFrame:
    """Images of the matched callees and callers of each id, as sorted lists; ids without any are left out."""
    out = edges.join(image.withColumnRenamed("func_id", "dst_id"), ["pair_id", "dst_id"]).select("pair_id", F.col("src_id").alias("func_id"), F.struct(F.lit(0).alias("d"), "image").alias("e"))
    into = edges.join(image.withColumnRenamed("func_id", "src_id"), ["pair_id", "src_id"]).select("pair_id", F.col("dst_id").alias("func_id"), F.struct(F.lit(1).alias("d"), "image").alias("e"))
    return out.unionByName(into).join(ids.select("pair_id", "func_id"), ["pair_id", "func_id"], "left_semi").groupBy("pair_id", "func_id").agg(F.array_sort(F.collect_set("e")).alias("around"))


def propagate_round(left_a: DataFrame, left_b: DataFrame, edges_a: DataFrame, edges_b: DataFrame, matches: DataFrame) -> DataFrame:
    """Leftovers whose matched callers and callees are the same, and are so for one function on each side."""
    around_a = _neighbourhood(left_a, edges_a, matches.select("pair_id", F.col("a_id").alias("func_id"), F.col("b_id").alias("image")))
    around_b = _neighbourhood(left_b, edges_b, matches.select("pair_id", F.col("b_id").alias("func_id"), F.col("b_id").alias("image")))
    both = unique_on(around_a, ["around"], "a_id").join(unique_on(around_b, ["around"], "b_id"), ["pair_id", "around"])
    return both.select("pair_id", "a_id", "b_id", F.lit("propagation").alias("method"), F.lit(1.0).alias("score"))


# -- similarity joins: every pair of a score of `least` or more -------------------------------------------------


def _rare_first(a: DataFrame, b: DataFrame, items: str) -> DataFrame:
    """(pair_id, item, df): in how many functions of the pair's two sides an item stands."""
    rows = a.select("pair_id", F.explode(items).alias("item")).unionByName(b.select("pair_id", F.explode(items).alias("item")))
    return rows.groupBy("pair_id", "item").agg(F.count("*").alias("df"))


def _prefix(side: DataFrame, frequency: DataFrame, items: str, least: float, id_name: str) -> DataFrame:
    """The rarest n - ceil(least n) + 1 items of each set: two sets of that similarity share one of them."""
    rows = side.select("pair_id", F.col("func_id").alias(id_name), F.size(items).alias("n"), F.explode(items).alias("item")).join(frequency, ["pair_id", "item"])
    lists = rows.groupBy("pair_id", id_name, "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("sorted"))
    length = (F.col("n") - F.ceil(F.lit(least - S.SLACK) * F.col("n")) + 1).cast("int")
    return lists.select("pair_id", id_name, F.explode(F.slice("sorted", F.lit(1), length)).alias("e")).select("pair_id", id_name, F.col("e.item").alias("item"))


def _scored(candidates: DataFrame, a: DataFrame, b: DataFrame, columns: list[str], score: Column, least: float) -> DataFrame:
    """Candidates with the score of their columns, if it is enough."""
    own = lambda side, name, id_name: side.select("pair_id", F.col("func_id").alias(id_name), F.struct(*columns).alias(name))
    both = candidates.join(own(a, "x", "a_id"), ["pair_id", "a_id"]).join(own(b, "y", "b_id"), ["pair_id", "b_id"])
    return both.select("pair_id", "a_id", "b_id", score.alias("score")).where(F.col("score") >= least - S.SLACK)


def anchor_scores(a: DataFrame, b: DataFrame, least: float = S.ANCHOR_THRESHOLD - S.ANCHOR_MARGIN) -> DataFrame:
    """Jaccard of anchor sets, found by an inverted index over each set's rarest items."""
    a, b = a.where(F.size("anchors") > 0), b.where(F.size("anchors") > 0)
    frequency = _rare_first(a, b, "anchors")
    found = _prefix(a, frequency, "anchors", least, "a_id").join(_prefix(b, frequency, "anchors", least, "b_id"), ["pair_id", "item"]).select("pair_id", "a_id", "b_id").distinct()
    return _scored(found, a, b, ["anchors"], S.jaccard(F.col("x.anchors"), F.col("y.anchors")), least)


def _by_heaviest(a: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pair_id, a_id, hash) and (pair_id, b_id, hash): candidates share an entry of a's heaviest part: what is left of a has a norm below least |a|."""
    heavy = F.reverse(F.array_sort(F.transform("vector", lambda e: F.struct((e["weight"] * e["weight"]).alias("w2"), e["hash"].alias("hash")))))
    total = squared_norm(F.col("vector"))
    before = lambda k: F.aggregate(F.slice(F.col("heavy"), F.lit(1), k), F.lit(0.0), lambda acc, e: acc + e["w2"])
    kept = F.filter("heavy", lambda e, k: F.col("total") - before(k) >= (least - S.SLACK) ** 2 * F.col("total"))
    probes = a.select("pair_id", F.col("func_id").alias("a_id"), heavy.alias("heavy"), total.alias("total")).select("pair_id", "a_id", F.explode(kept).alias("e")).select("pair_id", "a_id", F.col("e.hash").alias("hash"))
    return probes, b.select("pair_id", F.col("func_id").alias("b_id"), F.explode("vector").alias("e")).select("pair_id", "b_id", F.col("e.hash").alias("hash"))


def vector_scores(a: DataFrame, b: DataFrame, least: float = S.VECTOR_THRESHOLD - S.VECTOR_MARGIN) -> DataFrame:
    """Cosine of vectors of `least` or more, by an index of each vector's heaviest entries."""
    a, b = a.where(squared_norm(F.col("vector")) > 0), b.where(squared_norm(F.col("vector")) > 0)
    probes, index = _by_heaviest(a, b, least)
    found = probes.join(index, ["pair_id", "hash"]).select("pair_id", "a_id", "b_id").distinct()
    return _scored(found, a, b, ["vector"], S.vector_cosine(F.col("x.vector"), F.col("y.vector")), least)


DENSE_ENTRIES = 4_096  # different hashes of a pair up to which vectors may meet as rows of a matrix


def vectors_are_dense(a: DataFrame, b: DataFrame, least: float = S.VECTOR_THRESHOLD - S.VECTOR_MARGIN) -> bool:
    """Whether hashes are few and so common that the index would ask for most pairs, and for many of them again and again."""
    probes, index = _by_heaviest(a, b, least)
    asked, held = (x.groupBy("pair_id", "hash").agg(F.count("*").alias(n)) for x, n in ((probes, "x"), (index, "y")))
    met = asked.join(held, ["pair_id", "hash"], "full").groupBy("pair_id").agg(F.sum(F.col("x") * F.col("y")).alias("met"), F.count("*").alias("hashes"))
    sizes = [side.groupBy("pair_id").agg(F.count("*").alias(n)) for side, n in ((a, "na"), (b, "nb"))]
    seen = met.join(sizes[0], "pair_id").join(sizes[1], "pair_id").agg(F.sum("met"), F.sum(F.col("na").cast("double") * F.col("nb")), F.max("hashes")).first()
    return bool(seen[0]) and seen[0] > seen[1] / 2 and seen[2] <= DENSE_ENTRIES


def vector_leaders(a: DataFrame, b: DataFrame, best: int, least: float = S.VECTOR_THRESHOLD - S.VECTOR_MARGIN) -> DataFrame:
    """Of `vector_scores` those that are among the `best` of their function on either side, at least; dense vectors meet by matrix product."""
    if not vectors_are_dense(a, b, least):
        return vector_scores(a, b, least)
    found = stored(best_vector_pairs(a, b, best_of=best).where(F.col("score") >= least - 2 * S.SLACK).select("pair_id", "a_id", "b_id"), "vector-leaders")
    return _scored(found, a, b, ["vector"], S.vector_cosine(F.col("x.vector"), F.col("y.vector")), least)


class _Rows:
    """Counted lists as compressed rows: row k has ids[starts[k]:starts[k + 1]] with counts alike, and a length."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.starts, self.ids, self.counts = np.concatenate(([0], np.cumsum(sizes))), ids, counts
        self.norms = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), counts * counts, len(sizes)).astype(float))

    @staticmethod
    def of(a: pa.Table, b: pa.Table, column: str) -> tuple[_Rows, _Rows, int]:
        """A column of packed lists of both tables with the same numbers for the same items, and how many items there are."""
        sides = [unpack(t.column(column).combine_chunks()) for t in (a, b)]
        coded = pa.chunked_array([names for _, names, _ in sides]).combine_chunks().dictionary_encode()
        ids, cut, width = coded.indices.to_numpy(), len(sides[0][1]), len(coded.dictionary)
        return *(_Rows(sizes, own, counts.astype(float)) for (sizes, _, counts), own in zip(sides, (ids[:cut], ids[cut:]), strict=True)), width

    def dense(self, rows: slice, width: int) -> np.ndarray:
        out = np.zeros((rows.stop - rows.start, width))
        here = slice(self.starts[rows.start], self.starts[rows.stop])
        out[np.repeat(np.arange(len(out)), np.diff(self.starts[rows.start : rows.stop + 1])), self.ids[here]] = self.counts[here]
        return np.divide(out, self.norms[rows, None], out=out, where=self.norms[rows, None] > 0)

    def turned(self, width: int) -> _Rows:
        """By item: the rows that have it, with their counts."""
        order = np.argsort(self.ids, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
        return _Rows(np.bincount(self.ids, minlength=width), rows[order], self.counts[order])

    def dots(self, rows: slice, other: _Rows, n: int) -> np.ndarray:
        """Of some rows with all n rows of a table that is turned: only items that both have cost anything."""
        out = np.zeros((rows.stop - rows.start, n))
        for k in range(len(out)):
            own = slice(self.starts[rows.start + k], self.starts[rows.start + k + 1])
            ids, counts = self.ids[own], self.counts[own]
            sizes = other.starts[ids + 1] - other.starts[ids]
            some = sizes > 0
            ids, counts, sizes = ids[some], counts[some], sizes[some]
            if len(ids):
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(other.starts[ids] - (ends - sizes), sizes)
                out[k] = np.bincount(other.ids[at], np.repeat(counts, sizes) * other.counts[at], n)
        return out


def _leaders(groups: np.ndarray, score: np.ndarray, others: np.ndarray, best: int) -> np.ndarray:
    """Which rows are among the `best` of their group by score, then by the other's id."""
    order = np.lexsort((others, -score, groups))
    of = groups[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], of[1:] != of[:-1])), np.arange(len(of)), 0))
    out = np.zeros(len(groups), bool)
    out[order] = np.arange(len(of)) - first < best
    return out


def _enough(score: np.ndarray, least: float, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Where score is enough and, with `best`, as great as the so many greatest of its row or of its column."""
    some = score >= least
    if best is not None:
        kth = [np.partition(score, -best, axis)[(slice(None), [-best]) if axis else ([-best], slice(None))] if score.shape[axis] > best else np.array([[least]]) for axis in (1, 0)]
        some &= (score >= kth[0]) | (score >= kth[1])
    return np.nonzero(some)


def _block_scores(a: pa.Table, b: pa.Table, least: float, best: int | None = None, chunk: int = 500) -> pa.Table:
    """The pairs of two blocks with enough: histograms meet by matrix product, trigrams by an index of those of b.

    With `best`, only pairs that are among so many for their function on either side.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    hist_a, hist_b, width = _Rows.of(a, b, "mnemonics")
    gram_a, gram_b, n_grams = _Rows.of(a, b, "trigrams")
    by_gram = gram_b.turned(n_grams)
    numbers = {c: (a.column(c).to_numpy().astype(float), b.column(c).to_numpy().astype(float)) for c in ("bb_count", "out_degree")}
    own, other = a.column("func_id").to_numpy(), b.column("func_id").to_numpy()
    for at in range(0, len(a), chunk):
        x = slice(at, min(at + chunk, len(a)))
        mine, order = hist_a.dense(x, width), gram_a.dots(x, by_gram, len(b))
        for to in range(0, len(b), chunk):
            y = slice(to, min(to + chunk, len(b)))
            hist = mine @ hist_b.dense(y, width).T
            rest = sum(w * (1.0 - np.abs(p[x, None] - q[None, y]) / np.maximum(p[x, None] + q[None, y], 1)) for (p, q), w in zip(numbers.values(), (0.25, 0.15), strict=True))
            both = gram_a.norms[x, None] * gram_b.norms[None, y]
            score = np.where(both == 0, 0.60 * hist, 0.35 * hist) + rest
            score += 0.25 * np.divide(order[:, y], both, out=np.zeros_like(both), where=both > 0)
            i, j = _enough(score, least - S.SLACK, best)
            out.append((own[x][i], other[y][j], score[i, j]))
    a_id, b_id, score = (np.concatenate(c) for c in zip(*out, strict=True))
    if best is not None and len(score):
        kept = _leaders(a_id, score, b_id, best) | _leaders(b_id, score, a_id, best)
        a_id, b_id, score = a_id[kept], b_id[kept], score[kept]
    pair = a.column("pair_id")[0].as_py() if len(score) else ""  # one pair a group
    return pa.table({"pair_id": pa.array([pair] * len(score), pa.string()), "a_id": a_id, "b_id": b_id, "score": score})


def _with_range(side: DataFrame) -> DataFrame:
    """side with `range`, a class of functions of like size, and what bounds their scores.

    kinds and peak, for mnemonics (m) and trigrams (g): how many different ones a function has, and the share of its norm that one may make up.
    """
    total = F.aggregate("trigrams", F.lit(0).cast("bigint"), lambda acc, e: acc + e["count"])
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, e: acc + e["count"] * e["count"]))
    peak = lambda c: F.coalesce(F.array_max(F.transform(c, lambda e: e["count"])) / F.nullif(norm(c), F.lit(0.0)), F.lit(0.0))
    size = F.floor(F.log2(1.0 + total)).cast("int")
    return side.withColumns({"range": size, "_km": F.size("mnemonics"), "_kg": F.size("trigrams"), "_pm": peak("mnemonics"), "_pg": peak("trigrams")})


def _ranges(side: DataFrame, block: int, name: str) -> DataFrame:
    """(pair_id, range_<name>, <name>): for each range of functions, how many blocks it makes and the bounds of what is in it."""
    bounds = [F.ceil(F.count("*") / block).cast("int").alias("blocks")]
    for c in ("bb_count", "out_degree"):
        bounds += [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    bounds += [F.max(c).alias(c) for c in ("_km", "_kg", "_pm", "_pg")]
    return side.groupBy("pair_id", F.col("range").alias(f"range_{name}")).agg(F.struct(*bounds).alias(name))


def range_bound() -> Column:
    """No function of range x and none of range y have a greater similarity.

    A cosine is at most what y has of its norm on the entries of x: sqrt(entries of x) times y's greatest entry, over y's norm.
    Closeness grows as the smaller number comes near the greater one. Without trigrams the mix weighs 0.60, and 0.35 + 0.25 with them.
    """
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    cosine = lambda k, p: F.least(F.lit(1.0), F.sqrt(x(k)) * y(p), F.sqrt(y(k)) * x(p))

    def close(c: str) -> Column:
        low, high = (F.when(x(f"{c}_high") < y(f"{c}_low"), v).when(y(f"{c}_high") < x(f"{c}_low"), w) for v, w in ((x(f"{c}_high"), y(f"{c}_high")), (y(f"{c}_low"), x(f"{c}_low"))))
        return F.coalesce(S.closeness(low, high), F.lit(1.0))

    mix, order = cosine("_km", "_pm"), cosine("_kg", "_pg")
    one_without = F.col("range_x") * F.col("range_y") == 0  # range 0: no trigrams
    return F.when(one_without, 0.60 * mix).otherwise(0.35 * mix + 0.25 * order) + 0.25 * close("bb_count") + 0.15 * close("out_degree")


def range_pairs(a: DataFrame, b: DataFrame, least: float, block: int) -> DataFrame:
    """(pair_id, range_x, range_y, x, y, meets): all pairs of ranges, and whether two of their functions may reach `least`."""
    both = _ranges(a, block, "x").join(_ranges(b, block, "y"), "pair_id")
    return both.withColumn("meets", range_bound() >= least - S.SLACK)


def _grouped(side: DataFrame, block: int) -> DataFrame:
    """side with ranges of like size taken together up to about a block: each class is dealt out once for every block that it meets."""
    sizes = side.groupBy("pair_id", "range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("pair_id").orderBy("range")) - F.col("_n")  # a row a power of two
    label = F.when(F.col("range") == 0, 0).otherwise(1 + F.floor(before / block)).cast("int")
    return side.join(F.broadcast(sizes.select("pair_id", "range", label.alias("_label"))), ["pair_id", "range"]).withColumn("range", F.col("_label")).drop("_label")


FUZZY = ["pair_id", "func_id", "bb_count", "out_degree", "mnemonics", "trigrams"]


def _dealt(a: DataFrame, b: DataFrame, least: float, block: int):
    """Both sides as blocks of functions, grouped by the pairs of blocks that have to meet: in rounds, one for each class of b."""
    def fresh(side: DataFrame) -> DataFrame:  # columns of its own: both sides may come from one table
        side = _grouped(_with_range(side.select(*(F.col(c).alias(c) for c in FUZZY))), block)
        return stored(side.withColumns({"mnemonics": packed("mnemonics"), "trigrams": packed("trigrams")}), "packed-side")

    a, b = fresh(a), fresh(b)
    meeting = stored(range_pairs(a, b, least, block).where("meets").select("pair_id", "range_x", "range_y", F.col("x.blocks").alias("nx"), F.col("y.blocks").alias("ny")), "block-pairs")
    deal = lambda n: F.pmod(F.xxhash64("func_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["pair_id", "range_x", "range_y", "kx", "ky"]
    for label in [r[0] for r in meeting.select("range_y").distinct().orderBy("range_y").collect()]:
        out, now = [], F.broadcast(meeting.where(F.col("range_y") == label))
        for side, own, mine, other in ((a, "range_x", "x", "y"), (b, "range_y", "y", "x")):
            rows = side.withColumnRenamed("range", own).join(now, ["pair_id", own])
            rows = rows.withColumn(f"k{mine}", deal(f"n{mine}")).withColumn(f"k{other}", each(f"n{other}"))
            out.append(rows.select(*(F.col(c).alias(c) for c in (*FUZZY, *key[1:]))).groupBy(*key))
        yield out


def fuzzy_scores(a: DataFrame, b: DataFrame, least: float = S.FUZZY_THRESHOLD - S.FUZZY_MARGIN, block: int = 4_000, best: int | None = None) -> DataFrame:
    """Instruction-mix similarity of every pair that has `least`; common mnemonics leave no index to use, so blocks of rows meet.

    Functions are classed by size (trigrams, in powers of two; small classes together), and classes that can't reach `least` by
    their bounds do not meet. Each class is dealt into blocks of about `block` rows; no task gets more than one block of each side.
    With `best`, pairs beyond so many on both of their sides are left out within each pair of blocks.
    """
    rows = a.sparkSession.createDataFrame([], SCORES)
    for left, right in _dealt(a, b, least, block):
        rows = rows.unionByName(stored(left.cogroup(right).applyInArrow(lambda x, y: _block_scores(x, y, least, best), SCORES), "fuzzy-blocks"))
    return rows


def eligible(side: DataFrame, kind: str) -> DataFrame:
    if kind == "anchor":
        return side.where(F.size("anchors") >= S.ANCHOR_MIN)
    return side.where(F.size("vector") >= S.VECTOR_MIN) if kind == "bsim" else side.where(F.size("mnemonics") > 0)


RUNGS = {"anchor": (anchor_scores, S.ANCHOR_THRESHOLD, S.ANCHOR_MARGIN), "bsim": (vector_scores, S.VECTOR_THRESHOLD, S.VECTOR_MARGIN), "fuzzy": (fuzzy_scores, S.FUZZY_THRESHOLD, S.FUZZY_MARGIN)}


ALIKE = {"anchor": ("anchors",), "bsim": ("vector",), "fuzzy": ("mnemonics", "trigrams", "bb_count", "out_degree")}


def two_of_each(side: DataFrame, kind: str) -> DataFrame:
    """The side without the third and further function of the same features.

    Functions alike tie for whatever they are compared with, so none of them is a unique best; two are enough
    to show that. A group of n equal ones then costs two rows, not n for each function that comes near it.
    """
    alike = side.groupBy("pair_id", *(F.array_sort(c).alias(c) if c in ("anchors", "vector") else c for c in ALIKE[kind])).agg(F.min("func_id").alias("_x"), F.max("func_id").alias("_y"))
    kept = alike.select("pair_id", F.explode(F.array_distinct(F.array("_x", "_y"))).alias("func_id"))
    return side.join(kept, ["pair_id", "func_id"], "left_semi")


def leaders(kind: str, a: DataFrame, b: DataFrame, best: int = 2) -> DataFrame:
    """Scores of a rung that hold the `best` of each function on either side, at least: two show the best and its lead."""
    if kind == "anchor":
        return anchor_scores(a, b)
    return vector_leaders(a, b, best) if kind == "bsim" else fuzzy_scores(a, b, best=best)


LIST = "pair_id string, a_id bigint, b_id bigint, score double, ra int, rb int"


def score_lists(kind: str, a: DataFrame, b: DataFrame, best: int) -> DataFrame:
    """Scores with their ranks ra and rb in a's and in b's list. Fuzzy lists hold best + 1 rows at most: rank best + 1 says that a list was cut there.

    Anchor and vector lists come from an index, hold all rows, and have no ranks to speak of (1).
    """
    scores, _, _ = RUNGS[kind]
    if kind != "fuzzy":
        return scores(a, b).withColumns({"ra": F.lit(1), "rb": F.lit(1)})
    table = fuzzy_scores(a, b, best=best + 1)  # a row has best + 1 a block pair at most
    for own, other, rank in (("a_id", "b_id", "ra"), ("b_id", "a_id", "rb")):
        table = table.withColumn(rank, F.row_number().over(Window.partitionBy("pair_id", own).orderBy(F.desc("score"), other)))
    kept = table.where((F.col("ra") <= best + 1) | (F.col("rb") <= best + 1))
    within = lambda c: F.when(F.col(c) <= best + 1, F.col(c)).alias(c)
    return kept.select("pair_id", "a_id", "b_id", "score", within("ra"), within("rb"))


class Rung:
    """One feature rung over several rounds: scores are made once, and made again only for functions whose list ran out.

    Functions of the same features are one class with one score. A list that was cut at `best` and of which fewer than two live
    functions are left says no longer who is best and by how much: its function is scored again, with all that live then.
    """

    def __init__(self, kind: str, a: DataFrame, b: DataFrame, best: int = 16):
        self.kind, self.best, self.sides, self.lists = kind, best, (a, b), None
        self.rescored: list[int] = []  # by round: classes whose scores were made

    def _start(self, left_a: DataFrame, left_b: DataFrame) -> None:
        sides = []
        for side, left in zip(self.sides, (left_a, left_b), strict=True):
            own = eligible(side.join(left, ["pair_id", "func_id"], "left_semi"), self.kind)
            alike = [F.array_sort(c) if c in ("anchors", "vector") else F.col(c) for c in ALIKE[self.kind]]
            marks = {"_mark": F.xxhash64(*alike), "_mark2": F.xxhash64(F.lit(2), *alike)}
            sides.append((own.select("pair_id", "func_id", *ALIKE[self.kind]).withColumns(marks), f"{self.kind}-features"))
        sides = stored_together(*sides)
        named = []
        for own in sides:
            first = own.groupBy("pair_id", "_mark", "_mark2").agg(F.min("func_id").alias("class"))
            named.append((own.select("pair_id", "func_id", "_mark", "_mark2").join(first, ["pair_id", "_mark", "_mark2"]).select("pair_id", "func_id", "class"), f"{self.kind}-classes"))
        self.classes = stored_together(*named)
        self.features = [own.join(c.where("func_id = class").select("pair_id", "func_id"), ["pair_id", "func_id"], "left_semi") for own, c in zip(sides, self.classes, strict=True)]
        self.lists = stored(score_lists(self.kind, *self.features, self.best), f"{self.kind}-lists")
        self.rescored.append(sum(c.where("func_id = class").count() for c in self.classes))

    def _live(self, left_a: DataFrame, left_b: DataFrame) -> list[DataFrame]:
        """For each side (pair_id, class, low, high): classes with the least and the greatest of their functions that are left."""
        ends = [F.min("func_id").alias("low"), F.max("func_id").alias("high")]
        return [c.join(left, ["pair_id", "func_id"], "left_semi").groupBy("pair_id", "class").agg(*ends) for c, left in zip(self.classes, (left_a, left_b), strict=True)]

    def _ran_out(self, own: str, other: str, rank: str, live: DataFrame, live_other: DataFrame) -> DataFrame:
        """(pair_id, func_id): live classes with a cut list of which fewer than two live functions are left."""
        rows = self.lists.where(f"{rank} is not null").join(live.select("pair_id", F.col("class").alias(own)), ["pair_id", own], "left_semi")
        count = F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2)
        rows = rows.join(live_other.withColumnRenamed("class", other), ["pair_id", other], "left").withColumn("_n", F.when(F.col(rank) <= self.best, count).otherwise(0))
        out = rows.groupBy("pair_id", own).agg(F.sum("_n").alias("_n"), F.max(rank).alias("_last")).where((F.col("_last") > self.best) & (F.col("_n") < 2))
        return out.select("pair_id", F.col(own).alias("func_id"))

    def round(self, left_a: DataFrame, left_b: DataFrame) -> DataFrame:
        """New matches (pair_id, a_id, b_id, method, score) among what is left (pair_id, func_id on each side)."""
        first = self.lists is None
        if first:
            self._start(left_a, left_b)
        a, b = self._live(left_a, left_b)
        if not first:
            if self.kind == "fuzzy":
                a, b = stored_together((a, "live"), (b, "live"))
            self.rescored.append(self._renew(a, b) if self.kind == "fuzzy" else 0)
        rows = self.lists.join(a.select("pair_id", F.col("class").alias("a_id"), F.array("low", "high").alias("_a")), ["pair_id", "a_id"])
        rows = rows.join(b.select("pair_id", F.col("class").alias("b_id"), F.array("low", "high").alias("_b")), ["pair_id", "b_id"])
        each = lambda c: F.explode(F.array_distinct(c))  # noqa: E731  of functions alike two are enough to show a tie
        table = stored(rows.select("pair_id", each("_a").alias("a_id"), "_b", "score").select("pair_id", "a_id", each("_b").alias("b_id"), "score"), f"{self.kind}-live-scores")
        _, threshold, margin = RUNGS[self.kind]
        return S.reciprocal(table, threshold, margin).select("pair_id", "a_id", "b_id", F.lit(self.kind).alias("method"), "score")

    def _renew(self, live_a: DataFrame, live_b: DataFrame) -> int:
        """Score classes again whose lists ran out; gives how many those are."""
        both = [self._ran_out(*x).withColumn("side", F.lit(k)) for k, x in enumerate((("a_id", "b_id", "ra", live_a, live_b), ("b_id", "a_id", "rb", live_b, live_a)))]
        both = stored(both[0].unionByName(both[1]), "ran-out")
        sizes = dict(both.groupBy("side").count().collect())
        gone, n = [both.where(f"side = {k}").drop("side") for k in (0, 1)], [sizes.get(k, 0) for k in (0, 1)]
        if not sum(n):
            return 0
        now = [f.join(x.select("pair_id", F.col("class").alias("func_id")), ["pair_id", "func_id"], "left_semi") for f, x in zip(self.features, (live_a, live_b), strict=True)]
        dirty = [f.join(x, ["pair_id", "func_id"], "left_semi") for f, x in zip(now, gone, strict=True)]
        old = self.lists
        for x, own, rank in zip(gone, ("a_id", "b_id"), ("ra", "rb"), strict=True):
            mark = x.select("pair_id", F.col("func_id").alias(own), F.lit(True).alias("_gone"))
            old = old.join(mark, ["pair_id", own], "left").withColumn(rank, F.when(F.col("_gone").isNull(), F.col(rank))).drop("_gone")
        own = lambda rank: lambda rows: rows.where(f"{rank} is not null").withColumn({"ra": "rb", "rb": "ra"}[rank], F.lit(None).cast("int"))
        parts = [old.select("pair_id", "a_id", "b_id", "score", "ra", "rb")]
        if n[0]:
            parts.append(own("ra")(score_lists(self.kind, dirty[0], now[1], self.best)))
        if n[1]:
            parts.append(own("rb")(score_lists(self.kind, now[0], dirty[1], self.best)))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        once = rows.groupBy("pair_id", "a_id", "b_id").agg(F.max("score").alias("score"), F.min("ra").alias("ra"), F.min("rb").alias("rb"))
        self.lists = stored(once.where("ra is not null or rb is not null"), f"{self.kind}-lists")
        return sum(n)


class Propagation:
    """Propagation over several rounds: each match that is new adds to what is around its callers and callees, and nothing else is gone through.

    What is around a function is the set of its matched callers' and callees' images, as a count and two 64-bit hashes (xor
    over the set). Every neighbour is matched once, so rounds add up, and a hub is summed up in parts.
    """

    def __init__(self, edges_a: DataFrame, edges_b: DataFrame):
        self.edges, self.around = (edges_a, edges_b), [None, None]
        self.rescored: list[int] = []  # by round: functions that got neighbours

    def round(self, left_a: DataFrame, left_b: DataFrame, fresh: DataFrame) -> DataFrame:
        """fresh: the matches that were made since the last round."""
        tables = []
        for k, (edges, own, left) in enumerate(zip(self.edges, ("a_id", "b_id"), (left_a, left_b), strict=True)):
            image = fresh.select("pair_id", F.col(own).alias("n"), F.col("b_id").alias("image"))
            out = edges.select("pair_id", F.col("src_id").alias("func_id"), F.lit(0).alias("d"), F.col("dst_id").alias("n"))
            into = edges.select("pair_id", F.col("dst_id").alias("func_id"), F.lit(1).alias("d"), F.col("src_id").alias("n"))
            rows = out.unionByName(into).join(image, ["pair_id", "n"]).select("pair_id", "func_id", "d", "image").distinct()
            of = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "d", "image"))
            new = rows.groupBy("pair_id", "func_id").agg(F.count("*").alias("n"), of(1).alias("h1"), of(2).alias("h2"), F.lit(1).alias("fresh"))
            if self.around[k] is not None:
                new = self.around[k].withColumn("fresh", F.lit(0)).unionByName(new)
            whole = new.join(left, ["pair_id", "func_id"], "left_semi").groupBy("pair_id", "func_id")
            tables.append((whole.agg(F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.max("fresh").alias("fresh")), "around"))
        self.around = stored_together(*tables)
        self.rescored.append(sum(x.where("fresh = 1").count() for x in self.around))
        marks = [unique_on(x, ["n", "h1", "h2"], own) for x, own in zip(self.around, ("a_id", "b_id"), strict=True)]
        both = marks[0].join(marks[1], ["pair_id", "n", "h1", "h2"])
        return both.select("pair_id", "a_id", "b_id", F.lit("propagation").alias("method"), F.lit(1.0).alias("score"))


def feature_round(left_a: DataFrame, left_b: DataFrame, kind: str) -> DataFrame:
    """Leftovers that are each other's unique best by one feature."""
    _, threshold, margin = RUNGS[kind]
    a, b = (stored(two_of_each(eligible(side, kind), kind), f"{kind}-side") for side in (left_a, left_b))
    table = leaders(kind, a, b) if kind == "fuzzy" else stored(leaders(kind, a, b), f"{kind}-scores")
    return S.reciprocal(table, threshold, margin).select("pair_id", "a_id", "b_id", F.lit(kind).alias("method"), "score")
