"""Vectors of (hash, weight) by blocks: the best of each function without the matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.plans.store import stored

SCORES = "pair_id string, a_id bigint, b_id bigint, score double"


def _dense(lists: pa.ListArray, ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of (hash, weight) lists as vectors of length 1 over `width` hashes; those without weight stay zero."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    out = np.zeros((len(sizes), width))
    np.add.at(out, (np.repeat(np.arange(len(sizes)), sizes), ids), lists.flatten().field("weight").to_numpy().astype(float))
    norm = np.sqrt((out * out).sum(1))[:, None]
    return np.divide(out, norm, out=out, where=norm > 0)


def _best_of_block(a: pa.Table, b: pa.Table, best_of: int = 2, chunk: int = 1_000) -> pa.Table:
    """The pairs of two blocks of vectors that are among the best two (or more) of their function on either side; scores to 9 places, equal ones by id."""
    x, y = (t.column("vector").combine_chunks() for t in (a, b))
    coded = pa.chunked_array([x.flatten().field("hash"), y.flatten().field("hash")]).combine_chunks().dictionary_encode()
    ids, cut = coded.indices.to_numpy().astype(np.int64), len(x.flatten())
    own, other = a.column("func_id").to_numpy(), b.column("func_id").to_numpy()
    order = np.argsort(other, kind="stable")  # so that of equal scores argmax takes the least id
    left, right = _dense(x, ids[:cut], len(coded.dictionary)), _dense(y, ids[cut:], len(coded.dictionary))[order]
    out, rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], np.argsort(own, kind="stable")
    for at in range(0, len(rows), chunk):
        part = rows[at : at + chunk]
        score = np.round(left[part] @ right.T, 9)
        for axis in (1, 0):
            here = score.copy()
            for _ in range(min(best_of, score.shape[axis])):
                best = here.argmax(axis)
                i, j = (np.arange(len(part)), best) if axis else (best, np.arange(len(order)))
                some = here[i, j] > 0
                out.append((own[part][i[some]], other[order][j[some]], score[i[some], j[some]]))
                here[i, j] = -1
    a_id, b_id, score = (np.concatenate(c) for c in zip(*out, strict=True))
    pair = a.column("pair_id")[0].as_py() if len(score) else ""
    return pa.table({"pair_id": pa.array([pair] * len(score), pa.string()), "a_id": a_id, "b_id": b_id, "score": score})


def best_vector_pairs(a: DataFrame, b: DataFrame, block: int = 4_000, best_of: int = 2) -> DataFrame:
    """(pair_id, a_id, b_id, score): for every function its two best by cosine, and other pairs; what they show of bests and leads is exact.

    Blocks of vectors meet by matrix product and give four rows a function at most, so the matrix itself is never made.
    """
    has = F.aggregate("vector", F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]) > 0
    a, b = (side.where(has).select(*(F.col(c).alias(c) for c in ("pair_id", "func_id", "vector"))) for side in (a, b))
    count = lambda side, out: side.groupBy("pair_id").agg(F.ceil(F.count("*") / block).cast("int").alias(out))
    sizes = stored(count(a, "na").join(count(b, "nb"), "pair_id"), "sizes")
    deal = lambda n: F.pmod(F.xxhash64("func_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda rows: rows.select(*(F.col(c).alias(c) for c in ("pair_id", "func_id", "vector", "ka", "kb"))).groupBy("pair_id", "ka", "kb")
    left = own(a.join(sizes, "pair_id").withColumn("ka", deal("na")).withColumn("kb", each("nb")))
    right = own(b.join(sizes, "pair_id").withColumn("kb", deal("nb")).withColumn("ka", each("na")))
    rows = left.cogroup(right).applyInArrow(lambda x, y: _best_of_block(x, y, best_of), SCORES)
    return rows.groupBy("pair_id", "a_id", "b_id").agg(F.max("score").alias("score"))
