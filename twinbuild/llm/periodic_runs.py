"""Periodic runs of words: maximal pairs of an LCP-interval tree, and texts with each run collapsed to one period.

A run is a stretch of consecutive words with smallest period q, of length 2 q or more (and of `least` words),
that can't be extended. Where its first word stands at s, the pair (s, s + q) is a maximal pair: the words
before the two places differ, and what follows is equal for l = length - q words and no longer. Conversely a
maximal pair of distance q and common length l >= q spans a stretch of period q that neither side extends. So
runs are exactly the maximal pairs with q <= l and q + l >= least, and of those with the same stretch the nearest.

Method: the suffixes of a text in order, with the lengths that neighbours have in common (LCP). The intervals
of the tree are gone through from the deepest up, with a stack. Each interval's list holds its places in order,
classed by the word on their left. When two lists of one interval join, all common lengths across them are
the interval's l, so what is left to ask is a place of the other list within l words and of another class. By
periodicity only the nearest one on each side can be the run's (a nearer occurrence within the first q words
would give a smaller period), so a list is asked twice for each place of the shorter one.

Only texts with an equal stretch of least / 2 words (12: 6) can hold a run, since q + l >= least and l >= q;
those are found by hashes of all windows, which can let a text through but miss none.

Defined cases: a null text is empty; an empty text has no run and collapses to itself; a run may be the whole text;
repeated rows and rows with null ids are answered each; columns not in `keep` are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, split_words

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, for hashes modulo 2^64


def texts_with_twins(ids: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """The texts that may hold a stretch of `width` words twice: two of its windows have one hash."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
    mixed ^= mixed >> np.uint64(29)
    window = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        window = window * np.uint64(_MULTIPLIER) + mixed[k : n + k]
    whole = np.flatnonzero(text[:n] == text[width - 1 :])
    by = whole[np.argsort(window[whole], kind="stable")]
    twins = (window[by[1:]] == window[by[:-1]]) & (text[by[1:]] == text[by[:-1]])
    return np.unique(text[by[1:][twins]])


def suffixes(ids: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places by the words from there to the end of their text, and the words that neighbours of one text have in common.

    Prefix doubling: after round k, places rank by their first 2^k words. Places that rank alone are left
    out of later rounds. The ranks of all rounds, kept, give the common lengths by binary descent.
    """
    n = len(ids)
    rank = np.zeros(n, np.int32)
    place = np.lexsort((ids, text))
    first = np.concatenate(([True], (ids[place[1:]] != ids[place[:-1]]) | (text[place[1:]] != text[place[:-1]])))
    rank[place] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank], 1
    open_ = place[~(first & np.append(first[1:], True))]
    while len(open_):
        ahead = open_ + width
        inside = ahead < ends[open_]
        following = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        order = np.lexsort((following, rank[open_]))
        open_, following = open_[order], following[order]
        old = rank[open_]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        new = new_old | np.concatenate(([True], following[1:] != following[:-1]))
        at = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_old, at, 0))
        levels.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((x < ends[order[:-1]]) & (y < ends[order[1:]]))
        equal = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        common[equal + 1] += 1 << k
        x[equal] += 1 << k
        y[equal] += 1 << k
    return order, common


def _joined(a: list[int], b: list[int], shared: int, left: list[int], least: int, found: list[tuple[int, int, int]]) -> list[int]:
    """The places of two lists of one interval; adds (start, words in common, distance) of their maximal pairs that are runs."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    for x in small:
        k = bisect_left(large, x)
        if k < len(large):
            d = large[k] - x
            if d <= shared and d + shared >= least and left[large[k]] != left[x]:
                found.append((x, shared, d))
        if k:
            d = x - large[k - 1]
            if d <= shared and d + shared >= least and left[large[k - 1]] != left[x]:
                found.append((large[k - 1], shared, d))
    if 16 * len(small) > len(large):
        return sorted(large + small)  # two sorted lists: merged in one go
    for x in small:
        large.insert(bisect_left(large, x), x)
    return large


def runs_of(ids: np.ndarray, text: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (first place, length, period) of all runs of some texts that stand one after the other, by place and period.

    ids: a number for each word, alike for equal ones; text: the number of each word's text, ascending.
    """
    none = np.zeros((0, 3), np.int64)
    width = max((least + 1) // 2, 1)
    chosen = texts_with_twins(ids, text, width)
    if not len(chosen):
        return none
    at = np.flatnonzero(np.isin(text, chosen))
    ids, text = ids[at], text[at]
    ends = np.searchsorted(text, text, side="right")
    order, common = suffixes(ids, text, ends)
    deep = common >= width
    near = np.flatnonzero(deep | np.append(deep[1:], False))
    begins = np.concatenate(([True], text[1:] != text[:-1]))
    left = np.where(begins, -1, np.roll(ids, 1)).tolist()
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    own: list[int] = []
    for place, shared in zip(order[near].tolist(), np.where(deep, common, 0)[near].tolist(), strict=True):
        while stack and stack[-1][0] >= shared:
            depth, before = stack.pop()
            own = _joined(before, own, depth, left, least, found)
        if shared:  # with the place before, so the interval goes on
            stack.append((shared, own))
        own = [place]
    while stack:
        depth, before = stack.pop()
        own = _joined(before, own, depth, left, least, found)
    if not found:
        return none
    start, shared, period = np.array(found, np.int64).T
    rows = np.stack([at[start], shared + period, period], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    same = (rows[1:, :2] == rows[:-1, :2]).all(1)
    rows = rows[np.concatenate(([True], ~same))]  # of one stretch the smallest period
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def dropped(runs: np.ndarray, words: int) -> np.ndarray:
    """Which words lie in a run after its first period."""
    change = np.zeros(words + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 12) -> DataFrame:
    """`keep` (columns of other names than these), n_words, runs by start and period, and the text collapsed: kept words, one space between."""
    schema = docs.select(*keep).schema
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "n_words bigint", f"runs {RUN}", "collapsed string"])

    def searched(batches):
        for batch in batches:
            words, sizes = split_words(batch.column(batch.schema.get_field_index("_text")), lower=False)
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            text_of = np.repeat(np.arange(len(sizes)), sizes)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            runs = runs_of(ids, text_of, least)
            of = text_of[runs[:, 0]]
            gone = dropped(runs, len(ids))
            kept_words = words.filter(pa.array(~gone)) if len(runs) else words
            kept_sizes = sizes - np.bincount(text_of[gone], minlength=len(sizes))
            offsets = pa.array(np.concatenate(([0], np.cumsum(kept_sizes))), pa.int32())
            columns = pa.StructArray.from_arrays([pa.array(runs[:, 0] - starts[of]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32()), columns)
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, kept_words), " ")
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), lists, joined], names=[*keep, "n_words", "runs", "collapsed"])

    return by_bytes(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))).mapInArrow(searched, ddl)


def run_digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How many runs, the longest one (ties: smallest start, then period), and fingerprints of all runs and of the collapsed text."""
    ranked = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("_top", ranked)
    return rows.select(
        *keep, F.size("runs").cast("long").alias("n_runs"), *(F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("_top.length") / F.col("_top.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def repeated_from(docs: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """docs in which every tenth text (by crc32 h of its number) goes round in a period from some word on.

    With n words, word i >= a becomes word a + (i - a) % p, where g = floor(h / 10), a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those without words or number, stay as they are.
    """
    h = F.crc32(F.col(number).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("_words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turned = F.transform("_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))))
    hit = F.when(h % 10 == 0, words)
    rows = docs.select(*docs.columns, hit.alias("_words")).withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return rows.withColumn(text, F.when(F.col("_p").isNotNull(), F.array_join(turned, " ")).otherwise(F.col(text))).drop("_words", "_a", "_p")
