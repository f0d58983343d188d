"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated on labelled rows.

A document's rule statistics come from its whole text. The forest (Liu, Ting and Zhou 2008) grows each
tree on `tree_rows` documents, as the method prescribes; path lengths over its random splits give every
document an anomaly score. The threshold is the one that best separates label 0 from label 1 while it
rejects at most `most_good` of the rows labelled 1; it is read from a histogram of the scores of all
labelled rows.

Defined cases: a null text is empty and has all statistics 0; documents that fail the base rules are
never kept; without labels of both kinds no document is rejected by the forest; repeated rows are
answered each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from twinbuild.llm.common import by_bytes, hash_sample, slices, stored

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_bangs")
BINS_OF_SCORE = 1000
ODD_LINES = 0.02  # repeated lines a word, below which all texts are alike: one or two in a text are nothing odd, though rare
_symbols = list(b"#*$%&|<>")
_blank = list(b" \t\n\r\v\f")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key = ids[:n]
    for k in range(1, width):
        key = np.unique(key * len(number) + ids[k : n + k], return_inverse=True)[1].reshape(-1)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def rule_statistics(text: bytes) -> list[int]:
    """COUNTS, then EXTRA."""
    words = text.split()
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = len(text) - int(of[0x80:0xC0].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        len(words), points - int(of[_blank].sum()), int(of[_symbols].sum()), len(lines) - len(set(lines)), repeated_words(words),
        int(of[65:91].sum()), int(of[33]),
    ]


def with_rule_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), forest: Forest | None = None) -> DataFrame:
    """The columns in `keep` and one long column for each of COUNTS and EXTRA; with a forest also the anomaly, in the same pass over the texts."""
    schema = docs.select(*keep).schema
    for c in (*COUNTS, *EXTRA):
        schema = schema.add(c, "long")
    known = None
    if forest is not None:
        schema, known = schema.add("anomaly", "double"), docs.sparkSession.sparkContext.broadcast(forest)

    def counted(batches):
        for batch in batches:
            rows = [rule_statistics(x) for (texts,) in slices([batch], "_text") for x in texts]
            table = np.array(rows, np.int64).reshape(len(rows), len(COUNTS) + len(EXTRA))
            more = [] if known is None else [pa.array(_anomalies(known.value, dict(zip((*COUNTS, *EXTRA), table.T, strict=True))))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *map(pa.array, table.T), *more], names=schema.names)

    return by_bytes(docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))).mapInArrow(counted, schema)


def _rates(columns: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: rates, so that neither long nor short texts are odd for their length alone."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    marks = c["n_upper"] + c["n_symbols"] + c["n_bangs"]
    repeated = np.maximum(c["n_dup_lines"] / words, ODD_LINES)
    return np.stack([chars / words, c["n_symbols"] / words, c["n_symbols"] / chars, c["n_repeat_words"] / words, c["n_upper"] / chars, marks / chars, c["n_bangs"] / words, repeated], axis=1)


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: a node's feature (-1: leaf), split, left child, and for a leaf its path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    tree_rows: int


def _expected(n: float) -> float:
    """Mean path length of a failed search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int, tree_rows: int, seed: int = 6) -> Forest:
    rng = np.random.default_rng(seed)
    deep = max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))
    size = 2 ** (deep + 1)
    feature, split, left, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), int), np.zeros((trees, size))
    for t in range(trees):
        todo, used = [(0, 0, rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)])], 1
        while todo:
            node, depth, own = todo.pop()
            low, high = own.min(0), own.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= deep or len(own) < 2 or not len(wide):
                length[t, node] = depth + _expected(len(own))
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node], left[t, node] = f, at, used
            todo += [(used, depth + 1, own[own[:, f] < at]), (used + 1, depth + 1, own[own[:, f] >= at])]
            used += 2
    return Forest(feature, split, left, length, min(tree_rows, len(rows)))


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """2^(-mean path length / expected length): near 1 for what random splits isolate at once."""
    total = np.zeros(len(rows))
    at = np.arange(len(rows))
    for feature, split, left, length in zip(forest.feature, forest.split, forest.left, forest.length, strict=True):
        node = np.zeros(len(rows), int)
        while (inner := feature[node] >= 0).any():
            f = np.where(inner, feature[node], 0)
            node = np.where(inner, left[node] + (rows[at, f] >= split[node]), node)
        total += length[node]
    return 2.0 ** (-total / len(forest.feature) / max(_expected(forest.tree_rows), 1e-9))


def _anomalies(forest: Forest, columns: dict[str, np.ndarray]) -> np.ndarray:
    rows = _rates(columns)
    return np.concatenate([anomaly(forest, rows[k : k + 1024]) for k in range(0, len(rows), 1024)] or [np.zeros(0)])


def fit_forest(stats: DataFrame, trees: int = 100, tree_rows: int = 256) -> Forest | None:
    """Grow the forest on trees x tree_rows documents, in the order of a hash of their statistics and id."""
    names = [*COUNTS, *EXTRA]
    got = hash_sample(stats.where("n_words > 0").select("doc_id", *names), trees * tree_rows, "doc_id", *names).toPandas()
    return None if got.empty else grow(_rates({c: got[c].to_numpy() for c in names}), trees, tree_rows)


def with_anomaly(stats: DataFrame, forest: Forest | None) -> DataFrame:
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))
    known = stats.sparkSession.sparkContext.broadcast(forest)
    schema = StructType([*stats.schema, StructField("anomaly", DoubleType())])

    def scored(batches):
        for batch in batches:
            found = _anomalies(known.value, {c: batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*COUNTS, *EXTRA)})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=schema.names)

    return stats.mapInArrow(scored, schema)


def calibrate(scored: DataFrame, labels: DataFrame, label: str = "quality", most_good: float = 0.003, steps: int = BINS_OF_SCORE) -> float:
    """The anomaly from which documents go: of the scores 0..1 in `steps` bins, counted over all labelled rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_low"), F.max(label).alias("_label")).where("_low = _label")
    bins = scored.where("not base_failed").join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * steps).alias("bin"), "_label").count().toPandas()  # 2 x steps rows at most
    counts = np.zeros((2, steps + 2))
    for b, y, n in bins.itertuples(index=False):
        counts[int(y), int(b)] += n
    if not counts.sum(1).all():
        return 2.0
    bad, good = (c[::-1].cumsum()[::-1] / c.sum() for c in counts)  # shares at or above each bin
    gain = np.where(good <= most_good, bad - good, -1)
    return float(np.flatnonzero(gain == gain.max())[-1]) / steps if gain.max() > 0 else 2.0


def _judged(docs: DataFrame, text: str, keep: tuple[str, ...], forest: Forest | None = None) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_rule_statistics(docs, text, keep, forest).withColumn("base_failed", failed)


def _passes(limit: float):
    return ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS_OF_SCORE) < round(limit * BINS_OF_SCORE))


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), trees: int = 100, tree_rows: int = 256, most_good: float = 0.003) -> DataFrame:
    """`keep` (with doc_id), the rule statistics, base_failed, the anomaly and kept."""
    stats = stored(_judged(docs, text, keep), "rule-statistics")
    scored = stored(with_anomaly(stats, fit_forest(stats, trees, tree_rows)), "rule-scores")
    return scored.withColumn("kept", _passes(calibrate(scored, labels, most_good=most_good)))


def kept_by_rules(docs: DataFrame, labels: DataFrame, text: str = "text", trees: int = 100, tree_rows: int = 256, most_good: float = 0.003) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    stats = stored(_judged(docs, text, ("doc_id",)), "rule-statistics")
    forest = fit_forest(stats, trees, tree_rows)
    limit = calibrate(with_anomaly(stats.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), forest), labels, most_good=most_good)
    rows = docs.select(F.struct(*docs.columns).alias("row"), text)  # so that no column of docs meets one of ours
    judged = _judged(rows, text, ("row",), forest)  # without a forest no row is odd
    return (judged if forest is not None else judged.withColumn("anomaly", F.lit(0.0))).where(_passes(limit)).select("row.*")
