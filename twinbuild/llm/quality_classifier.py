"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which is linear in
the number of features that a document has (Rendle 2010).

The model is fitted on a bounded sample of labelled rows (`sample_rows`, in the order of a hash of the
id), which the driver holds as one block of numbers; every document is scored, on its whole text.

Defined cases: a null or empty text has the structure features of an empty text and is scored like any
other; null or non 0/1 labels, and ids labelled both ways, are not learnt from; of rows that share an id one
is learnt from, whatever the order of rows; repeated rows are scored each; other columns are ignored; without usable labels every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, hash_sample, slices, stored

WORD_BUCKETS = 1 << 16
BINS = 16
STATS = ("bytes", "upper", "digit", "symbol", "stop", "bang", "bar", "lines", "space", "word_length", "distinct", "repeated_lines", "top_word")
_CLASSES = np.zeros((256, 7))
for _k, _chars in enumerate((bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>@~^_=+{}[]\\/", b".,;:?", b"!", b"|", b" \t\n\r\v\f")):
    _CLASSES[list(_chars), _k] = 1


@dataclass(frozen=True)
class QualityModel:
    """edges: bin edges of each statistic; bias, linear and factors: the machine's parameters."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the distinct words, their values (of Euclidean length 1), and the structure statistics."""
    words = Counter(text.lower().split())
    ids = np.fromiter(map(crc32, words), np.int64, len(words)) % WORD_BUCKETS
    values = np.log1p(np.fromiter(words.values(), np.float64, len(words)))
    values /= max(np.sqrt((values * values).sum()), 1e-9)
    n, total = max(len(text), 1), max(sum(words.values()), 1)
    upper, digit, symbol, stop, bang, bar, space = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return ids, values, [
        np.log1p(len(text)), upper, digit, symbol, stop, bang, bar, len(lines) / total, space, n * (1 - space) / total,
        len(words) / total, 1 - len(set(lines)) / max(len(lines), 1), max(words.values(), default=0) / total,
    ]


def _bucketed(edges: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """The feature id of each statistic's bin; -1 where the statistic is missing."""
    ids = np.stack([np.searchsorted(e, x, side="right") for e, x in zip(edges, stats.T, strict=True)], axis=1)
    ids += WORD_BUCKETS + BINS * np.arange(stats.shape[1])
    return np.where(np.isnan(stats), -1, ids)


@dataclass(frozen=True)
class Sample:
    """Features of all sampled rows in one block: row k has words[starts[k]:starts[k + 1]], values alike, and stats[k]."""

    words: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    stats: np.ndarray

    def __len__(self) -> int:
        return len(self.stats)

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here = slice(self.starts[k], self.starts[k + 1])
        return self.words[here], self.values[here], self.stats[k]


def gathered(parts) -> tuple[Sample, np.ndarray]:
    """The sample in the order of its ids, and its labels; parts are (id, label, words, values, stats), words and values as bytes."""
    ids, labels, sizes, stats, words, values = [], [], [], [], bytearray(), bytearray()
    for k, y, w, v, s in parts:
        ids.append(k)
        labels.append(y)
        sizes.append(len(w) // 4)
        stats.append(np.array(s, np.float64))
        words += w
        values += v
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return Sample(np.frombuffer(words, np.int32), np.frombuffer(values, np.float32), starts, np.array(stats)), np.array(labels, float)


def _joined(edges: np.ndarray, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values and row starts of a batch; each row has a statistic at least, so none is without features."""
    bins = _bucketed(edges, np.array([s for _, _, s in rows], float))
    ids, values, sizes = [], [], []
    for (words, x, _), b in zip(rows, bins, strict=True):
        b = b[b >= 0]
        ids += [words, b]
        values += [x, np.full(len(b), 0.5)]
        sizes.append(len(words) + len(b))
    return np.concatenate(ids), np.concatenate(values), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def _margin(m: QualityModel, ids, values, starts):
    xv = m.factors[ids] * values[:, None]
    sums = np.add.reduceat(xv, starts)
    pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((xv * xv).sum(1), starts))
    return m.bias + np.add.reduceat(m.linear[ids] * values, starts) + pairs, sums


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def train(sample: Sample, labels: np.ndarray, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> QualityModel:
    """Adagrad on the log loss over the sampled rows."""
    stats = sample.stats
    at = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.stack([np.quantile(x[~np.isnan(x)], at) if (~np.isnan(x)).any() else np.zeros(BINS - 1) for x in stats.T])
    size = WORD_BUCKETS + BINS * stats.shape[1]
    rng = np.random.default_rng(seed)
    p = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    m = QualityModel(edges, float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    seen_w, seen_v = np.full(size, 1e-2), np.full((size, rank), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), 128):
            take = order[at : at + 128]
            ids, values, starts = _joined(edges, [sample.row(i) for i in take])
            margin, sums = _margin(m, ids, values, starts)
            error = np.repeat(_probability(margin) - labels[take], np.diff(np.append(starts, len(ids))))
            of = np.repeat(np.arange(len(take)), np.diff(np.append(starts, len(ids))))
            g_w = error * values
            g_v = g_w[:, None] * (sums[of] - m.factors[ids] * values[:, None])
            by = np.argsort(ids, kind="stable")
            unique, first = np.unique(ids[by], return_index=True)
            g_w = np.add.reduceat(g_w[by], first) + decay * m.linear[unique]
            g_v = np.add.reduceat(g_v[by], first) + decay * m.factors[unique]
            seen_w[unique] += g_w * g_w
            seen_v[unique] += g_v * g_v
            m.linear[unique] -= rate * g_w / np.sqrt(seen_w[unique])
            m.factors[unique] -= 0.5 * rate * g_v / np.sqrt(seen_v[unique])
    return m


def _prepared(docs: DataFrame, text: str, metadata: list[str], keep: list[Column]) -> DataFrame:
    numbers = [F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in metadata]
    return by_bytes(docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"), F.array(*numbers).cast("array<double>").alias("_meta")))


def _nan(values) -> list[float]:
    return [float("nan") if x is None else x for x in values]


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), sample_rows: int = 12_000) -> QualityModel | None:
    """Fit on at most sample_rows labelled documents whose id passes `usable`; None without two classes."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
        .groupBy("doc_id").agg(F.min(label).alias("_low"), F.max(label).alias("_label")).where("_low = _label")
        .select(F.col("doc_id").alias("_labelled"), "_label")
    )
    chosen = hash_sample(chosen, sample_rows, "_labelled")
    own = docs.select("doc_id", *dict.fromkeys((text, *metadata)))  # so that no other column of docs meets one of ours
    rows = own.join(F.broadcast(chosen), own["doc_id"] == chosen["_labelled"])  # at most sample_rows pairs of numbers

    def features(batches):
        for texts, meta, ids, y, at in slices(batches, "_text", "_meta", "_labelled", "_label", "_at"):
            found = [text_features(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(y, pa.int32()), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for f in found], pa.binary()), pa.array([f[2] + _nan(x) for f, x in zip(found, meta, strict=True)], pa.list_(pa.float64()))],
                names=["id", "at", "label", "words", "values", "stats"],
            )

    keep = [F.col("_labelled"), F.col("_label"), F.xxhash64(text, *metadata).alias("_at")]
    got = _prepared(rows, text, list(metadata), keep).mapInArrow(features, "id long, at long, label int, words binary, values binary, stats array<double>")
    one = got.groupBy("id").agg(F.min(F.struct("at", "label", "words", "values", "stats")).alias("x")).select("id", "x.label", "x.words", "x.values", "x.stats")  # of rows that share an id, the same one always
    sample, y = gathered(stored(one, "quality-sample").orderBy("id").toLocalIterator())  # a part at a time
    return train(sample, y) if len(set(y.tolist())) == 2 else None


def score_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", metadata: tuple[str, ...] = (), keep: tuple[str, ...] = ("doc_id",), score: str = "score") -> DataFrame:
    """The columns in `keep`, and the probability that the label is 1."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias(score))
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema

    def scored(batches):
        for batch in batches:
            out = []
            for texts, meta in slices([batch], "_text", "_meta"):
                rows = [(i, v, s + _nan(x)) for (i, v, s), x in zip(map(text_features, texts), meta, strict=True)]
                out.append(_probability(_margin(known.value, *_joined(known.value.edges, rows))[0]))
            if out:
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.concatenate(out))], names=[*keep, score])

    return _prepared(docs, text, list(metadata), [F.col(c) for c in keep]).mapInArrow(scored, schema.add(score, "double"))


def kept_by_quality(docs: DataFrame, model: QualityModel | None, least: float = 0.5, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs that score `least` or more, with their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), text, *metadata)  # so that no column of docs meets one of ours
    return score_quality(rows, model, text, metadata, ("row",)).where(F.col("score") >= least).select("row.*")
