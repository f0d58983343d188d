"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is a Spark aggregation of (language, bucket) over every training document; the resulting
log-probability matrix (languages x buckets) is broadcast and documents are scored in batches.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text when nothing
could be learnt (`½` and `²` are no letters); null languages are not learnt from; ties go to the first
language in name order; repeated rows are answered each; other columns are ignored; more than
`most_languages` languages are an error, since the matrix is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, slices, stored

UNDETERMINED = "und"
_word = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits
_odd = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray
    bits: int
    orders: tuple[int, ...]


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's letter categories."""
    return any(map(str.isalpha, (c for m in _word.finditer(text) for c in m.group())))


def gram_slices(text: str, bits: int, orders: tuple[int, ...], at_once: int = 1 << 17) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text, padded with one blank on each side, `at_once` starts at a time.

    So a very long text is never held decoded as a whole; a slice reaches over its end by as much as its n-grams do.
    """
    padded = f" {text.lower()} "
    for first in range(0, len(padded), at_once):
        chars = np.frombuffer(padded[first : first + at_once + max(orders) - 1].encode("utf-32-le", "replace"), np.uint32)
        out = []
        for n in orders:
            own = chars[: at_once + n - 1]
            if len(own) >= n:
                h = np.full(len(own) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ own[k : len(own) - n + 1 + k]) * _odd[k % 3]
                    h ^= h >> np.uint32(15)
                out.append(h >> np.uint32(32 - bits))
        if out:
            yield np.concatenate(out)


def hashed_ngrams(text: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """All of them, order by order within a slice."""
    return np.concatenate([np.zeros(0, np.uint32), *gram_slices(text, bits, orders)])


def ngram_counts(text: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """How many n-grams of the text each bucket has."""
    counts = None
    for grams in gram_slices(text, bits, orders):
        own = np.bincount(grams, minlength=1 << bits)
        counts = own if counts is None else counts + own
    return np.zeros(1 << bits, np.int64) if counts is None else counts


def fit_language(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", bits: int = 15, orders: tuple[int, ...] = (1, 2, 3), alpha: float = 0.5, most_languages: int = 400) -> LanguageModel | None:
    """Count n-grams over all documents that pass `usable` and have text and language."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.lit(True) if usable is None else usable)).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def counted(batches, at_once=1 << 18):
        table: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def count(x: str) -> None:
            if grams := waiting.pop(x, None):
                table[x] += np.bincount(np.concatenate(grams), minlength=1 << bits)

        for texts, langs in slices(batches, "text", "lang", rows=128):
            for x in set(langs):
                table.setdefault(x, np.zeros(1 << bits, np.int64))
                size = 0
                for t in (t for t, y in zip(texts, langs, strict=True) if y == x):
                    documents[x] = documents.get(x, 0) + 1
                    for grams in gram_slices(t, bits, orders):
                        waiting.setdefault(x, []).append(grams)
                        size += len(grams)
                        if size > at_once:
                            count(x)
                            size = 0
                count(x)
        for x, counts in table.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[at], documents[x]))], names=["lang", "bucket", "n"])

    sums = stored(by_bytes(rows).mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    if (found := sums.where("bucket = -1").count()) > most_languages:
        raise ValueError(f"{found} languages; at most {most_languages} fit the matrix that tasks hold")
    if not found:
        return None
    lists = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).orderBy("lang")  # as long as there are buckets
    got = lists.select("lang", F.col("c.bucket").alias("buckets"), F.col("c.n").alias("ns")).toArrow()  # a row a language, as numbers, however many documents there are
    languages = got.column("lang").to_pylist()
    counts = np.full((1 << bits, len(languages)), alpha)
    prior = np.zeros(len(languages))
    for k in range(len(languages)):
        at, n = (got.column(c)[k].values.to_numpy() for c in ("buckets", "ns"))
        prior[k] = n[at < 0].sum()
        counts[at[at >= 0], k] += n[at >= 0]
    return LanguageModel(languages, np.log(counts / counts.sum(0)).astype(np.float32), np.log(prior / prior.sum()), bits, orders)


def predict_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred, and its posterior probability per root of the n-gram count (0 to 1)."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        m = known.value
        for batch in batches:
            names, scores = [], []
            for (texts,) in slices([batch], "_text", rows=128):
                for x in texts:
                    if x is None or not has_letter(x):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    counts = ngram_counts(x, m.bits, m.orders)
                    at = np.flatnonzero(counts)
                    total = counts[at].astype(np.float32) @ m.log_prob[at] + m.log_prior
                    best = int(np.argmax(total))
                    names.append(m.languages[best])
                    scores.append(float(1 / np.exp((total - total[best]) / np.sqrt(counts[at].sum())).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return by_bytes(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(predicted, schema)
