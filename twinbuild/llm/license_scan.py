"""License scans: a positional index of licence templates, looked up by each file's rarest licence words.

Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. Spark counts in how
many documents every licence word occurs; that gives each word its IDF. The index holds, for every word of
the templates, where it stands (template, position); it is broadcast, and its size is that of the template
set, not of the corpus. Templates of whose IDF weight a file has less than `share` are out at once. For the
others the file looks its licence words up by falling IDF, until each template has had `rarest` of them. The
postings of those words are intersected by relative position: a start (place in the file less place in the
template) stays if words looked up that hold `agree` of their IDF or more stand at it, give or take the
template's slack (some may be missing from a copy and stand elsewhere in the file). What is left is verified on the text: the IDF weight of all words of the template that
stand in their place must reach `share`, and the template's mandatory key phrases must stand in the stretch.

Plain phrases with labels are found beside, wherever their words stand consecutively.

Defined cases: a null or empty text has no words, places or labels; repeated rows are answered each;
other columns are ignored; a word that no document has gets the highest IDF; of starts of one template
that are less than half its length apart, the best one counts (the first of equals).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, slices
from twinbuild.llm.license_texts import TEMPLATES

_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that name a licence, and its label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text: bytes) -> list[bytes]:
    return _word.findall(text.lower())


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the phrase."""
    found, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return found
        if words[at : at + n] == phrase:
            found.append(at)


@dataclass(frozen=True)
class Index:
    templates: list[tuple[str, list[bytes], list[list[bytes]]]]  # label, words, key phrases
    postings: dict[bytes, list[tuple[int, list[int]]]]  # of each word: template, its positions there
    idf: dict[bytes, float]
    weights: list[float]  # of each template: the IDF of all its words
    phrases: list[tuple[list[bytes], str]]


def build_index(document_counts: dict[bytes, int], documents: int, templates=TEMPLATES, phrases=PHRASES) -> Index:
    known, postings = [], defaultdict(dict)
    for k, t in enumerate(templates):
        words = words_of(t.text.encode())
        for at, w in enumerate(words):
            postings[w].setdefault(k, []).append(at)
        known.append((t.label, words, [words_of(p.encode()) for p in t.phrases]))
    idf = {w: math.log((documents + 1) / (document_counts.get(w, 0) + 1)) + 1e-3 for w in postings}
    return Index(known, {w: list(x.items()) for w, x in postings.items()}, idf, [sum(idf[w] for w in words) for _, words, _ in known], [(words_of(p.encode()), label) for p, label in phrases.items()])


def slack(template_words: int) -> int:
    """Words that may be missing or put in before a word of a match."""
    return 2 + template_words // 20


def _near(places: list[int], at: int, within: int) -> bool:
    k = bisect_left(places, at - within)
    return k < len(places) and places[k] <= at + within


def held_share(index: Index, k: int, where: dict[bytes, list[int]], start: int) -> float:
    """The IDF weight of template k's words that stand in their place from `start` on, over that of all its words."""
    words = index.templates[k][1]
    within = slack(len(words))
    held = sum(index.idf[w] for at, w in enumerate(words) if w in where and _near(where[w], start + at, within))
    return held / index.weights[k]


def candidate_starts(index: Index, likely: set[int], where: dict[bytes, list[int]], agree: float, rarest: int) -> dict[int, list[int]]:
    """By template, the starts at which the postings of the file's rarest licence words meet."""
    looked: dict[int, list[tuple[bytes, list[int]]]] = {k: [] for k in likely}
    for w in sorted(where, key=lambda w: (-index.idf[w], w)):
        for k, at in index.postings[w]:
            if k in looked and len(looked[k]) < rarest:
                looked[k].append((w, at))
    out = {}
    for k, own in looked.items():
        within = slack(len(index.templates[k][1]))
        starts = [(w, sorted({place - p for p in at for place in where[w]})) for w, at in own]
        total, found = sum(index.idf[w] for w, _ in own), []
        missed = 0.0
        for nth, (w, here) in enumerate(starts):  # a match has one of the first words, or it misses too much of the weight
            if missed > (1 - agree) * total:
                break
            for x in here:
                if sum(index.idf[v] for v, there in starts[nth:] if _near(there, x, within)) >= agree * total:
                    found.append(x)
            missed += index.idf[w]
        if found:
            out[k] = sorted(set(found))
    return out


def matches(index: Index, words: list[bytes], share: float = 0.7, agree: float = 0.4, rarest: int = 8) -> list[tuple[str, int, int, float]]:
    """(label, first word, words, share of the weight) of every template match."""
    weight: dict[int, float] = defaultdict(float)
    for w in index.idf.keys() & set(words):
        for k, at in index.postings[w]:
            weight[k] += index.idf[w] * len(at)
    likely = {k for k, x in weight.items() if x >= (share - 1e-9) * index.weights[k]}
    if not likely:
        return []
    of_likely = {w for k in likely for w in index.templates[k][1]}
    where: dict[bytes, list[int]] = defaultdict(list)
    for at, w in enumerate(words):
        if w in of_likely:
            where[w].append(at)
    found = []
    for k, starts in candidate_starts(index, likely, where, agree, rarest).items():
        label, own, phrases = index.templates[k]
        verified = []
        for start in starts:
            score = held_share(index, k, where, start)
            stretch = words[max(start, 0) : max(start + len(own) + slack(len(own)), 0)]
            if score >= share and all(places(stretch, p) for p in phrases):
                verified.append((start, score))
        taken: list[int] = []  # starts, in order: only the neighbours of a place can be too near
        for start, score in sorted(verified, key=lambda x: (-x[1], x[0])):
            at = bisect_left(taken, start)
            if all(2 * abs(start - other) >= len(own) for other in taken[max(at - 1, 0) : at + 1]):
                taken.insert(at, start)
                found.append((k, start, score))
    return [(index.templates[k][0], max(start, 0), len(index.templates[k][1]), score) for k, start, score in sorted(found)]


def licence_counts(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs (at most as many rows as the templates have words), and of how many."""
    vocabulary = {w for t in templates for w in words_of(t.text.encode())}

    def counted(batches):
        total = Counter()
        for (texts,) in slices(batches, "_text"):
            for x in texts:
                total.update(vocabulary.intersection(words_of(x)))
            total[b""] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = _texts(docs, text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def _texts(docs: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return by_bytes(docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text")))


MATCH = "array<struct<label:string,first_word:bigint,n_words:bigint,score:double>>"


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """`keep`, n_words, phrase_places (label and start of every phrase) and matches (of the templates)."""
    counts, documents = licence_counts(docs, text, templates)
    known = docs.sparkSession.sparkContext.broadcast(build_index(counts, documents, templates, phrases))
    schema = docs.select(*keep).schema.add("n_words", "long")
    place = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
    match = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", phrase_places array<struct<label:string,first_word:bigint>>, matches {MATCH}"

    def scanned(batches):
        index = known.value
        keys = {p[0] for p, _ in index.phrases}
        for batch in batches:
            sizes, base, other = [], [], []
            for (texts,) in slices([batch], "_text"):
                for x in texts:
                    words = words_of(x)
                    here = keys.intersection(words)
                    sizes.append(len(words))
                    base.append([{"label": label, "first_word": at} for p, label in index.phrases if p[0] in here for at in places(words, p)])
                    other.append([dict(zip(("label", "first_word", "n_words", "score"), m, strict=True)) for m in matches(index, words)])
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(base, place), pa.array(other, match)], names=[*keep, "n_words", "phrase_places", "matches"])

    return _texts(docs, text, keep).mapInArrow(scanned, ddl)


def license_digest(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, first and last place, label lists and a score for each file."""
    starts, labels = F.col("phrase_places.first_word"), F.col("phrase_places.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0))
    return scanned.select(
        *keep, "n_words", F.size("phrase_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.col("matches.label"))).alias("labels"),
        F.when(F.size("phrase_places") > 0, 1.0).otherwise(best).alias("score"),
    )
