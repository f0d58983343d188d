"""Token counts: count-only Viterbi segmentation under a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; dynamic
programming carries the best score and its number of pieces, no piece list. The rules are those of the
public unigram tokenizer: a text is cut before every blank, the blank becomes U+2581 and one stands
before a first word that has none; within a word scores are added as doubles from the left (a text's score is
the sum over its distinct words, each times its count); of equal scores the longer last piece
wins; a character that no one-character piece covers costs the lowest score less 10 and counts one token
for each byte of it.

Defined cases: a null or empty text has 0 tokens and score 0; repeated rows are answered each; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def piece_scores(model_file: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(known.id_to_piece(k), known.get_score(k)) for k in range(known.get_piece_size())]


class Counts:
    """Viterbi over one vocabulary; counts of words already seen are remembered, up to `remember` words while a task runs and `between` after it."""

    def __init__(self, vocabulary: list[tuple[str, float]], remember: int = 800_000, between: int = 200_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        joined = {c for piece, _ in vocabulary if len(piece) > 1 for c in piece}
        self.apart = "" if "\n" in joined else "\n"  # a character that no longer piece holds: the best path has a cut on either side of it
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.remember, self.between, self.seen, self.again = remember, between, {}, {}

    def forget(self) -> None:
        """At the end of a task: keep words that came again after the text that they were first in."""
        if len(self.seen) > self.between:
            self.seen, self.again = dict(islice(self.again.items(), self.between)), {}

    def word(self, text: str) -> tuple[int, float]:
        """Tokens and best score of one word (nothing for an empty one)."""
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) >= self.remember:
                self.seen, self.again = dict(self.again), {}
            found = self.seen[text] = self._viterbi(text)
        else:
            self.again[text] = found
        return found

    def _viterbi(self, text: str) -> tuple[int, float]:
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        at = next(ends, None)
        for end in range(1, n + 1):
            top, pieces, single = None, 0, False
            while at is not None and at[0] == end - 1:  # longest piece first, so only a better score replaces it
                size, score = at[1]
                total = best[end - size] + score
                if top is None or total > top:
                    top, pieces = total, count[end - size] + 1
                single = single or size == 1
                at = next(ends, None)
            if not single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
            best[end], count[end] = top, pieces
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Tokens and score of a whole text."""
        if not text:
            return 0, 0.0
        tokens, score = 0, 0.0
        text = text.replace(" ", MARK)
        words = (text if text[0] == MARK else MARK + text).replace(MARK, " " + MARK)[1:]
        if self.apart:
            words = words.replace(self.apart, f" {self.apart} ")
        for word, times in Counter(words.split(" ")).items():
            k, s = self.word(word)
            tokens += k * times
            score += s * times
        return tokens, score


_made: dict[int, Counts] = {}  # a worker keeps its automaton and words from task to task


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, n_tokens and viterbi_score; vocabulary is broadcast (its own size bounds it)."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("viterbi_score", "double")

    def counted(batches):
        key = hash(tuple(known.value))
        if key not in _made:
            _made.clear()
            _made[key] = Counts(known.value)
        counts = _made[key]
        for batch in batches:
            rows = [counts.text(x or "") for (texts,) in slices([batch], "_text") for x in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=schema.names)
        counts.forget()

    return by_bytes(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(counted, schema)
