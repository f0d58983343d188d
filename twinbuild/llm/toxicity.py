"""Toxicity: a weighted finite-state grammar of insults, threats, targets, negation and reported speech.

Words become symbols by a lexicon (insult, threat verb, intent, target, negation, report, other). Four
transducers read a clause's symbols one after the other, each rewriting what the one before wrote:

    threats    an intent and a threat verb, or a threat verb and a target, are a threat
    aims       an insult soon after a target is aimed at it
    negation   a match soon after a negation is negated
    reports    a match after a verb of speech is reported

They are composed into one machine before anything is read, so a clause takes one step a word. Its score is the sum of its
matches' weights by what became of them (plain, aimed, threat, negated, reported), and a document's comes from those sums,
from how dense they are, from its strongest clause and how many different words matched, through a logistic function.

What is learnt, all from labels: words and word beginnings (`réeux*`) that speak for label 1, with their weights (log odds,
shrunk), in addition to the word lists below, whose weights are replaced where they are seen often enough; and the weights of the
contexts, drawn to the defaults below. Context weights are fitted on texts read with words that were learnt from the other half.
The sample for that is bounded in rows (`sample_rows`), the words in number (`most_words`); every text is scored whole.

Defined cases: a null or empty text has no match and is scored as that; null or non 0/1 labels, and ids labelled
both ways, are not learnt from; of rows that share an id one is learnt from, whatever the order of rows; without labels of both
kinds the word lists and default weights score alone; repeated rows are scored each; columns not in `keep` are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, hash_sample, split_words, stored

# -- lexicon ------------------------------------------------------------------------------------------------------

WORDS = {
    "insult": """idiot idiots moron morons loser losers scum pathetic stupid worthless trash clown disgusting imbecile vermin filth
        dumb fool bastard
        idioten trottel dummkopf versager abschaum widerlich erbärmlich wertlos blödmann arschloch
        idiote imbécile crétin minable ordure débile pitoyable dégoûtant abruti connard
        idiota imbécil estúpido estúpida escoria basura patético asqueroso inútil payaso gilipollas""",
    "verb": """kill hurt beat stab shoot destroy burn hang strangle smash
        töten umbringen schlagen verprügeln erschießen vernichten
        tuer frapper détruire égorger brûler
        matar golpear destruir quemar""",
    "intent": "will gonna going shall i'll we'll should werde werden soll vais allons va doit voy vamos deberían",
    "target": """you your you're youre u ya yourself him her them they he she
        du dich dir ihr euch sie ihn tu te toi vous ils lui eux tú ti usted ustedes ellos él vosotros""",
    "not": "not no never isn't aren't don't won't nobody nicht kein keine nie niemals ne pas jamais non nunca jamás ni",
    "report": """said says say wrote writes called calls told claimed reported quoted
        sagte sagt schrieb nannte behauptete dit disait écrit appelé raconte dijo dice escribió llamó""",
}
SYMBOLS = ("other", *WORDS)
WEIGHT = 3.0  # of a listed word, where labels say nothing of it
TRIMMED = "".join(c for c in map(chr, range(33, 0x2100)) if unicodedata.category(c)[0] in "PS")
ENDS = ".!?;|"  # a word that ends with one ends its clause, and so does a line's end
BEGINNINGS = (4, 5, 6, 7)  # letters of learnt word beginnings
NO_WORD = 0

# -- transducers --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """States from 0 on; arcs by (state, symbol read): (next state, symbol written). Every state reads every symbol of its alphabet."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def run(self, symbols: list[str]) -> list[str]:
        state, out = 0, []
        for s in symbols:
            state, written = self.arcs[state, s]
            out.append(written)
        return out

    def written(self) -> set[str]:
        return {w for _, w in self.arcs.values()}


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that writes what `second` makes of what `first` writes."""
    reads = {s for _, s in first.arcs}
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        a, b = todo.pop()
        for s in reads:
            to_a, middle = first.arcs[a, s]
            to_b, out = second.arcs[b, middle]
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                todo.append((to_a, to_b))
            arcs[number[a, b], s] = number[to_a, to_b], out
    return Transducer(arcs)


def within(alphabet: set[str], trigger: str, words: int, rewrite) -> Transducer:
    """For `words` words after the trigger, what is read is rewritten; state k: so many words are left."""
    arcs = {}
    for k in range(words + 1):
        for s in alphabet:
            arcs[k, s] = (words, s) if s == trigger else (max(k - 1, 0), rewrite(s) if k else s)
    return Transducer(arcs)


def threats(alphabet: set[str], words: int = 3) -> Transducer:
    """An intent, then a threat verb within some words; or a threat verb, then a target.

    States 0: nothing; 1 to words: so many words are left for the verb; beyond: for the target.
    """
    arcs = {}
    for k in range(2 * words + 1):
        for s in alphabet:
            fewer = 0 if k in (0, 1, words + 1) else k - 1
            if s == "intent":
                arcs[k, s] = words, s
            elif s == "verb":
                arcs[k, s] = (0, "threat") if 1 <= k <= words else (2 * words, s)
            elif s == "target" and k > words:
                arcs[k, s] = 0, "target+threat"
            else:
                arcs[k, s] = fewer, s
    return Transducer(arcs)


MATCHES = ("insult", "aimed", "threat", "target+threat")
KINDS = ("plain", "aimed", "threat", "negated", "reported")


def grammar() -> Transducer:
    """threats, aims, negation and reports, composed."""
    first = threats(set(SYMBOLS))
    aims = within(first.written(), "target", 4, lambda s: "aimed" if s == "insult" else s)
    negation = within(aims.written(), "not", 3, lambda s: f"negated {s}" if s in MATCHES else s)
    # a report holds to the end of its clause: one state for it
    alphabet = negation.written()
    heard = {(1, s): (1, f"reported {s}" if s.removeprefix("negated ") in MATCHES else s) for s in alphabet}
    reports = Transducer({(0, s): (int(s == "report"), s) for s in alphabet} | heard)
    return compose(compose(compose(first, aims), negation), reports)


def kind_of(written: str) -> int:
    """Of a symbol that the grammar writes: its place in KINDS, or -1."""
    base = written.removeprefix("reported ").removeprefix("negated ")
    if base not in MATCHES:
        return -1
    if written.startswith("reported"):
        return KINDS.index("reported")
    if written.startswith("negated"):
        return KINDS.index("negated")
    return KINDS.index({"insult": "plain", "aimed": "aimed"}.get(base, "threat"))


def table(machine: Transducer) -> list[list[tuple[int, int]]]:
    """By state and symbol number: next state, and the kind of what is written there."""
    states = 1 + max(s for s, _ in machine.arcs)
    return [[(machine.arcs[k, s][0], kind_of(machine.arcs[k, s][1])) for s in SYMBOLS] for k in range(states)]


# -- words of a text ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """Entries (words and beginnings, `x*`) with a symbol and a weight each; entry 0 is no word."""

    entries: tuple[str, ...]
    symbols: np.ndarray
    weights: np.ndarray
    lengths: tuple[int, ...] = field(default=BEGINNINGS)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The entry of each word, the whole one before the longest beginning; 0 without."""
        whole = pa.array([e for e in self.entries], pa.string())
        got = pc.fill_null(pc.index_in(words, whole), NO_WORD).to_numpy(zero_copy_only=False).astype(np.int64)
        for k in sorted(self.lengths, reverse=True):
            if any(len(e) == k + 1 and e.endswith("*") for e in self.entries):
                begun = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "*", "")
                other = pc.fill_null(pc.index_in(begun, whole), NO_WORD).to_numpy(zero_copy_only=False)
                got = np.where((got == NO_WORD) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) > k), other, got)
        return got


def lexicon(learnt: dict[str, float]) -> Lexicon:
    """The listed words and the learnt ones; a weight that was learnt for a listed insult takes its place."""
    rows = {"": ("other", 0.0)}
    for symbol, words in WORDS.items():
        for w in words.split():
            rows.setdefault(w, (symbol, WEIGHT))
    for w, weight in learnt.items():
        if rows.get(w, ("insult",))[0] == "insult":
            rows[w] = ("insult", weight)
    return Lexicon(tuple(rows), np.array([SYMBOLS.index(s) for s, _ in rows.values()]), np.array([w for _, w in rows.values()]))


def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Distinct words with their marks, trimmed and in lower case; which one each word of the texts is; whether it ends a clause; words a text.

    A line's end stands as a word of its own, which is empty when trimmed.
    """
    flat, sizes = split_words(pc.replace_substring(texts, "\n", " . "), lower=False)
    coded = flat.dictionary_encode()
    raw = coded.dictionary
    ends = pc.match_substring_regex(raw, f"[{ENDS}][^\\pL\\pN]*$").to_numpy(zero_copy_only=False)
    return pc.utf8_trim(pc.utf8_lower(raw), TRIMMED), coded.indices.to_numpy().astype(np.int64), ends, sizes


FEATURES = (*KINDS, "density", "strongest", "different", "clauses")


def text_features(texts: pa.Array, known: Lexicon, steps: list[list[tuple[int, int]]]) -> np.ndarray:
    """A row of FEATURES for each text."""
    words, ids, ends, sizes = words_of(texts)
    out = np.zeros((len(sizes), len(FEATURES)))
    if not len(ids):
        return out
    entry = known.look_up(words)
    symbol = known.symbols[entry]
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    last = ends[ids] | np.append(text_of[1:] != text_of[:-1], True)
    clause = np.concatenate(([0], np.cumsum(last)[:-1]))
    hit = np.isin(symbol, [SYMBOLS.index("insult"), SYMBOLS.index("verb")])[ids]
    read = np.unique(clause[hit])
    begin = np.concatenate(([0], np.flatnonzero(last) + 1))
    spoken = np.bincount(text_of[(pc.utf8_length(words).to_numpy(zero_copy_only=False) > 0)[ids]], minlength=len(sizes))
    n_clauses = np.bincount(text_of[last], minlength=len(sizes))
    seen: dict[int, set[int]] = {}
    for c in read.tolist():
        at, to = int(begin[c]), int(begin[c + 1])
        of, state, total = int(text_of[at]), 0, 0.0
        own = entry[ids[at:to]]
        for e, s, weight in zip(own.tolist(), known.symbols[own].tolist(), known.weights[own].tolist(), strict=True):
            state, kind = steps[state][s]
            if kind >= 0:
                out[of, kind] += weight
                total += weight
                seen.setdefault(of, set()).add(e)
        if total:
            out[of, 6] = max(out[of, 6], total)
            out[of, 8] += 1
    total = out[:, :5].sum(1)
    out[:, 5] = 30 * total / (spoken + 30)
    for of, found in seen.items():
        out[of, 7] = len(found)
    out[:, 8] /= np.maximum(n_clauses, 1)
    out[:, :8] = np.log1p(out[:, :8])
    return out


# -- learning -----------------------------------------------------------------------------------------------------

DEFAULTS = np.array([0.6, 1.0, 1.2, 0.1, 0.2, 1.5, 0.3, 0.3, 0.5])  # of FEATURES
DEFAULT_BIAS = -3.0


@dataclass(frozen=True)
class ToxicityModel:
    words: Lexicon
    bias: float = DEFAULT_BIAS
    weights: np.ndarray = field(default_factory=lambda: DEFAULTS)


def forms(words: list[str]) -> set[str]:
    """The words and their beginnings."""
    out = set(words)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in out if len(w) > k and not w.endswith("*")])
    out.discard("")
    return out


def word_weights(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: float = 18.0, prior: float = 3.0, most: int = 20_000) -> dict[str, float]:
    """Shrunk log odds of the words that clearly speak for label 1, by the likelihood ratio of their document counts, and of listed insults."""
    if not toxic or not clean:
        return {}
    share, listed, found = toxic / (toxic + clean), set(WORDS["insult"].split()), []
    term = lambda n, of: n * log(n / of) if n else 0.0
    for w, (a, b) in counts.items():
        odds = log((a + prior * share) / (b + prior * (1 - share)) * clean / toxic)
        sure = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))
        if w in listed and a + b >= 10 or odds >= 1 and sure >= least:
            found.append((-sure, w, min(max(odds, 0.0), 4.0)))
    return {w: odds for _, w, odds in sorted(found)[:most]}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, the weights drawn to the defaults."""
    design = np.column_stack([np.ones(len(x)), x])
    start = np.concatenate(([DEFAULT_BIAS], DEFAULTS))
    penalty = np.diag(np.concatenate(([1e-3], np.full(x.shape[1], ridge))))
    w = start.copy()

    def loss(v):
        margin = np.clip(design @ v, -500, 500)
        return np.logaddexp(0, margin).sum() - y @ margin + 0.5 * (v - start) @ penalty @ (v - start)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        slope = design.T @ (p - y) + penalty @ (w - start)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def _sample(docs: DataFrame, labels: DataFrame, usable: Column | None, text: str, label: str, sample_rows: int) -> DataFrame:
    """Stored rows (id, label, half, text): labelled documents, at most sample_rows, one for each id."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if usable is None else usable))
        .groupBy("doc_id").agg(F.min(label).alias("_low"), F.max(label).alias("_label")).where("_low = _label")
        .select(F.col("doc_id").alias("_id"), "_label")
    )
    chosen = hash_sample(chosen, sample_rows, "_id")
    own = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = own.join(F.broadcast(chosen), own["doc_id"] == chosen["_id"])  # at most sample_rows pairs of numbers
    one = rows.groupBy(F.col("_id").alias("id"), F.col("_label").alias("label")).agg(F.min(F.struct(F.xxhash64("_text").alias("at"), F.col("_text").alias("text"))).alias("x"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("half")
    return stored(one.select("id", "label", half, F.col("x.text").alias("text")), "toxicity-sample")


def _counted(rows: DataFrame, allowed: set[str] | None) -> DataFrame:
    """(form, half, n): in how many texts of rows a form stands; only those allowed, if any are given."""
    known = None if allowed is None else rows.sparkSession.sparkContext.broadcast(allowed)

    def count(batches):
        total: dict[tuple[int, str], int] = Counter()
        for batch in batches:
            words, ids, _, sizes = words_of(batch.column(0))
            names, at = words.to_pylist(), np.concatenate(([0], np.cumsum(sizes)))
            for k, half in enumerate(batch.column(1).to_pylist()):
                found = forms([names[i] for i in np.unique(ids[at[k] : at[k + 1]])])
                total.update((half, f) for f in (found if known is None else found & known.value))
            if len(total) > 500_000:
                yield _pairs(total)
                total = Counter()
        yield _pairs(total)

    return by_bytes(rows.select("text", "half")).mapInArrow(count, "form string, half int, n long").groupBy("form", "half").agg(F.sum("n").alias("n"))


def _pairs(total: dict[tuple[int, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f for _, f in total], pa.string()), pa.array([h for h, _ in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["form", "half", "n"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, text: str = "text", label: str = "toxic", sample_rows: int = 12_000, most_words: int = 20_000, most_candidates: int = 200_000) -> ToxicityModel:
    """Learn words and weights from at most sample_rows labelled documents whose id passes `usable`.

    Words are tried that stand in three texts of label 1 or more, at most `most_candidates`, the more frequent first.
    """
    sample = _sample(docs, labels, usable, text, label, sample_rows)
    sizes = {(r["label"], r["half"]): r["n"] for r in sample.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return ToxicityModel(lexicon({}))
    toxic = stored(_counted(sample.where("label = 1"), None), "toxicity-words")
    listed = set(WORDS["insult"].split())
    often = toxic.groupBy("form").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "form").limit(most_candidates)
    tried = {r["form"] for r in often.collect()} | listed
    counts: list[dict[str, list[int]]] = [{}, {}]
    for y, rows in ((0, toxic), (1, _counted(sample.where("label = 0"), tried))):
        for r in rows.toLocalIterator():
            if r["form"] in tried:
                counts[r["half"]].setdefault(r["form"], [0, 0])[y] += r["n"]
    whole: dict[str, list[int]] = {}
    for half in counts:
        for w, (a, b) in half.items():
            own = whole.setdefault(w, [0, 0])
            own[0] += a
            own[1] += b
    n = lambda y, half: sizes.get((y, half), 0)
    by_half = [lexicon(word_weights(counts[1 - h], n(1, 1 - h), n(0, 1 - h), most=most_words)) for h in (0, 1)]
    known, steps = sample.sparkSession.sparkContext.broadcast(by_half), table(grammar())

    def features(batches):
        for batch in batches:
            half = batch.column(2).to_numpy()
            both = [text_features(batch.column(0), words, steps) for words in known.value]
            rows = np.where((half == 0)[:, None], *both)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "id", "x"])

    got = by_bytes(sample.select("text", "label", "half", "id")).mapInArrow(features, "label int, id long, x array<double>").orderBy("id").toPandas()  # numbers of at most sample_rows rows
    bias, weights = fit_weights(np.array(got["x"].tolist()), got["label"].to_numpy(float))
    return ToxicityModel(lexicon(word_weights(whole, n(1, 0) + n(1, 1), n(0, 0) + n(0, 1), most=most_words)), bias, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), whole: bool = False) -> DataFrame:
    """`keep` (columns of other names than these) and score; with `whole` the features too, as an array in the order of FEATURES."""
    known, steps = docs.sparkSession.sparkContext.broadcast(model), table(grammar())
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "score double", *(["features array<double>"] if whole else [])])

    def scored(batches):
        m = known.value
        for batch in batches:
            x = text_features(batch.column(batch.schema.get_field_index("_text")), m.words, steps)
            score = 1 / (1 + np.exp(-np.clip(m.bias + x @ m.weights, -30, 30)))
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            more = [pa.array(list(x), pa.list_(pa.float64()))] if whole else []
            yield pa.RecordBatch.from_arrays([*own, pa.array(score), *more], names=[*keep, "score", *(["features"] if whole else [])])

    return by_bytes(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))).mapInArrow(scored, ddl)
