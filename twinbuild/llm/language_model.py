"""LM scoring: a gated recurrent language model with class-factored output, trained and run inside tasks.

Spark counts every token of the training documents; those counts give the vocabulary, the base score, the
output classes and the share of rare words, so what is gathered and what the network learns from grow with
the corpus. The network has its own word for each of the most frequent tokens, as many as make up `coverage`
of all occurrences (`most_words` bounds the size of the network, and so of what is broadcast). They are split
by rank into about the root of their number of classes, each with the same sum of roots of counts (classes of
frequent words are small). All other tokens fall into `tails` classes by a hash of their last two bytes. The
classes are factored once more, into the root of their number of groups. The network (numpy) has one gated
recurrent layer:

    p(class | state) = p(group | state) * p(class | group, state)
    p(token) = p(class | state) * p(token | class, state)   for frequent tokens
    p(token) = p(class | state) * (c + 1) / (N_k + V_k + 1)  for the others, from the counts of tail class k

Texts become token ids once, in a stored table that both training and scoring read. Training is truncated
backpropagation: each task runs its documents side by side in lanes, in windows whose state carries over
(where few long documents are left, windows are longer), and ends with its own parameters; Spark averages
them, in two levels of about the root of their number, and the next round goes on from there with other
documents. Each training document is used in one round; a task trains on about `trainer_tokens`, so the
networks that are sent grow with the corpus, not with Spark's partitions. Scoring carries the state over the
windows of a document from its first token to its last; a task scores the texts of some batches together, so
that few steps serve long texts alone.

The counts of very frequent tokens (`held_counts`) are broadcast; the others are joined to the documents'
rare tokens by a shuffle.

Defined cases: a null or empty text is its end token alone; without training documents every count is 0 and
the network is the untrained one; repeated rows are answered each; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace
from functools import cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, hash_sample, split_words, stored

END = b""  # no word is empty
WIDER = 8  # windows of scoring, which depends on their size in time only
LOG10 = np.log(10.0)
AT_ONCE = 1 << 17  # logits


@dataclass(frozen=True)
class Shape:
    """words, classes: 0 is for as many as the counts ask for; starts: each class's first word, in equal steps if not given."""

    words: int = 0
    classes: int = 0
    coverage: float = 0.8
    tails: int = 16
    state: int = 16
    lanes: int = 512
    window: int = 16
    rounds: int = 3
    rate: float = 0.12
    held_counts: int = 300_000
    most_words: int = 1 << 18
    trainer_tokens: int = 4_000_000
    starts: tuple[int, ...] = ()

    def fitted(self, corpus: Corpus) -> Shape:
        """The shape with words and classes for these counts; one that names both stays as it is."""
        if self.words and self.classes:
            return self
        words = self.words or len(corpus.frequent) + 1
        weight = np.sqrt(np.maximum(corpus.frequencies(words), 0.5))
        before = np.cumsum(weight) - weight
        of = (before / weight.sum() * (self.classes or max(1, round(words**0.5)))).astype(int)
        starts = np.unique(of, return_index=True)[1]
        return replace(self, words=words, classes=len(starts), starts=tuple(starts.tolist()))

    def bounds(self) -> np.ndarray:
        """Each class's first word, and the number of words."""
        return np.append(self.starts or np.arange(self.classes) * (self.words // self.classes), self.words)


@dataclass(frozen=True)
class Corpus:
    """What scoring needs of the counts, besides the table itself."""

    total: int
    distinct: int
    end: int
    frequent: list[bytes]
    held: dict[bytes, int]
    tail_norm: np.ndarray

    def frequencies(self, words: int) -> np.ndarray:
        """Counts by word id; the end token is the last."""
        f = np.zeros(words)
        f[: len(self.frequent)] = [self.held[w] for w in self.frequent]
        f[-1] = self.end
        return f


def tail_class(word: bytes, tails: int) -> int:
    return crc32(word[-2:]) % tails


@cache
def _tail_classes(tails: int) -> np.ndarray:
    """tail_class of every word of two bytes, then of every one-byte word."""
    return np.array([tail_class(bytes((x >> 8, x & 255)), tails) for x in range(1 << 16)] + [tail_class(bytes((x,)), tails) for x in range(256)], np.int32)


def tail_classes(words: pa.Array, tails: int) -> np.ndarray:
    """tail_class of each of these words, none of which is empty."""
    words = pa.array(words, pa.binary()) if words.offset else words.cast(pa.binary())
    offsets, data = (np.frombuffer(x, t) if x else np.zeros(0, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
    ends = offsets[1 : len(words) + 1].astype(np.int64)
    last = data[ends - 1].astype(np.int64)
    two = ends - offsets[: len(words)] > 1
    before = data[np.where(two, ends - 2, ends - 1)].astype(np.int64)
    return _tail_classes(tails)[np.where(two, before * 256 + last, (1 << 16) + last)]


def count_tokens(docs: DataFrame, text: str = "text", flush: int = 800_000) -> DataFrame:
    """(word, n) over whole texts; the end token is the empty word. Tasks add up what they can hold before the shuffle."""

    def summed(parts):
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def counted(batches):
        ends, held = 0, []
        for batch in batches:
            found = split_words(batch.column(0))[0].value_counts()
            ends += batch.num_rows
            held.append(pa.table({"word": found.field("values").cast(pa.binary()), "n": found.field("counts")}))
            if sum(map(len, held)) > flush:
                yield from summed(held).to_batches()
                held = []
        yield from summed([*held, pa.table({"word": pa.array([END], pa.binary()), "n": pa.array([ends], pa.int64())})]).to_batches()

    return _texts(docs, text).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    return by_bytes(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *keep))


def describe(counts: DataFrame, shape: Shape) -> Corpus:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("n"))).alias("e")).first()
    named = counts.where("length(word) > 0").withColumn("_bin", F.floor(F.log2("n") * 64).cast("int"))  # 1.1% wide: 64 for each doubling of a count
    bins = named.groupBy("_bin").agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("_bin")).collect()
    missing = shape.coverage * (total["n"] or 0) - (total["e"] or 0)
    n_frequent = 0
    for b in bins:
        if missing <= b["n"]:
            n_frequent += max(0, int(np.ceil(missing / b["least"])))
            break
        missing -= b["n"]
        n_frequent += b["words"]
    n_frequent = shape.words - 1 if shape.words else min(n_frequent, shape.most_words)
    top = _most_frequent(named, bins, max(shape.held_counts, n_frequent))
    frequent = [w for w, _ in top[:n_frequent]]
    tail = F.crc32(F.when(F.length("word") < 2, F.col("word")).otherwise(F.expr("substring(word, -2, 2)"))) % shape.tails
    norm = np.ones(shape.tails)
    for r in counts.where("length(word) > 0").groupBy(tail.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        norm[r["k"]] += r["n"] + r["v"]
    for w, n in top[: len(frequent)]:
        norm[tail_class(w, shape.tails)] -= n + 1
    return Corpus(total["n"] or 0, total["v"], total["e"] or 0, frequent, dict(top), norm)


def _most_frequent(named: DataFrame, bins: list, size: int) -> list[tuple[bytes, int]]:
    """The `size` most frequent words with their counts, most frequent first; of equal bins, those with the least hash."""
    whole, k = 0, 0
    while k < len(bins) and whole + bins[k]["words"] <= size:
        whole += bins[k]["words"]
        k += 1
    rows = named.where(F.col("_bin") > bins[k]["_bin"]) if k < len(bins) else named
    got = rows.select("word", "n").toArrow() if whole else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    if k < len(bins) and size > whole:
        got = pa.concat_tables([got, hash_sample(named.where(F.col("_bin") == bins[k]["_bin"]).select("word", "n"), size - whole, "word").toArrow().cast(got.schema)])
    pairs = zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True)
    return sorted(pairs, key=lambda x: (-x[1], x[0]))


class Network:
    """A gated recurrent layer over token ids, and the levels of the softmax above it.

    Each gate's numbers lie side by side (gates are kept, reset, new state; a level's bias is the last column of its weights),
    so that every operation runs over whole arrays in the order of memory.
    """

    NAMES = ("gates", "recurrent", "group", "class", "word")

    def __init__(self, shape: Shape, frequencies: np.ndarray | None = None, seed: int = 7, flat: np.ndarray | None = None):
        """New parameters, from a unigram model if there are frequencies; or those of another network, from its `flat`."""
        self.shape = shape
        h, self.bounds = shape.state, shape.bounds()
        self.class_of = np.concatenate((np.repeat(np.arange(shape.classes), np.diff(self.bounds)), shape.classes + np.arange(shape.tails)))
        n_classes = shape.classes + shape.tails
        groups = max(1, round(n_classes**0.5))
        self.groups = np.linspace(0, n_classes, groups + 1).astype(int)
        self.group_of = np.repeat(np.arange(groups), np.diff(self.groups))
        self.sizes = {"gates": (3, shape.words + shape.tails, h), "recurrent": (3, h, h), "group": (groups, h + 1), "class": (n_classes, h + 1), "word": (shape.words, h + 1)}
        self.room, self.parts = np.empty(0, np.float32), {}
        if flat is not None:
            self.load(flat)
            self.seen = {k: np.full(v, 1e-3, np.float32) for k, v in self.sizes.items()}
            return
        rng = np.random.default_rng(seed)
        by_gate = lambda x: np.ascontiguousarray(x.reshape(len(x), 3, h).transpose(1, 0, 2))
        self.p = {"gates": by_gate(rng.normal(0, 0.1, (shape.words + shape.tails, 3 * h))), "recurrent": by_gate(rng.normal(0, h**-0.5, (h, 3 * h)))}
        for k in ("group", "class", "word"):
            self.p[k] = np.zeros(self.sizes[k])
            self.p[k][:, :h] = rng.normal(0, 0.1, (len(self.p[k]), h))
        if frequencies is not None:  # start from the unigram model
            f = np.maximum(frequencies, 0.5)
            own = np.add.reduceat(f[: shape.words], self.bounds[:-1])
            of_class = np.concatenate((own, f[shape.words :]))
            of_group = np.add.reduceat(of_class, self.groups[:-1])
            self.p["group"][:, h] = np.log(of_group / f.sum())
            self.p["class"][:, h] = np.log(of_class / of_group[self.group_of])
            self.p["word"][:, h] = np.log(f[: shape.words] / own[self.class_of[: shape.words]])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        self.p, at = {}, 0
        for k in self.NAMES:
            size = int(np.prod(self.sizes[k]))
            self.p[k] = flat[at : at + size].reshape(self.sizes[k]).astype(np.float32)
            at += size
        return self

    def forward(self, h: np.ndarray, ids: np.ndarray, fresh: np.ndarray, keep: bool):
        """ids and fresh are steps x lanes; gives the states and what backward needs: each step's first state, gates and new state.

        Both gates are 1 / (1 + exp(what their weights say)).
        """
        n, kind = self.shape.state, self.p["gates"].dtype
        steps, width = ids.shape
        x, recurrent = self.p["gates"].take(ids, axis=1), self.p["recurrent"]
        memory = steps if keep else 1
        states, new = np.empty((steps, width, n), kind), np.empty((memory, width, n), kind)
        gates, again, change = np.empty((2, memory, width, n), kind), np.empty((3, memory, width, n), kind), np.empty((width, n), kind)
        starts = fresh.any(1).tolist()
        own = h
        for t in range(steps):
            k = t if keep else 0
            if starts[t]:
                own = np.where(fresh[t][:, None], kind.type(0), own)
            zr, candidate, a, out = gates[:, k], new[k], again[:, k], states[t]
            np.matmul(own, recurrent, out=a)
            np.add(x[:2, t], a[:2], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[1], a[2], out=candidate)
            candidate += x[2, t]
            np.tanh(candidate, out=candidate)
            np.subtract(own, candidate, out=change)
            change *= zr[0]
            np.add(candidate, change, out=out)
            own = out
        if not keep:
            return states, ()
        before = np.concatenate((h[None], states[:-1]))
        before[fresh] = 0
        return states, (before, gates, again[2], new)

    def outputs(self, states: np.ndarray, targets: np.ndarray, learn: bool):
        """Log probability of each target (for a tail class, of the class); with learn also the gradients.

        Rows are taken in the order of their targets, which is also that of their classes and groups.
        """
        n, kind = self.shape.state, self.p["word"].dtype
        order = _in_order(targets, len(self.class_of))
        target = targets[order]
        own = np.ones((len(order), n + 1), kind)  # the last is what the bias is multiplied with
        own[:, :n] = states.take(order, axis=0)
        of, known = self.class_of[target], int(np.searchsorted(target, self.shape.words))
        score, back, grads = np.zeros(len(own)), np.zeros((len(own), n), kind), {}
        for name, rows, item, bounds in (("group", len(own), self.group_of[of], np.array([0, len(self.groups) - 1])), ("class", len(own), of, self.groups), ("word", known, target, self.bounds)):
            grads |= self._level(name, own[:rows], item[:rows], bounds, score[:rows], back[:rows], learn)
        placed = np.empty(len(own))
        placed[order] = score
        if not learn:
            return placed, grads, None
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return placed, grads, back.take(place, axis=0)

    def _level(self, name: str, own: np.ndarray, item: np.ndarray, bounds: np.ndarray, score: np.ndarray, back: np.ndarray, learn: bool) -> dict:
        """One factor of the softmax: the log of p(item | its segment of bounds) is added to score, its gradient by the states to back.

        Rows come in the order of their items. The logits of a row are those of its own segment; those of some segments lie in one
        flat array at a time, small enough for a core's cache.
        """
        parts, grad = self._parts(name, bounds)
        n, kind = own.shape[1] - 1, own.dtype
        cuts, sizes = np.searchsorted(item, bounds), np.diff(bounds)
        rows = np.diff(cuts)
        begin = np.append(0, np.cumsum(rows * sizes))
        edges = np.unique(np.append(np.searchsorted(begin, np.arange(0, begin[-1], AT_ONCE)), len(sizes))).tolist()
        ends, widths, heights, places = cuts.tolist(), sizes.tolist(), rows.tolist(), begin.tolist()
        for low, high in zip(edges, edges[1:]):
            first, size = ends[low], places[high] - places[low]
            part = slice(first, ends[high])
            segment = np.repeat(np.arange(low, high), rows[low:high])
            starts = begin[segment] - places[low] + (np.arange(first, ends[high]) - cuts[segment]) * sizes[segment]
            picked = starts + item[part] - bounds[segment]
            if len(self.room) < size or self.room.dtype != kind:
                self.room = np.empty(size + AT_ONCE, kind)
            flat, states = self.room[:size], own[part]
            live, at = [], 0
            for c in range(low, high):
                if heights[c]:
                    to = at + heights[c] * widths[c]
                    r, e = slice(ends[c] - first, ends[c + 1] - first), flat[at:to].reshape(heights[c], widths[c])
                    np.dot(states[r], parts[c][0], out=e)
                    live.append((r, e, parts[c]))
                    at = to
                elif learn:
                    parts[c][2].fill(0)
            logit = flat[picked]
            if size and not (flat.max() < 60 and logit.min() > -60):  # exponentials might overflow, or all of a row vanish
                top = np.maximum.reduceat(flat, starts)
                flat -= np.repeat(top, sizes[segment])
                logit -= top
            np.exp(flat, out=flat)
            sums = np.add.reduceat(flat, starts) if size else np.ones(0, kind)
            score[part] += logit - np.log(sums)
            if not learn:
                continue
            flat[picked] -= sums  # what is expected, less what came
            scale = (1 / sums)[:, None]
            scaled, through = states * scale, np.empty((len(picked), n), kind)
            for r, e, (_, weights, g) in live:
                np.dot(e, weights, out=through[r])
                np.dot(e.T, scaled[r], out=g)
            through *= scale
            back[part] += through
        return {name: grad} if learn else {}

    def _parts(self, name: str, bounds: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Each segment's weights (with the bias, turned; without it) and the place of their gradient, and the whole gradient; the same arrays in every window."""
        weight = self.p[name]
        held = self.parts.get(name)
        if held is None or held[0] is not weight:
            grad, cuts = np.zeros_like(weight), bounds.tolist()
            each = [(weight[a:b].T, weight[a:b, :-1], grad[a:b]) for a, b in zip(cuts, cuts[1:])]
            held = self.parts[name] = (weight, each, grad)
        return held[1:]

    def backward(self, ids: np.ndarray, fresh: np.ndarray, memory: tuple, back: np.ndarray) -> dict:
        """Gradients of the recurrent part; back is steps x lanes x state. The window's first state is a constant."""
        rows, sums, g_u = self.backward_rows(ids, fresh, memory, back)
        g_gates = np.zeros_like(self.p["gates"])
        g_gates[:, rows] = sums
        return {"gates": g_gates, "recurrent": g_u}

    def backward_rows(self, ids: np.ndarray, fresh: np.ndarray, memory: tuple, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """backward, with the gradient of `gates` as the rows that have one and their values."""
        n, u = self.shape.state, self.p["recurrent"]
        before, (z, r), inner, new = memory
        of_z = new - before
        of_z *= z
        of_new = 1 - z
        of_z *= of_new
        of_r = new * new
        np.subtract(1, of_r, out=of_r)
        of_new *= of_r
        np.subtract(r, 1, out=of_r)
        of_r *= r
        of_r *= inner
        inputs = np.empty((4, *ids.shape, n), u.dtype)  # of what the reset gate lets through, of the gates, of the new state
        back_u, d, through = np.ascontiguousarray(u[[2, 0, 1]].transpose(0, 2, 1)), np.zeros_like(back[0]), np.empty((3, *back[0].shape), u.dtype)
        starts = fresh.any(1).tolist()
        for t in range(len(ids) - 1, -1, -1):
            d += back[t]
            g_again, g_z, g_r, g_new = inputs[:, t]
            np.multiply(d, of_new[t], out=g_new)
            np.multiply(d, of_z[t], out=g_z)
            np.multiply(g_new, of_r[t], out=g_r)
            np.multiply(g_new, r[t], out=g_again)
            d *= z[t]
            np.matmul(inputs[:3, t], back_u, out=through)
            for x in through:
                d += x
            if starts[t]:
                d[fresh[t]] = 0
        flat = inputs.reshape(4, -1, n)
        g_u = np.matmul(before.reshape(-1, n).T, flat[:3])[[1, 2, 0]]
        return *_sums_by(ids.ravel(), flat[1:], len(self.class_of)), g_u

    def step(self, grads: dict, rows: np.ndarray, values: np.ndarray, block: int = 1 << 16) -> None:
        """Adagrad on the loss per place of a full window, so that a window of few lanes weighs little; rows and values: of `gates`."""
        n, rate = np.float32(1 / (self.shape.lanes * self.shape.window)), np.float32(self.shape.rate)
        room = np.empty(block, np.float32)
        for k, whole in grads.items():
            whole, all_seen, p = whole.reshape(-1), self.seen[k].reshape(-1), self.p[k].reshape(-1)
            for at in range(0, len(whole), block):
                g, seen = whole[at : at + block], all_seen[at : at + block]
                x = room[: len(g)]
                g *= n
                np.multiply(g, g, out=x)
                seen += x
                np.sqrt(seen, out=x)
                np.divide(g, x, out=x)
                x *= rate
                p[at : at + block] -= x
        all_seen, p = (x["gates"].reshape(-1, self.shape.state) for x in (self.seen, self.p))
        rows, values = (rows + len(self.class_of) * np.arange(3)[:, None]).ravel(), values.reshape(-1, self.shape.state)
        values *= n
        seen = all_seen.take(rows, axis=0)
        seen += values * values
        all_seen[rows] = seen
        values /= np.sqrt(seen, out=seen)
        values *= rate
        p[rows] -= values


def _in_order(ids: np.ndarray, size: int) -> np.ndarray:
    """Places of the ids (below size), by id; numpy sorts 16 bits by their digits."""
    return np.argsort(ids.astype(np.uint16) if size < 1 << 16 else ids, kind="stable")


def _sums_by(ids: np.ndarray, values: np.ndarray, size: int, often: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids (below size) and, for each, the sum of its rows of values (parts x rows x columns).

    Ids that come at most `often` times are added up together, all their first rows, then all second ones, and so on.
    """
    by = _in_order(ids, size)
    ordered = ids[by]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(first, len(ids)))
    down = np.argsort(-count, kind="stable")
    first, count = first[down], count[down]
    more = np.searchsorted(-count, -np.arange(often + 1))  # how many ids come more than 0, 1, ... times
    sums, ones = values.take(by[first], axis=1), np.ones(count[0], values.dtype)
    for k in range(more[often]):
        sums[:, k] = np.matmul(ones[: count[k]], values.take(by[first[k] : first[k] + count[k]], axis=1))
    for j in range(1, often):
        here = slice(more[often], more[j])
        sums[:, here] += values.take(by[first[here] + j], axis=1)
    return ordered[first], sums


def lanes(documents: list[np.ndarray], shape: Shape, wider: int = 1):
    """Windows over the documents laid end to end in lanes: (ids, fresh, targets, valid, document, live lanes).

    Longest documents are dealt first, each to the shortest lane; lanes are in order of length, so the live
    ones are always the first. Windows are cut from the lanes as they are needed: `window` places where all
    lanes are live, more where fewer are, so that a window holds about as many tokens (`wider` times as many).
    A long document is one lane, so there are no more lanes than make all of them about as long.
    """
    total, longest = sum(map(len, documents)), max(map(len, documents), default=0)
    count = max(1, min(shape.lanes, len(documents), max(64, -(-total // max(longest, 1)))))
    heap = [(0, k) for k in range(count)]
    dealt: list[list[int]] = [[] for _ in range(count)]
    for k in sorted(range(len(documents)), key=lambda k: -len(documents[k])):
        size, lane = heapq.heappop(heap)
        dealt[lane].append(k)
        heapq.heappush(heap, (size + len(documents[k]), lane))
    dealt = sorted((x for x in dealt if x), key=lambda own: -sum(len(documents[k]) for k in own))
    sizes = np.array([sum(len(documents[k]) for k in own) for own in dealt])
    order = [k for own in dealt for k in own]
    target = np.concatenate([documents[k] for k in order])
    of = np.repeat(np.array(order, np.int32), [len(documents[k]) for k in order])
    first = np.zeros(len(target), bool)
    first[np.cumsum([0, *(len(documents[k]) for k in order)])[:-1]] = True
    end = shape.words - 1
    source = np.roll(target, 1)
    source[first] = end
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = 0
    while at < sizes[0]:
        live = int(np.searchsorted(-sizes, -at, side="left"))
        to = min(at + max(shape.window, shape.lanes * shape.window * wider // live), int(sizes[0]))
        if live > 1:  # to where half of the lanes end, or at least one window
            to = min(to, max(int(sizes[live // 2]), at + shape.window))
        place = np.arange(at, to)[:, None]
        valid = place < sizes[None, :live]
        where = np.minimum(starts[None, :live] + place, len(target) - 1)
        yield source[where], first[where] & valid, target[where], valid, of[where], live
        at = to


def run(network: Network, documents: list[np.ndarray], learn: bool) -> np.ndarray:
    """Log probability of each document; with learn, the network is trained on the way."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    h = None
    for ids, fresh, targets, valid, of, live in lanes(documents, network.shape, 1 if learn else WIDER):
        h = np.zeros((live, network.shape.state), network.p["gates"].dtype) if h is None else h[:live]
        states, memory = network.forward(h, ids, fresh, learn)
        h = states[-1]
        full = bool(valid.all())
        picked = (lambda x: x.reshape(-1, *x.shape[2:])) if full else (lambda x, valid=valid: x[valid])
        score, grads, back = network.outputs(picked(states), picked(targets), learn)
        total += np.bincount(picked(of), score, len(documents))
        if learn:
            whole = back.reshape(states.shape) if full else np.zeros_like(states)
            if not full:
                whole[valid] = back
            rows, values, grads["recurrent"] = network.backward_rows(ids, fresh, memory, whole)
            network.step(grads, rows, values)
    return total


def _start(corpus: Corpus, shape: Shape) -> Network:
    return Network(shape, np.concatenate((corpus.frequencies(shape.words), corpus.tail_norm)))


def encode(docs: DataFrame, corpus: Corpus, shape: Shape, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A stored table: `keep`, _row, _ids (of the tokens, 32 bits each: frequent words by rank, end, tail classes), and what the counts say of them.

    _known: tokens with a held count; _base: the sum of their log10(c + 1); _tail: of tail tokens, the known
    part of log10(p | class); _rare: words whose count is not held, and how often they stand in the text.
    """
    held = sorted(corpus.held, key=lambda w: (-corpus.held[w], w))  # frequent words first
    known = docs.sparkSession.sparkContext.broadcast((pa.array(held, pa.binary()), np.array([corpus.held[w] for w in held], np.float64)))
    words, tails, end, tail_norm = shape.words, shape.tails, corpus.end, corpus.tail_norm
    n_frequent = len(corpus.frequent)
    kept = docs.select(*keep).schema
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def encoded(batches):
        values, held_n = known.value
        place_of = dict(zip(values.to_pylist(), range(len(values)))).get
        logs, tail_log = np.log10(held_n + 1), np.log10(tail_norm)
        for batch in batches:
            flat, sizes = split_words(batch.column(0))
            coded = flat.cast(pa.binary()).dictionary_encode()
            local, unique = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            at = np.fromiter(map(place_of, unique.to_pylist(), repeat(-1)), np.int64, len(unique))
            tail = tail_classes(unique, tails)
            ids_of = np.where((at >= 0) & (at < n_frequent), at, words + tail).astype(np.int32)
            base_of = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)
            tail_of = np.where(ids_of >= words, base_of - tail_log[tail], 0.0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = lambda x, doc=doc, n=len(sizes): np.bincount(doc, x, n).astype(np.float64)
            hits = sums((at >= 0)[local].astype(np.float64)).astype(np.int64)
            base, of_tail = sums(base_of[local]), sums(tail_of[local])
            ids = np.full(len(local) + len(sizes), words - 1, "<i4")  # an end after each text
            ids[np.arange(len(local)) + doc] = ids_of[local]
            cuts = np.append(0, np.cumsum(sizes + 1))
            rare = np.flatnonzero((at < 0)[local])
            pair, times = np.unique(doc[rare] * max(len(unique), 1) + local[rare], return_counts=True)
            of_rare, word = np.divmod(pair, max(len(unique), 1))
            ends = np.searchsorted(of_rare, np.arange(len(sizes) + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([unique.take(pa.array(word)), pa.array(times.astype(np.int32))], names=["word", "times"])
            whole = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes + 1), pa.array(hits + (end > 0)), pa.array(base + np.log10(end + 1)), pa.array(of_tail), whole, pa.ListArray.from_arrays(pa.array(ends), rows)],
                names=[*keep, "n_tokens", "_known", "_base", "_tail", "_ids", "_rare"],
            )

    made = _texts(docs, text, *map(F.col, keep)).mapInArrow(encoded, f"{own}n_tokens long, _known long, _base double, _tail double, _ids binary, _rare array<struct<word:binary,times:int>>")
    return stored(made.withColumn("_row", F.monotonically_increasing_id()), "lm-ids")


def _documents(batches, name: str = "_ids", most_tokens: int = 4_000_000):
    """Lists of whole documents' ids, about most_tokens together."""
    ids, n = [], 0
    for batch in batches:
        for x in batch.column(batch.schema.get_field_index(name)):
            ids.append(np.frombuffer(x.as_buffer(), "<i4"))
            n += len(ids[-1])
            if n >= most_tokens:
                yield ids
                ids, n = [], 0
    if ids:
        yield ids


def _together(batches, most_tokens: int):
    """Lists of batches, about most_tokens together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(batch.schema.get_field_index("_ids")).nbytes // 4
        if n >= most_tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame, corpus: Corpus, text: str = "text", shape: Shape = Shape()) -> Network:
    """A network trained on all of docs."""
    shape = shape.fitted(corpus)
    return train_encoded(encode(docs, corpus, shape, text, ()), corpus, shape) if corpus.total else _start(corpus, shape)


def train_encoded(encoded: DataFrame, corpus: Corpus, shape: Shape) -> Network:
    """Rounds of local training and averaging over a table of `encode`, each document in the round that its hash says."""
    network = _start(corpus, shape)
    context = encoded.sparkSession.sparkContext
    size = 1 << 14
    trainers = max(1, round(corpus.total / shape.rounds / shape.trainer_tokens))
    group = max(1, round(trainers**0.5))
    for k in range(shape.rounds):
        now = context.broadcast(network.flat())

        def trained(batches, now=now):
            from pyspark import TaskContext

            own, n = Network(shape, flat=now.value), 0
            for ids in _documents(batches, most_tokens=shape.trainer_tokens):
                run(own, ids, learn=True)
                n += sum(map(len, ids))
            if n:
                x = own.flat()
                parts = [x[at : at + size].tobytes() for at in range(0, len(x), size)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId() // group] * len(parts), pa.int32()), pa.array([float(n)] * len(parts)), pa.array(parts, pa.binary())], names=["part", "grp", "weight", "value"])

        def mean(key, table):
            weight = table.column("weight").to_numpy()
            total = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(weight, table.column("value").to_pylist(), strict=True)) / weight.sum()
            return pa.table({"part": table.column("part")[:1], "grp": pa.array([0], pa.int32()), "weight": pa.array([weight.sum()]), "value": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        kind = "part int, grp int, weight double, value binary"
        here = encoded.where(F.pmod(F.xxhash64("_ids"), F.lit(shape.rounds)) == k).select("_ids").coalesce(trainers)
        local = by_bytes(here).mapInArrow(trained, kind)
        rows = local.groupBy("part", "grp").applyInArrow(mean, kind).groupBy("part").applyInArrow(mean, kind).orderBy("part").collect()  # the size of the network
        if rows:
            network.load(np.concatenate([np.frombuffer(r["value"], np.float32) for r in rows]))
    return network


def score_texts(docs: DataFrame, counts: DataFrame, corpus: Corpus, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, n_known, base_score and score of every row of docs."""
    return score_encoded(encode(docs, corpus, network.shape, text, keep), counts, corpus, network, keep)


def score_encoded(encoded: DataFrame, counts: DataFrame, corpus: Corpus, network: Network, keep: tuple[str, ...]) -> DataFrame:
    """score_texts on a table of `encode`."""
    shape = network.shape
    known = encoded.sparkSession.sparkContext.broadcast(network.flat())
    facts = ["_row", "n_tokens", "_known", "_base"]
    schema = encoded.select(*keep, *facts).schema.add("_score", "double")

    def scored(batches):
        net = Network(shape, flat=known.value)
        for some in _together(batches, 3 * shape.trainer_tokens // 2):  # with many texts side by side, long ones take few steps of their own
            table = pa.Table.from_batches(some)
            found = [run(net, ids, learn=False) for ids in _documents(some, most_tokens=2 * shape.trainer_tokens)]
            tail = table["_tail"].to_numpy()
            yield from table.select(schema.names[:-1]).append_column("_score", pa.array(np.concatenate(found) / LOG10 + tail if found else tail)).to_batches()

    first = by_bytes(encoded.drop("_rare")).mapInArrow(scored, schema)
    rare = encoded.select("_row", F.explode("_rare").alias("_w")).select("_row", "_w.word", "_w.times")
    found = rare.join(counts.hint("shuffle_hash"), "word").groupBy("_row").agg(F.sum("times").alias("_more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_log"))
    out = first.join(found, "_row", "left").withColumn("_log", F.coalesce("_log", F.lit(0.0)))
    whole = float(np.log10(corpus.total + corpus.distinct + 1))
    return out.select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(corpus.total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.col("_log") - F.col("n_tokens") * whole).alias("base_score"), (F.col("_score") + F.col("_log")).alias("score"),
    )


def score_documents(docs: DataFrame, usable: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shape: Shape = Shape()) -> DataFrame:
    """Count and train on the documents that pass `usable`, then score all of them."""
    counts = stored(count_tokens(docs.where(usable), text).where("n > 0"), "token-counts")
    corpus = describe(counts, shape)
    shape = shape.fitted(corpus)
    rows = docs.select(*keep, F.col(text).alias("_whole"), F.coalesce(usable, F.lit(False)).alias("_learnt"))
    encoded = encode(rows, corpus, shape, "_whole", (*keep, "_learnt"))
    network = train_encoded(encoded.where("_learnt"), corpus, shape)
    return score_encoded(encoded, counts, corpus, network, keep)
