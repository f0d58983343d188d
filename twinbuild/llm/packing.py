"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the packing problem is fully given by how many pieces
have each length: a histogram of at most `capacity` rows, whatever the number of documents. The driver
plans on that histogram alone, in runs of equal bins:

1. Reduction (Martello and Toth 1990): for the longest remaining piece, a set that provably dominates
   every other set with that piece becomes a bin for good - the piece alone when nothing else fits, the
   piece with one that fills the bin exactly, or with the best single one when no two others together
   beat it.
2. The remainder goes by best fit, longest first, into the fullest open bin it fits.

The plan says, for each length, which ranks go to which bins and offsets. Spark ranks the pieces of each
length (in the task that made them, plus offsets over the tasks) and looks their places up.

Defined cases: a null text is empty and still has its end id, so each document has a piece; repeated rows
are packed each; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinbuild.llm.common import by_bytes, split_words, stored


# bytes of words of letters up to U+00FF: a-z, and C3 with what follows it but for the signs of multiplication and division
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), 0xC3, *range(0x80, 0xC0)]] = True
_LETTERS[[0x97, 0xB7]] = False


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Token ids of words; white space always separates tokens here, so each word is encoded once and remembered.

    A letter, digit or other run of characters never shares a token with the punctuation after it, so both
    parts are encoded alone; and words of letters end in a token with the word-end mark, so many of them
    are encoded in one call. What is known is held as arrays: words, and where their ids lie in one pool;
    `forget` drops the words beyond `remember`, so that what a worker holds does not grow with its task.
    """

    def __init__(self, file: str, remember: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(file), remember
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[k for x, k in names.items() if x.endswith("</w>")]] = True
        self.words, self.starts, self.lengths, self.pool = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these words (different, in lower case) start in the pool, and how many they are; a word's ids are those of its two parts."""
        core = pc.ascii_rtrim(words, characters=".,;:!?").cast(pa.binary())
        whole, size = words.cast(pa.binary()), pc.binary_length(words).to_numpy()
        kept = pc.binary_length(core).to_numpy()
        offsets, data = _buffers(core)
        last = data[np.maximum(offsets[1:] - 1, 0)]
        cut = (kept < size) & (kept > 0) & (((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)))
        offsets, data = _buffers(whole)
        at = np.flatnonzero(cut)
        ends = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, np.cumsum((size - kept)[at])).astype(np.int32)), pa.py_buffer(_gather(data, offsets[at] + kept[at], (size - kept)[at]))])
        parts = pa.chunked_array([pc.if_else(pa.array(cut), core, whole), ends]).combine_chunks().dictionary_encode()
        known = self._known(parts.dictionary)[parts.indices.to_numpy()]
        first, lengths = known[: len(words)], np.zeros(len(words), np.int64)
        starts = self.starts[first]
        lengths += self.lengths[first]
        # a cut word gets a run of its own: its first part, then its second
        second = known[len(words) :]
        both = lengths[at] + self.lengths[second]
        joined = np.empty(both.sum(), "<u4")
        to = np.cumsum(both) - both
        for begin, n, where in ((starts[at], lengths[at], to), (self.starts[second], self.lengths[second], to + lengths[at])):
            joined[np.repeat(where - (np.cumsum(n) - n), n) + np.arange(n.sum())] = _gather(self.pool, begin, n)
        starts[at], lengths[at] = len(self.pool) + to, both
        self.extra = joined
        return starts, lengths

    def _known(self, words: pa.Array) -> np.ndarray:
        """The numbers of the words here, where new ones are encoded."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words) + np.arange(len(new))
            self._add(words.take(pa.array(new)))
        return at

    def _add(self, words: pa.Array, at_once: int = 10_000) -> None:
        offsets, data = _buffers(words)
        odd = np.append(0, np.cumsum(~_LETTERS[data]))
        letters = odd[offsets[1:]] == odd[offsets[:-1]]
        texts, starts, lengths, pool, size = words.to_pylist(), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.pool], len(self.pool)
        other = np.flatnonzero(~letters).tolist()
        of_letters = np.flatnonzero(letters)
        for k in range(0, len(of_letters), at_once):
            part = of_letters[k : k + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join([texts[i] for i in part]).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                other += part.tolist()
                continue
            lengths[part] = np.diff(ends, prepend=0)
            starts[part] = size + ends - lengths[part]
            pool.append(ids)
            size += len(ids)
        for k in range(0, len(other), at_once):
            part = other[k : k + at_once]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in part], add_special_tokens=False)]
            lengths[part] = n = np.fromiter(map(len, found), np.int64, len(found))
            starts[part] = size + np.cumsum(n) - n
            pool.append(np.fromiter(chain.from_iterable(found), "<u4", n.sum()))
            size += int(n.sum())
        self.words = pa.concat_arrays([self.words, words])
        self.starts, self.lengths, self.pool = np.append(self.starts, starts), np.append(self.lengths, lengths), np.concatenate(pool)

    def forget(self, above: int) -> None:
        if len(self.words) > above:
            starts, lengths = self.starts[: self.remember], self.lengths[: self.remember].copy()
            self.words, self.pool = pa.concat_arrays([self.words.slice(0, self.remember)]), _gather(self.pool, starts, lengths)
            self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than there are words) and bytes of a binary array."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if offsets else np.zeros(1, np.int32)
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)


_loaded: dict[str, WordIds] = {}  # a worker keeps its words from task to task


def parts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows, with about `most` bytes of its first column each (a longer text is a part alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def joined_ids(texts: pa.Array, ids_of: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, each followed by end_id, and where each text begins (and the last one ends)."""
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    starts, lengths = ids_of(coded.dictionary)
    pool = np.concatenate((ids_of.pool, ids_of.extra, np.array([end_id], "<u4")))
    starts, lengths = np.append(starts, len(pool) - 1), np.append(lengths, 1)
    last = np.cumsum(sizes + 1) - 1
    words = np.full(len(flat) + len(sizes), len(starts) - 1)
    own = np.ones(len(words), bool)
    own[last] = False
    words[own] = coded.indices.to_numpy()
    n = lengths[words]
    return _gather(pool, starts[words], n), np.append(0, np.cumsum(n)[last])


def token_pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", capacity: int = 4096, end_id: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: `keep`, piece, start, length, ids_crc32, and its task and its rank there among equal lengths."""
    schema = docs.select(*keep).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("_task", "integer").add("_rank", "long")

    def cut(batches):
        from pyspark import TaskContext

        if tokenizer_file not in _loaded:
            _loaded[tokenizer_file] = WordIds(tokenizer_file)
        ids_of, task, ranks = _loaded[tokenizer_file], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in parts(whole)):
            ids, bounds = joined_ids(batch.column(0), ids_of, end_id)
            ids_of.forget(above=ids_of.remember * 4 // 3)
            rows, of = [], []
            for at, (first, end) in enumerate(pairwise(bounds.tolist())):
                for piece, start in enumerate(range(first, end, capacity)):
                    part = ids[start : min(start + capacity, end)]
                    rows.append((piece, start - first, len(part), crc32(part), task, ranks[len(part)]))
                    ranks[len(part)] += 1
                    of.append(at)
            own = [c.take(pa.array(of, pa.int64())) for c in batch.columns[1:]]
            table = np.array(rows, np.int64).reshape(len(rows), 6)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c).cast(t) for c, t in zip(table.T, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], names=schema.names)
        ids_of.forget(above=ids_of.remember)
        pa.default_memory_pool().release_unused()

    return by_bytes(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *keep)).mapInArrow(cut, schema)


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Take the bins that dominance fixes out of counts; each as (how many, [(length, how many in a bin)])."""
    bins = []
    sizes = [int(s) for s in np.flatnonzero(counts)]  # ascending
    left = {s: int(counts[s]) for s in sizes}

    def spend(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            sizes.remove(size)

    below = capacity + 1  # longer pieces have had their turn, and those still here may yet go with shorter ones
    while at := bisect_left(sizes, below):
        j = sizes[at - 1]
        room = capacity - j
        other = [s for s in sizes if s != j or left[j] > 1]
        if not other or other[0] > room:
            bins.append((left[j], [(j, 1)]))
            spend(j, left[j])
            continue
        k = other[bisect_left(other, room + 1) - 1]
        smallest = 2 * other[0] if left[other[0]] - (other[0] == j) > 1 else sum(other[:2]) if len(other) > 1 else capacity
        if k == room or smallest > room or _smallest_three(other, left, j) > room and _best_pair(other, left, j, room) <= k:
            if k == j:  # taking pieces away leaves the others fewer sets, so what dominates goes on doing so
                n = left[j] // 2
                bins.append((n, [(j, 2)]))
                spend(j, 2 * n)
            else:
                n = min(left[j], left[k])
                bins.append((n, [(j, 1), (k, 1)]))
                spend(j, n)
                spend(k, n)
            continue
        below = j
    counts[:] = 0
    for s, n in left.items():
        counts[s] = n
    return bins


def _best_pair(other: list[int], left: dict, j: int, room: int) -> int:
    """The largest sum of two other pieces that fits."""
    best, low, high = 0, 0, bisect_left(other, room + 1) - 1
    while low <= high:
        total = other[low] + other[high]
        if total > room or low == high and left[other[low]] - (other[low] == j) < 2:
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def _smallest_three(other: list[int], left: dict, j: int) -> int:
    three: list[int] = []
    for s in other[:3]:
        three += [s] * min(3, left[s] - (s == j))
    return sum(three[:3]) if len(three) >= 3 else 1 << 60


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, on runs of equal bins: an open bin is (how many such, contents), by its room."""
    rooms: list[int] = []  # ascending, with open bins
    opened: dict[int, list] = {}

    def put(room: int, n: int, held: list) -> None:
        if n:
            if room not in opened:
                insort(rooms, room)
                opened[room] = []
            opened[room].append((n, held))

    for size in map(int, np.flatnonzero(counts)[::-1]):
        n = int(counts[size])
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                put(capacity - each * size, n // each, [(size, each)])
                if n % each:
                    put(capacity - n % each * size, 1, [(size, n % each)])
                break
            room = rooms[k]
            bins, held = opened[room].pop()
            if not opened[room]:
                del opened[room]
                rooms.pop(k)
            each = room // size  # the bin just used is then the fullest that fits, until it is full
            full = min(bins, n // each)
            put(room - each * size, full, [*held, (size, each)])
            n -= full * each
            rest = bins - full
            if rest and n and n < each:
                put(room - n * size, 1, [*held, (size, n)])
                n, rest = 0, rest - 1
            put(room, rest, held)
    return [x for room in rooms for x in opened[room]]


def plan_bins(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, how many in a bin, first sequence, first offset), by length and rank; and the number of bins."""
    counts = counts.copy()
    groups = reduce_dominated(counts, capacity) + best_fit(counts, capacity)
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, held in groups:
        offset = 0
        for size, each in held:
            rows.append((size, used[size], each, sequence, offset))
            used[size] += n * each
            offset += size * each
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(len(rows), 5), sequence


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to the rows of token_pieces."""
    pieces = stored(pieces, "pieces")
    per_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("_task", "length", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in per_task.groupBy("length").agg(F.sum("_n")).collect():  # one row a length: at most `capacity`
        counts[size] = n
    plan, _ = plan_bins(counts, capacity)
    known = pieces.sparkSession.sparkContext.broadcast(plan)
    ranked = pieces.join(before, ["_task", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_task", "_before")
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def placed(batches):
        table = known.value
        wide = np.int64(1) << np.int64(44)  # a length and a rank as one number
        starts = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(starts, size * wide + rank, side="right") - 1]
            nth = rank - row[:, 1]
            own = [batch.column(batch.schema.get_field_index(c)) for c in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * size)], names=schema.names)

    return ranked.mapInArrow(placed, schema)
