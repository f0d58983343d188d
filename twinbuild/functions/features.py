"""Features of functions: counted mnemonics and trigrams, fingerprints, signatures, anchor sets, vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

# The FNV-1a parameters for 64 bits.
FNV_START, FNV_PRIME, WORD = 14695981039346656037, 1099511628211, (1 << 64) - 1


COUNTED = ArrayType(StructType([StructField("mnemonic", StringType()), StructField("count", LongType())]))


def _counted_lists(rows: np.ndarray, ids: np.ndarray, names: pa.Array, n_rows: int) -> pa.Array:
    """For each row its names with their counts, in order of name; rows[k] has names[ids[k]]."""
    order = pc.sort_indices(names).to_numpy().astype(np.int64)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    found, counts = np.unique(rows * max(len(names), 1) + rank[ids], return_counts=True)
    row, place = np.divmod(found, max(len(names), 1))
    entries = pa.StructArray.from_arrays([names.take(pa.array(order[place])), pa.array(counts.astype(np.int64))], ["mnemonic", "count"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)), pa.int32()), entries)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of each item of some lists (null ones are empty), and the different items by number."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64) * lists.is_valid().to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), sizes), coded.indices.to_numpy().astype(np.int64), coded.dictionary


@F.arrow_udf(COUNTED)
def counted_items(lists: pa.Array) -> pa.Array:
    """The items of each list with their counts, in order of item; none for a null list."""
    return _counted_lists(*_flat(lists), len(lists))


@F.arrow_udf(COUNTED)
def counted_trigrams(lists: pa.Array) -> pa.Array:
    """Every window of three items, joined by blanks, with its count, in order of window; none for shorter lists."""
    rows, ids, names = _flat(lists)
    at = np.flatnonzero(rows[:-2] == rows[2:]) if len(rows) > 2 else np.zeros(0, np.int64)
    width = max(len(names), 1)
    windows, of = np.unique((ids[at] * width + ids[at + 1]) * width + ids[at + 2], return_inverse=True)
    parts = (windows // width // width, windows // width % width, windows % width)
    joined = pc.binary_join_element_wise(*(names.take(pa.array(p)) for p in parts), " ").dictionary_encode()
    return _counted_lists(rows[at], joined.indices.to_numpy().astype(np.int64)[of.reshape(-1)], joined.dictionary, len(lists))


def with_counts(rows: DataFrame, mnemonics: str = "ordered") -> DataFrame:
    """Add mnemonics and trigrams (counted) for the ordered list in `mnemonics`. A list is counted where it lies; nothing moves."""
    return rows.withColumns({"mnemonics": counted_items(F.col(mnemonics)), "trigrams": counted_trigrams(F.col(mnemonics))})


# -- packed lists: a counted list as one compressed value, a tenth of what its rows take in a shuffle ----------------


def _strings(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings without nulls."""
    raw = names.cast(pa.binary())
    offsets, data = (np.frombuffer(x, t) if x else np.zeros(1, t) for x, t in zip(raw.buffers()[1:], (np.int32, np.uint8), strict=True))
    return offsets[raw.offset : raw.offset + len(raw) + 1].astype(np.int64), data


NARROW = 32  # names up to so many bytes are laid out by place, so that what sorted names share stands together


def pack(lists: pa.Array, names: pa.Array, counts: np.ndarray | None = None) -> pa.Array:
    """For each list how many names it has, their lengths, counts and bytes, compressed; empty for an empty or null list."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64) * lists.is_valid().to_numpy(zero_copy_only=False)
    offsets, data = _strings(names)
    lengths, ends = np.diff(offsets), np.cumsum(sizes)
    counts = np.ones(len(names), np.int64) if counts is None else counts
    for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if start == end:
            out.append(b"")
            continue
        own, held, letters = lengths[start:end], counts[start:end], data[offsets[start] : offsets[end]]
        width = int(own.max())
        if width <= NARROW:
            table = np.zeros((end - start, width), np.uint8)
            table[np.arange(width) < own[:, None]] = letters
            letters = table.T
        slim = np.uint8 if held.max() < 256 and held.min() >= 0 else np.int64
        raw = own.astype(np.uint8 if width <= NARROW else np.uint32).tobytes() + held.astype(slim).tobytes() + letters.tobytes()
        out.append(np.array([end - start, len(raw), width, np.dtype(slim).itemsize], np.uint32).tobytes() + codec.compress(raw, asbytes=True))
    return pa.array(out, pa.binary())


def unpack(values: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many names each packed list has; all names; their counts."""
    codec, sizes, lengths, counts, data = pa.Codec("zstd"), np.zeros(len(values), np.int64), [], [], []
    for k, value in enumerate(values.to_pylist()):
        if not value:
            continue
        n, size, width, slim = np.frombuffer(value, np.uint32, 4).tolist()
        raw = codec.decompress(memoryview(value)[16:], size, asbytes=True)
        wide, sizes[k] = 1 if width <= NARROW else 4, n
        own, letters = np.frombuffer(raw, f"u{wide}", n).astype(np.int64), np.frombuffer(raw, np.uint8, offset=n * (wide + slim))
        if width <= NARROW:
            letters = letters.reshape(width, n).T[np.arange(width) < own[:, None]]
        lengths.append(own)
        counts.append(np.frombuffer(raw, "u1" if slim == 1 else "i8", n, n * wide).astype(np.int64))
        data.append(letters.tobytes())
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    names = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths)))), pa.py_buffer(b"".join(data)))
    return sizes, names, np.concatenate(counts) if counts else np.zeros(0, np.int64)


@F.arrow_udf(BinaryType())
def packed(lists: pa.Array) -> pa.Array:
    """A counted list as one value."""
    entries = lists.flatten()
    return pack(lists, entries.field("mnemonic"), entries.field("count").to_numpy())


@F.arrow_udf(BinaryType())
def packed_trigram_set(trigrams: pa.Array, mnemonics: pa.Array) -> pa.Array:
    """`trigram_set` as one value."""
    sizes = [np.diff(x.offsets.to_numpy()) * x.is_valid().to_numpy(zero_copy_only=False) for x in (trigrams, mnemonics)]
    short = np.flatnonzero((sizes[0] == 0) & (sizes[1] > 0))
    whole = [" ".join(" ".join([e["mnemonic"]] * e["count"]) for e in mnemonics[k].as_py()) for k in short.tolist()]
    out = pack(trigrams, trigrams.flatten().field("mnemonic")).to_pylist()
    for k, value in zip(short.tolist(), pack(pa.array([[x] for x in whole], pa.list_(pa.string())), pa.array(whole, pa.string())).to_pylist() if whole else [], strict=True):
        out[k] = value
    return pa.array(out, pa.binary())


def _met(x: pa.Array, y: pa.Array):
    """Of two columns of packed lists: row and counts of the names that both sides of a row have, and sizes and rows and counts of each side."""
    (nx, names_x, cx), (ny, names_y, cy) = unpack(x), unpack(y)
    coded = pa.chunked_array([names_x, names_y]).combine_chunks().dictionary_encode()
    ids, width = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    _, i, j = np.intersect1d(rx * width + ids[: len(rx)], ry * width + ids[len(rx) :], assume_unique=True, return_indices=True)
    return rx[i], cx[i].astype(float), cy[j].astype(float), (nx, rx, cx.astype(float)), (ny, ry, cy.astype(float))


@F.arrow_udf(DoubleType())
def packed_cosine(x: pa.Array, y: pa.Array) -> pa.Array:
    """`similarity.cosine` of packed lists."""
    row, p, q, (_, rx, cx), (_, ry, cy) = _met(x, y)
    n = len(x)
    dot, norm_x, norm_y = np.bincount(row, p * q, n), np.bincount(rx, cx * cx, n), np.bincount(ry, cy * cy, n)
    both = np.sqrt(norm_x) * np.sqrt(norm_y)
    return pa.array(np.divide(dot, both, out=np.zeros(n), where=both > 0))


@F.arrow_udf(DoubleType())
def packed_jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
    """Jaccard of packed sets, 1 for two empty ones."""
    row, _, _, (nx, *_), (ny, *_) = _met(x, y)
    shared = np.bincount(row, minlength=len(x)).astype(float)
    union = nx + ny - shared
    return pa.array(np.divide(shared, union, out=np.ones(len(x)), where=union > 0))


def _fingerprints(lists: pa.Array) -> np.ndarray:
    """FNV-1a over each list's (mnemonic, count) entries, one byte of all lists at a time: unsigned, 0 for an empty or null list."""
    sizes = np.diff(lists.offsets.to_numpy()) * lists.is_valid().to_numpy(zero_copy_only=False)
    entries = lists.flatten()  # null lists have none
    words, counts = entries.field("mnemonic").cast(pa.binary()), entries.field("count").to_numpy().astype(np.uint64)
    offsets, data = (np.frombuffer(x, t) if x else np.zeros(1, t) for x, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
    starts, ends = offsets[words.offset : words.offset + len(words)].astype(np.int64), offsets[words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
    # each list as one run of numbers: the bytes of a mnemonic, then its count
    of_entry = ends - starts + 1
    last = np.cumsum(of_entry)
    numbers = np.zeros(last[-1] if len(last) else 0, np.uint64)
    own = np.ones(len(numbers), bool)
    own[last - 1] = False
    numbers[own] = data[np.repeat(starts - (last - of_entry), of_entry)[own] + np.flatnonzero(own)]
    numbers[last - 1] = counts
    end_of_list = np.append(0, last)[np.cumsum(sizes)]
    start_of_list = np.append(0, last)[np.cumsum(sizes) - sizes]
    hashes = np.full(len(sizes), FNV_START, np.uint64)
    longest_first = np.argsort(start_of_list - end_of_list, kind="stable")
    lengths = (end_of_list - start_of_list)[longest_first]
    at = start_of_list[longest_first]
    running = hashes[longest_first]
    for k in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -k, side="left"))  # lists with more than k numbers
        running[:n] = (running[:n] ^ numbers[at[:n] + k]) * np.uint64(FNV_PRIME)
    hashes[longest_first] = np.where(running == 0, np.uint64(1), running)
    hashes[sizes == 0] = 0
    return hashes


@F.arrow_udf(LongType())
def histogram_fingerprint(hist: pa.Array) -> pa.Array:
    """64-bit hash of a counted list as a signed number; 0 for an empty one. (BIGINT arithmetic does not wrap under ANSI rules.)"""
    return pa.array(_fingerprints(hist).view(np.int64))


SIGNATURE = ("bb_count", "size", "out_degree", "fingerprint")


def anchor_set(string_refs="string_refs", imports="imports", callee_names="callee_names") -> Column:
    return F.array_distinct(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (string_refs, imports, callee_names))))


def decode_f32_bits(bits: Column) -> Column:
    """The value of a 32-bit float from its bits, exactly; null for bits that are no finite number."""
    sign = F.when(F.shiftright(bits, 31).bitwiseAND(1) == 1, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF).cast("double")
    normal = (1.0 + mantissa / 8388608.0) * F.pow(F.lit(2.0), exponent - 127)
    return F.when(exponent == 255, F.lit(None)).when(exponent == 0, sign * mantissa * F.pow(F.lit(2.0), F.lit(-149))).otherwise(sign * normal)


def vector_weights(vector: Column) -> Column:
    """(hash, weight) entries of a finite vector without repeated hashes; null for any other."""
    decoded = F.transform(vector, lambda e: F.struct(e["hash"].alias("hash"), decode_f32_bits(e["weight_bits"]).alias("weight")))
    bad = F.exists(decoded, lambda e: e["weight"].isNull()) | (F.size(F.array_distinct(F.transform(vector, lambda e: e["hash"]))) < F.size(vector))
    return F.when(~bad, decoded)


def squared_norm(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"])


def in_degrees(call_edges: DataFrame) -> DataFrame:
    """(program_id, func_id, in_degree): different callers of each function that has any."""
    return call_edges.select("program_id", "dst_id", "src_id").distinct().groupBy("program_id", F.col("dst_id").alias("func_id")).agg(F.count("*").alias("in_degree"))


def trigram_set() -> Column:
    """The different trigrams; the whole list where it is shorter."""
    short = F.transform("mnemonics", lambda e: F.concat_ws(" ", F.array_repeat(e["mnemonic"], e["count"].cast("int"))))
    return F.when(F.size("trigrams") > 0, F.transform("trigrams", lambda e: e["mnemonic"])).when(F.size("mnemonics") > 0, F.array(F.concat_ws(" ", short))).otherwise(F.array().cast("array<string>"))


def with_baseline_features(functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """Trigram set and in-degree."""
    return functions.withColumn("trigram_set", trigram_set()).join(in_degrees(call_edges), ["program_id", "func_id"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
