"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document's set holds the hashes of its distinct word shingles (ASCII letters in lower case, words between
ASCII blanks). Documents with the same set become one node. Nodes that share a band are candidates; their
signatures are compared batch by batch, and a pair is given up as soon as the posterior probability that
its similarity reaches the threshold falls below `miss` (Satuluri and Parthasarathy 2012). The first batch
is one bit of every hash and is part of the join, so pairs that fail it are never made. The survivors are
confirmed on their full sets.

Candidates come in two rounds. First every node of a band's bucket meets one node of it, the bucket's
centre: the node that shares most bands with others, which is the one that most copies were made from.
Then, only in buckets that still hold several components, nodes of different components meet if what sets
each of them apart from the centre allows a link. Almost always a link asks that both add the same shingle
to the centre's, so an index of added shingles (the rarest of each node: prefix filter) finds the pairs; how
many must be shared follows from both sizes and from how many shingles each node lacks. Pairs that could
link by what they lack alone are known by two numbers a node, and meet in squares of `block` x `block` nodes.
Both ways are exact (see `_across`). Small bit maps of the lacking and the added shingles bound the intersection
further before a pair is made. So a group of n near copies costs about n pairs, and no pair that shares a band
and could join two components goes untested. A node that very many pairs name (a centre) meets them by a
broadcast of its row.

Defined cases: a null or blank text has no shingles and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows without an id are linked with nothing and have no component;
repeated rows are one node; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from twinbuild.llm.common import by_bytes, keyed, slices, stored

DIFFERENCE_BITS = 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Banding:
    """bands x rows hashes; a pair at similarity s shares no band with probability (1 - s^rows)^bands."""

    width: int = 5
    threshold: float = 0.8
    bands: int = 40
    rows: int = 6
    miss: float = 1e-7
    seed: int = 9
    block: int = 1000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    words = [x.lower().split() for x in texts]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64, sum(map(len, words)))
    hashes = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number))[ids]
    out, at = [], 0
    for own in words:
        n = len(own)
        h, at = hashes[at : at + n], at + n
        k = min(width, n)
        x = h[: n - k + 1] if n else h
        for j in range(1, k):
            x = _mixed(x * _MIX[0] + h[j : n - k + 1 + j])
        out.append(np.unique(x))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    x = (_mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(least, (x[at : at + 256, None] * factors + terms).min(axis=0), out=least)
    return least


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest of n equal hashes at which P(similarity >= threshold) is still `miss` or more, from a flat prior."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def with_signatures(docs: DataFrame, how: Banding, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, and for texts with words: digest of the set, band keys, sketch bits, signature."""
    rng = np.random.default_rng(how.seed)
    factors = rng.integers(0, 1 << 32, how.hashes, dtype=np.uint32) | np.uint32(1)
    terms = rng.integers(0, 1 << 32, how.hashes, dtype=np.uint32)
    words = (how.hashes + 63) // 64

    def signed(batches):
        salt = np.arange(how.bands, dtype=np.uint64) * _MIX[0]
        for batch in batches:
            counts, digests, bands, sketches, whole = [], [], [], [], []
            for (texts,) in slices([batch], "_text", rows=256):
                for s in shingle_sets(texts, how.width):
                    counts.append(len(s))
                    if not len(s):
                        for x in (digests, bands, sketches, whole):
                            x.append(None)
                        continue
                    sig = signature(s, factors, terms)
                    key = salt
                    for row in sig.reshape(how.bands, how.rows).T:
                        key = _mixed(key + row)
                    bits = np.zeros(words * 64, np.uint8)
                    bits[: how.hashes] = (sig * np.uint32(0x9E3779B1)) >> np.uint32(31)
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(key.view(np.int64))
                    sketches.append(np.packbits(bits).view(np.int64))
                    whole.append((sig & np.uint32(0xFFFF)).astype("<u2").tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(whole, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch", "signature"],
            )

    return by_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))).mapInArrow(
        signed, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, signature binary"
    )


def _could_link(how: Banding, a: str, b: str) -> Column:
    """The set sizes allow the threshold, and enough sketch bits are equal: equal with probability (1 + s) / 2."""
    words = (how.hashes + 63) // 64
    needed = least_matches(how.hashes, (1 + how.threshold) / 2, how.miss)
    unequal = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(words)), F.lit(0))
    low, high = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (low >= F.lit(how.threshold - 1e-9) * high) & (unequal <= how.hashes - needed)


def bit_map(hashes: np.ndarray) -> list[int]:
    """DIFFERENCE_BITS bits, of which each hash sets one."""
    bits = np.zeros(DIFFERENCE_BITS, np.uint8)
    bits[(hashes % np.uint64(DIFFERENCE_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _bits(of) -> Column:
    return sum((F.bit_count(of(k)) for k in range(DIFFERENCE_BITS // 64)), F.lit(0))


def _most_shared(a: str, b: str) -> Column:
    """No two nodes share more shingles than this, by how each of them differs from one centre."""
    lacking = _bits(lambda k: F.col(f"{a}.lacks")[k].bitwiseOR(F.col(f"{b}.lacks")[k]))
    added = _bits(lambda k: F.col(f"{a}.adds")[k].bitwiseAND(F.col(f"{b}.adds")[k]))
    unseen = F.least(*(F.col(f"{x}.n_adds") - _bits(lambda k, x=x: F.col(f"{x}.adds")[k]) for x in (a, b)))  # hashes beyond one a bit
    return F.col(f"{a}.n_centre") - lacking + added + unseen


def _met(pairs: DataFrame, rows: DataFrame, key: str, size: Column, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pairs (stored) with the row of `rows` that has their `key`; keys with more pairs than a task has on average are broadcast, as far as those rows fit."""
    often = stored(pairs.groupBy(key).count(), "often")
    total = often.agg(F.sum("count")).first()[0] or 0
    hot = often.where(F.col("count") > max(1000, total // int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).select(key)
    hot = rows.join(F.broadcast(hot), key, "left_semi")  # fewer keys than there are partitions
    if not total or not 0 < (hot.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        return pairs.join(rows, key)
    hot = stored(hot, "hot")
    rest = pairs.join(F.broadcast(hot.select(key)), key, "left_anti").join(rows, key)
    return rest.unionByName(pairs.join(F.broadcast(hot), key))


def _plausible(pairs: DataFrame, nodes: DataFrame, how: Banding, batch_hashes: int = 40) -> DataFrame:
    """Sequential verification of pairs (a, b) on 16-bit hash values; gives those that no batch rules out."""
    ends = list(range(batch_hashes, how.hashes + 1, batch_hashes))
    needed = [least_matches(n, how.threshold, how.miss) for n in ends]
    own = nodes.select("node", "signature")
    both = _met(pairs, own.withColumnsRenamed({"node": "b", "signature": "_b"}), "b", F.length("_b")).join(own.withColumnsRenamed({"node": "a", "signature": "_a"}), "a")

    def compared(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), "<u2").reshape(-1, how.hashes) for c in ("_a", "_b"))
            alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for end, least in zip(ends, needed, strict=True):
                equal = equal + (x[alive, end - batch_hashes : end] == y[alive, end - batch_hashes : end]).sum(1)
                alive, equal = alive[equal >= least], equal[equal >= least]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return by_bytes(both.select("a", "b", "_a", "_b")).mapInArrow(compared, "a long, b long")


def _small(ids: DataFrame, at_most: int = 2_000_000) -> DataFrame:
    """ids, to be broadcast if they are few enough; else Spark joins them by a shuffle."""
    return F.broadcast(ids) if ids.count() <= at_most else ids


def _measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Banding, text: str) -> DataFrame:
    """The pairs, whether intersection >= threshold * union on their full sets, and how a differs from b."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "digest", "first_doc"), "node"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_doc"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    texts = texts.join(_small(wanted.select("first_doc").distinct()), "first_doc", "left_semi")

    def collected(batches):
        for (rows,) in slices(batches, "_text", rows=256):
            sets = [s.tobytes() for s in shingle_sets(rows, how.width)]
            yield pa.RecordBatch.from_arrays([pa.array([blake2b(s, digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    sets = stored(by_bytes(texts.select("_text")).mapInArrow(collected, "digest binary, shingles binary").join(wanted.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    both = _met(pairs, sets.withColumnsRenamed({"node": "b", "shingles": "_b"}), "b", F.length("_b")).join(sets.withColumnsRenamed({"node": "a", "shingles": "_a"}), "a")
    parts, longs = 100, pa.list_(pa.int64())
    least = round(how.threshold * parts)

    def measured(batches):
        for batch in batches:
            link, sizes, lacks, adds, added = [], [], [], [], []
            for xs, ys in slices([batch], "_a", "_b", rows=64):
                for x, y in zip(xs, ys, strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    new = np.setdiff1d(x, y, assume_unique=True)
                    shared = len(x) - len(new)
                    link.append(parts * shared >= least * (len(y) + len(new)))
                    sizes.append(len(y))
                    lacks.append(bit_map(np.setdiff1d(y, x, assume_unique=True)))
                    adds.append(bit_map(new))
                    added.append(new.view(np.int64))
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(link, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(lacks, longs), pa.array(adds, longs), pa.array(list(map(len, added)), pa.int32()), pa.array(added, longs)], names=["a", "b", "linked", "n_centre", "lacks", "adds", "n_adds", "added"])

    return by_bytes(both.select("a", "b", "_a", "_b")).mapInArrow(measured, "a long, b long, linked boolean, n_centre int, lacks array<long>, adds array<long>, n_adds int, added array<long>")


def _across(rows: DataFrame, how: Banding) -> DataFrame:
    """Pairs (a, b) of rows with one centre and different roots that may link; a row is a node and how it differs from a centre.

    Say x adds a and lacks l of the centre's shingles. The threshold allows x and y to differ in share * (|x| + |y|) shingles,
    where share = (1 - t) / (1 + t). What they differ in is what sets each apart from the centre less, twice, what both have
    of that; so they must have (over(x) + over(y)) / 2 of it in common, where over(x) = a + l - share * |x|. Lacking ones make up
    min(l(x), l(y)) of that at most. Either that is enough, which means over(y) <= under(x) and over(x) <= under(y), where
    under(x) = l - a + share * |x|; or they add a shingle that is the same. Two nodes that link with the centre have one root.
    """
    share = (1 - how.threshold) / (1 + how.threshold)
    lacking = F.col("n_centre") - F.col("n_shingles") + F.col("n_adds")
    rows = rows.withColumn("n_lacks", lacking).withColumn("over", F.col("n_adds") + F.col("n_lacks") - share * F.col("n_shingles")).withColumn("under", F.col("n_lacks") - F.col("n_adds") + share * F.col("n_shingles"))
    apart = lambda c: F.when(~F.col("linked"), F.col(c))
    ranges = rows.groupBy("centre").agg(F.min("over").alias("_low"), F.max("under").alias("_high"), F.min(apart("over")).alias("_low_apart"), F.max(apart("under")).alias("_high_apart"))
    partner = lambda c: F.when(F.col("linked"), F.col(f"{c}_apart")).otherwise(F.col(c))
    rows = rows.join(_small(stored(ranges, "ranges")), "centre").withColumn("_least", partner("_low")).withColumn("_most", partner("_high")).where("_least is not null")
    rows = stored(rows.drop("_low", "_high", "_low_apart", "_high_apart"), "apart")
    own = rows.drop("added", "linked", "_least", "_most")
    shared = _most_shared("a", "b")
    near = shared >= F.lit(how.threshold - 1e-9) * (F.col("a.n_shingles") + F.col("b.n_shingles") - shared)
    may = (F.col("a.root") < F.col("b.root")) & near & _could_link(how, "a", "b")

    needed = F.greatest(F.lit(1), F.ceil((F.col("over") + F.col("_least")) / 2 - F.col("n_lacks") - 1e-6)).cast("int")
    adding = rows.withColumn("_needed", needed).where("n_adds >= _needed").select("node", "centre", "_needed", F.explode("added").alias("shingle"))
    often = adding.groupBy("centre", "shingle").agg(F.count("*").alias("_n")).where("_n > 1")  # the others are rarer and first in the prefix
    of = Window.partitionBy("node", "centre")
    ranked = adding.join(often, ["centre", "shingle"]).withColumn("_at", F.row_number().over(of.orderBy("_n", "shingle"))).withColumn("_all", F.count("*").over(of))
    posted = stored(ranked.where("_at <= _all - _needed + 1").select("node", "centre", "shingle").join(own, ["node", "centre"]), "posted")
    a, b = posted.alias("a"), posted.alias("b")
    by_adding = a.join(b, (F.col("a.centre") == F.col("b.centre")) & (F.col("a.shingle") == F.col("b.shingle")) & may)

    lacks = rows.where("over <= _most + 1e-6 and under >= _least - 1e-6").select(*own.columns)
    cuts = lacks.groupBy("centre").agg(F.ceil(F.count("*") / how.block).cast("int").alias("_cuts")).where("_cuts > 1")
    lacks = stored(lacks.join(_small(stored(cuts, "cuts")), "centre", "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int")), "walked")
    every = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    a, b = lacks.select("*", F.col("_own").alias("_i"), every.alias("_j")).alias("a"), lacks.select("*", F.col("_own").alias("_j"), every.alias("_i")).alias("b")
    square = (F.col("a.centre") == F.col("b.centre")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    enough = (F.col("a.over") <= F.col("b.under") + 1e-6) & (F.col("b.over") <= F.col("a.under") + 1e-6)
    by_lacking = a.join(b, square & enough & may)
    pair = [F.col("a.node").alias("a"), F.col("b.node").alias("b")]
    return by_adding.select(*pair).unionByName(by_lacking.select(*pair)).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge (a, b): the root is the least node of its component.

    Each round hooks every node that has a lesser neighbour to the least of them, follows those hooks to
    their ends by pointer doubling, and contracts the edges; it takes about log(nodes) rounds.
    """
    left = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    found = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        hooks = stored(left.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "node"), "hooks")
        for _ in range(most_rounds):
            step = hooks.select(F.col("node").alias("to"), F.col("to").alias("_next"))
            jumped = stored(hooks.join(step, "to", "left").select("node", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")), "hooks")
            hooks = jumped.select("node", "to")
            if jumped.where("_moved").isEmpty():
                break
        else:
            raise RuntimeError("pointer doubling did not end")
        by = hooks.withColumnsRenamed({"node": "_from", "to": "_root"})
        if found is None:
            found = hooks
        else:
            moved = found.join(by, found["to"] == by["_from"], "left").select("node", F.coalesce("_root", "to").alias("to"))
            found = stored(moved.unionByName(hooks), "found")
        ends = left.join(by, left["a"] == by["_from"], "left").select(F.coalesce("_root", "a").alias("a"), "b")
        ends = ends.join(by, ends["b"] == by["_from"], "left").select("a", F.coalesce("_root", "b").alias("b"))
        left = stored(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = found.select(F.col("to").alias("node")).distinct().withColumn("to", F.col("node"))
    return found.unionByName(roots).distinct().withColumnRenamed("to", "root")


def near_duplicates(docs: DataFrame, how: Banding = Banding(), text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least id reachable over links), kept."""
    signed = stored(with_signatures(docs, how, text), "signatures")
    usable = signed.where("digest is not null and doc_id is not null")
    least = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch", "signature")).alias("_x"))
    nodes = stored(least.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("_x.doc_id").alias("first_doc"), "_x.n_shingles", "_x.bands", "_x.sketch", "_x.signature"), "nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    members = stored(keys.join(keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "key"), "shared")
    alike = members.groupBy("node").agg((-F.sum("_n")).alias("_far"))
    centres = members.join(alike, "node").groupBy("key").agg(F.min(F.struct("_far", F.xxhash64("node").alias("_at"), "node")).alias("_c")).select("key", F.col("_c.node").alias("centre"))
    members = stored(members.drop("_n").join(centres, "key"), "members")
    facts = nodes.select("node", "n_shingles", "sketch")

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches allow."""
        x = _met(stored(pairs, "pairs"), facts.select(F.col("node").alias("b"), F.struct("n_shingles", "sketch").alias("_y")), "b", F.lit(64))
        return x.join(facts.select(F.col("node").alias("a"), F.struct("n_shingles", "sketch").alias("_x")), "a").where(_could_link(how, "_x", "_y")).select("a", "b")

    def measured(pairs: DataFrame) -> DataFrame:
        likely = stored(_plausible(stored(pairs, "met"), nodes, how), "likely")  # the walk over buckets goes once
        return stored(_measured(likely, nodes, docs, how, text), "links")

    links = lambda x: x.where("linked").select("a", "b")
    first = measured(met(members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()))
    roots = stored(components(links(first)), "roots")
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("key")
    open_members = stored(placed.join(mixed, "key").where("node <> centre").select("node", "centre", "root").distinct(), "open")
    # pairs with a centre that the signatures ruled out say how a node differs from it, too
    unmeasured = stored(open_members.select(F.col("node").alias("a"), F.col("centre").alias("b")).join(first, ["a", "b"], "left_anti"), "unmeasured")
    known = first.unionByName(stored(_measured(unmeasured, nodes, docs, how, text), "links"))
    left = open_members.join(known.withColumnsRenamed({"a": "node", "b": "centre"}), ["node", "centre"])
    second = measured(_across(left.join(facts, "node"), how))
    roots = components(links(first).unionByName(links(second)))

    roots = stored(roots, "roots")
    least_doc = stored(nodes.select("node", "first_doc").join(roots, "node").groupBy("root").agg(F.min("first_doc").alias("component_id")), "least")
    named = nodes.select("node", "digest", "first_doc").join(roots, "node", "left").join(_small(least_doc), "root", "left")
    known = stored(named.select("digest", F.coalesce("component_id", "first_doc").alias("component_id")), "classes")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, judged: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay: one for each component, and every row without an id."""
    rows = judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    rows = stored(rows, "kept")

    def of(ids: DataFrame) -> DataFrame:
        ids = _small(ids)
        return docs.join(ids, docs["doc_id"] == ids["doc_id"], "left_semi")

    once, again = of(rows.where("_rows = 1").select("doc_id")), of(rows.where("_rows > 1").select("doc_id"))
    return once.unionByName(again.dropDuplicates(["doc_id", text])).unionByName(docs.where("doc_id is null"))


def deduplicated(docs: DataFrame, how: Banding = Banding(), text: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns: of each group of near copies the one with the least doc_id (null last), of equals any.

    Rows are linked and chosen by a key of their own, so rows without an id and rows that share one are judged like all others.
    """
    rows = keyed(docs)
    judged = near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col(f"row.{text}").alias("text")), how).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    own = stored(judged.join(rows.select("key", F.col("row.doc_id").alias("id")), "key"), "groups")
    first = own.groupBy("group").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("_first"))
    stay = stored(first.where("_n > 1").select(F.col("_first.key").alias("key"), "group"), "stay")
    gone = own.join(_small(stay.select("group")), "group", "left_semi").join(_small(stay.select("key")), "key", "left_anti").select("key")
    return rows.join(_small(stored(gone, "gone")), "key", "left_anti").select("row.*")
