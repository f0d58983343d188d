"""Merkle manifest of a dataset: an append log of tree nodes in postorder, and inclusion proofs read from it.

Every row is a leaf, hashed over its columns. Leaves of one tree (rows of one language) ascend; every 2
consecutive nodes become their hash, a last one alone too, until one remains: the subroot. Subroots, in
order, make the top tree likewise, and its root stands for the dataset.

Builders take aligned blocks of 2^levels nodes and write what they make in the order of completion, leaf by
leaf, so that the log is the tree in postorder. Before the leaf of number e is written, e leaves and all nodes
complete by then are: 2 e - popcount(e) nodes. The node of level i that ends with leaf e follows i places on,
also along the right edge, where nodes are incomplete. So place = 2 e - popcount(e) + i for every node,
which follows from subtree sizes alone, and proofs find siblings in the log by that number, without links. A
block's nodes are one stretch of the log, so a proof reads its own block's stretch and, above it, a
few nodes that all leaves of the block share.

Nothing passes whole through one task: leaves are numbered by a range partition and counts per partition, a
builder gets 2^levels nodes, and each round of builders leaves 2^-levels as many.

Defined cases: null columns hash as `-`, and a null language is a tree of its own, before all others; rows of one
language and id (null ids first) go by their leaves' hashes; repeated rows are leaves each; an empty table has no
rows and no root; a tree of one leaf has that leaf as its subroot; a leaf without siblings has the hash of
nothing as its proof; columns beyond the hashed ones do not count.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbuild.llm.common import stored

LEVELS = 10  # of a builder's block
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, place bigint, level int, number bigint, leaves bigint, digest string"
_ROW = (1 << 33) - 1  # of monotonically_increasing_id: the row within its partition


def digest_of(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns: `-` for null, else byte count, `:`, value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def tree_of(column: str) -> Column:
    """A tree's key, never null; keys order as the column does, null first and else by bytes."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves (with `tree`) stored, with number: the place of each in its tree by `order`; and leaves: how many its tree has.

    A range partition of all rows, then counts per partition and tree: no tree is ordered in one task.
    """
    table = stored(leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = table.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("tree")  # as many rows as the tree has partitions
    ahead = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    sizes = stored(sizes.select("tree", "_part", (ahead - F.col("_first").bitwiseAND(F.lit(_ROW))).alias("_skip"), F.sum("_n").over(whole).alias("leaves")), "merkle-sizes")
    rows = table.withColumn("_part", part).join(sizes, ["tree", "_part"])
    return rows.withColumn("number", F.col("_at").bitwiseAND(F.lit(_ROW)) + F.col("_skip")).drop("_at", "_part", "_skip")


def _place(last: int, level: int) -> int:
    """In the log: of the node of this level whose last leaf has this number."""
    return 2 * last - last.bit_count() + level


def _nodes(leaves: int, level: int) -> int:
    """How many nodes of this level a tree of so many leaves has."""
    return -(-leaves >> level)


def height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def built_block(digests: list[str], first: int, base: int, leaves: int, levels: int = LEVELS) -> list[tuple[int, int, int, str]]:
    """(place, level, number, digest) of the nodes above these, in the order of completion.

    digests: consecutive nodes of level `base` from number `first` on, all of one aligned block. Nodes of level `base` itself are
    given again when it is 0: that is when they are written.
    """
    out, open_, top = [], [], min(base + levels, height(leaves))  # open_: by level above base, the digest that waits for its sibling
    count = _nodes(leaves, base)
    for k, d in enumerate(digests):
        number, level = first + k, base
        last = min((number + 1) << base, leaves) - 1
        if not base:
            out.append((_place(last, 0), 0, number, d))
        while level < top and (number & 1 or number == count - 1 >> level - base):
            d = sha256((open_.pop() + d if number & 1 else d).encode()).hexdigest()
            number, level = number >> 1, level + 1
            out.append((_place(last, level), level, number, d))
        if level < top:
            open_.append(d)
    return out


def _is_root() -> Column:
    """Of a log's rows: the node that its tree ends with."""
    before = F.col("leaves") - 1
    return (F.col("number") == 0) & (F.col("place") == 2 * before - F.bit_count(before) + F.col("level"))


def _builder(base: int, levels: int):
    def build(key, block):
        block = block.sort_by("number")
        leaves = block.column("leaves")[0].as_py()
        rows = built_block(block.column("digest").to_pylist(), block.column("number")[0].as_py(), base, leaves, levels)
        place, level, number, digest = zip(*rows, strict=True)
        own = {"tree": pa.array([key[0].as_py()] * len(rows), pa.string()), "place": pa.array(place, pa.int64()), "level": pa.array(level, pa.int32()), "number": pa.array(number, pa.int64())}
        return pa.table(own | {"leaves": pa.array([leaves] * len(rows), pa.int64()), "digest": pa.array(digest, pa.string())})

    return build


def build_log(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The stored append log (NODE) of all trees; leaves: tree, number, leaves, digest.

    Rounds of builders: the first reads leaves, the next the roots of blocks, while a tree has more than one node there.
    """
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    logs, nodes, base = [], leaves.select("tree", "leaves", "number", "digest"), 0
    while base == 0 or base < height(most):

        blocks = nodes.groupBy("tree", F.shiftright("number", levels).alias("_block"))
        logs.append(stored(blocks.applyInArrow(_builder(base, levels), NODE), "merkle-log"))
        base += levels
        nodes = logs[-1].where((F.col("level") == base) & ~_is_root()).select("tree", "leaves", "number", "digest")
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return log


def roots(log: DataFrame) -> DataFrame:
    return log.where(_is_root()).select("tree", "leaves", F.col("digest").alias("root"))


Way = list[tuple[bool, str | None]]  # for each level whether the sibling stands on the left, and its digest (None: the node is alone)
WAY = "array<struct<on_left:boolean,digest:string>>"
_WAY = pa.list_(pa.struct([("on_left", pa.bool_()), ("digest", pa.string())]))


def fold(digest: str, way: Way) -> str:
    """The root over a node."""
    for on_left, other in way:
        digest = sha256((other + digest if on_left else digest + (other or "")).encode()).hexdigest()
    return digest


def way_in_block(number: int, base: int, leaves: int, log: dict[int, str], levels: int = LEVELS) -> Way:
    """From a node of level `base` up to the root of its block, or of the tree; log: the block's stretch by place."""
    out = []
    for level in range(base, min(base + levels, height(leaves))):
        other = (number ^ 1) << level
        digest = log[_place(min(other + (1 << level), leaves) - 1, level)] if other < leaves else None
        out.append((bool(number & 1), digest))
        number >>= 1
    return out


def _climbed(nodes: DataFrame, log: DataFrame, base: int, above: DataFrame, keep: tuple[str, ...], made, ddl: str, levels: int) -> DataFrame:
    """made(kept columns of a block's nodes, its table, and the way of each node) for all blocks of nodes of one level.

    nodes: `keep`, tree, number, leaves. above: tree, block, way, from the root of each block on.
    """
    of_block = log.where(F.col("level").between(base, base + levels - 1)).withColumn("block", F.expr(f"shiftright(number, {base + levels} - level)"))
    parts = of_block.select("tree", "block", "place", "digest", F.lit(None).cast(WAY).alias("way"))
    parts = parts.unionByName(above.select("tree", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"), "way"))

    def extract(key, rows, stretch):
        place, digest = stretch.column("place").to_pylist(), stretch.column("digest").to_pylist()
        onward = next((x for x in stretch.column("way").to_pylist() if x is not None), [])
        onward, known = [(w["on_left"], w["digest"]) for w in onward], dict(zip(place, digest, strict=True))
        pairs = zip(rows.column("number").to_pylist(), rows.column("leaves").to_pylist(), strict=True)
        own = [rows.column(c).combine_chunks() for c in keep]
        return made(own, rows, [way_in_block(number, base, leaves, known, levels) + onward for number, leaves in pairs])

    rows = nodes.withColumn("block", F.shiftright("number", levels))
    return rows.groupBy("tree", "block").cogroup(parts.groupBy("tree", "block")).applyInArrow(extract, ddl)


def block_ways(log: DataFrame, most: int, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, block, way): from the root of each block of leaves to the end, band by band from the top, so that a node is read for its block alone.

    above: tree, way, from each tree's root on; most: the leaves of the largest tree.
    """
    ways = above.select("tree", F.lit(0).cast("long").alias("block"), "way")
    for base in range(levels, max(height(most), 1), levels)[::-1]:
        nodes = log.where((F.col("level") == base) | ((F.col("level") < base) & _is_root())).select("tree", "number", "leaves")

        def made(own, rows, found):
            listed = [[{"on_left": s, "digest": d} for s, d in w] for w in found]
            return pa.Table.from_arrays([*own, pa.array(listed, _WAY)], names=["tree", "block", "way"])

        ways = stored(_climbed(nodes, log, base, ways, ("tree", "number"), made, f"tree string, block long, way {WAY}", levels), "merkle-ways")
    return ways


def proofs(leaves: DataFrame, log: DataFrame, above: DataFrame, keep: tuple[str, ...], whole: bool = True, levels: int = LEVELS) -> DataFrame:
    """`keep`, and for every leaf the hash of its proof (all siblings, one after the other) and the root folded over what is claimed of it.

    leaves: `keep`, tree, number, leaves, claimed. above: tree, way, from each tree's root on. With `whole` also the way itself.
    """
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(*keep).schema), "proof_digest string, folded string", *([f"way {WAY}"] if whole else [])])

    def made(own, rows, found):
        digest = [sha256("".join(d for _, d in w if d).encode()).hexdigest() for w in found]
        folded = [fold(c, w) for c, w in zip(rows.column("claimed").to_pylist(), found, strict=True)]
        listed = [pa.array([[{"on_left": s, "digest": d} for s, d in w] for w in found], _WAY)] if whole else []
        return pa.Table.from_arrays([*own, pa.array(digest, pa.string()), pa.array(folded, pa.string()), *listed], names=[*keep, "proof_digest", "folded", *(["way"] if whole else [])])

    return _climbed(leaves.select(*keep, *(c for c in ("tree", "number", "leaves", "claimed") if c not in keep)), log, 0, block_ways(log, most, above, levels), keep, made, ddl, levels)


def manifest(docs: DataFrame, by: str = "lang", order: str = "doc_id", hashed: tuple[str, ...] = HASHED, claimed: Column | None = None, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, log, top): every row's leaf in its tree, the append log, and each tree's subroot, root and way up.

    leaves: order, leaf, claimed (a hash held against the proofs; the leaf where none is given), tree, number, leaves, digest.
    log: NODE, of the trees and of the one above them (tree ''). top: tree, subroot, root, way.
    """
    leaf = digest_of(*(F.col(c) for c in hashed))
    rows = docs.select(F.col(order).alias("id"), tree_of(by).alias("tree"), leaf.alias("digest"), F.coalesce(claimed, leaf).alias("claimed") if claimed is not None else leaf.alias("claimed"))
    leaves = stored(numbered(rows, "id", "digest", "claimed"), "merkle-leaves")
    log = build_log(leaves, levels)
    own = roots(log).select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("claimed"), F.col("root").alias("digest"))
    top_leaves = stored(numbered(own, "of"), "merkle-top")
    top_log = build_log(top_leaves, levels)
    nothing = roots(top_log).select("tree", F.array().cast(WAY).alias("way"))
    up = proofs(top_leaves, top_log, nothing, ("of", "digest"), levels=levels)
    top = stored(up.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), F.col("folded").alias("root"), "way"), "merkle-ways")
    return leaves, log.unionByName(top_log), top


def verified(leaves: DataFrame, log: DataFrame, top: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: its proof from the log, held against its claim."""
    rows = leaves.select("id", F.col("digest").alias("leaf"), "tree", "number", "leaves", "claimed")
    found = proofs(rows, log.where("tree <> ''"), top.select("tree", "way"), ("id", "leaf", "tree"), whole=False, levels=levels)
    known = found.join(top.select("tree", "subroot", "root"), "tree")
    return known.select("id", "leaf", "subroot", "root", F.col("proof_digest").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def verified_with(docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A manifest of docs (HASHED columns), and each row's proof held against `claimed` (a hash; where it is null or not given, the leaf)."""
    return verified(*manifest(docs, claimed=claimed, levels=levels), levels=levels)


_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# the query op12 over documents; crc32 goes byte by byte and bit by bit, since there is no such function
ORACLE = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="n_chars + 1")} AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x % 2) * 3988292384::BIGINT))), 4294967295::BIGINT) AS h
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, leaf, CASE WHEN h % 7 = 0 THEN other ELSE leaf END AS claimed FROM raw)),
nodes(lang, level, k, n, d) AS (
  SELECT lang, 0, k, n, leaf FROM leaves UNION ALL
  SELECT lang, level + 1, k // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM nodes WHERE n > 1 GROUP BY lang, level + 1, k // 2, (n + 1) // 2),
sub AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, k, n, d) AS (
  SELECT 0, k, n, d FROM sub UNION ALL
  SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM tops WHERE n > 1 GROUP BY level + 1, k // 2, (n + 1) // 2),
climb(doc_id, leaf, lang, level, k, n, folded, proof) AS (
  SELECT doc_id, leaf, lang, 0, k, n, claimed, '' FROM leaves UNION ALL
  SELECT u.doc_id, u.leaf, u.lang, u.level + 1, u.k // 2, (u.n + 1) // 2, sha256(CASE WHEN u.k % 2 = 1 THEN s.d || u.folded ELSE u.folded || coalesce(s.d, '') END), u.proof || coalesce(s.d, '')
  FROM climb u LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM u.lang AND s.level = u.level AND s.k = xor(u.k, 1) WHERE u.n > 1),
onward(doc_id, leaf, subroot, level, k, n, folded, proof) AS (
  SELECT u.doc_id, u.leaf, s.d, 0, s.k, s.n, u.folded, u.proof FROM climb u JOIN sub s ON s.lang IS NOT DISTINCT FROM u.lang WHERE u.n = 1 UNION ALL
  SELECT o.doc_id, o.leaf, o.subroot, o.level + 1, o.k // 2, (o.n + 1) // 2, sha256(CASE WHEN o.k % 2 = 1 THEN s.d || o.folded ELSE o.folded || coalesce(s.d, '') END), o.proof || coalesce(s.d, '')
  FROM onward o LEFT JOIN tops s ON s.level = o.level AND s.k = xor(o.k, 1) WHERE o.n > 1)
SELECT doc_id, leaf, subroot, (SELECT d FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT d FROM tops WHERE n = 1) AS verified FROM onward WHERE n = 1
"""
