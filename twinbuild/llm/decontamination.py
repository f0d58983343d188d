"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

All of it is DataFrame expressions. A text's words are its runs of letters, digits and characters beyond
ASCII, in lower case for A-Z. An item's set holds its distinct shingles of `width` words, or its whole sequence as
one shingle where it is shorter; a document's holds its windows of `width` words, and of the lengths of such
short items as there are. So an item of two words is found in every document in which they stand side by side.

Short items in long documents share few of the documents' shingles, so the search is asymmetric: an
item's sketch holds the shingles that are least under each of `hashes` hash functions, and a document is a
candidate when its set holds any of them. An item whose containment is t is missed with probability
(1 - t)^hashes. Items are partitioned by size: a partition whose items have no more shingles than hashes
keeps them all, so that there nothing is missed; a candidate document must have enough shingles for the
least item of the partition. Shingles that more than `common_items` items share (a phrase that all
questions begin with) are no use as keys: an item that holds some is looked up by all its other shingles,
of which any document that contains 80 % of it has one, and only an item that consists of them to 80 % and
more by all it has. Candidates are then verified on the shingles themselves, pair by pair.

Documents are not sketched: their least hashes say next to nothing of a passage that is a hundredth of
them, so the whole document is probed. That reads each shingle once and makes the search exact on its side.

Defined cases: null or empty texts have no shingles and match nothing; rows of either table without an id are ignored; documents that share an id are one
document; items that share an id but not their words are looked for each; repeated documents and items are
reported once; other columns are ignored; an empty benchmark finds nothing. `without_leaks` judges every
row of its own, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinbuild.llm.common import keyed, stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, GAPS), lambda w: w != "")


def windows_of(words: Column, length: int) -> Column:
    """Every window of so many words, as a text; none where there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - (length - 1))
    joined = F.transform(at, lambda k: F.concat_ws(" ", *(F.element_at(words, k + j) for j in range(length))))
    return F.when(F.size(words) >= length, joined).otherwise(F.array().cast("array<string>"))


def item_shingles(words: Column, width: int) -> Column:
    """Distinct shingles; the whole sequence where it is shorter than one."""
    short = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(words) >= width, F.array_distinct(windows_of(words, width))).otherwise(short)


def item_sketches(items: DataFrame, hashes: int, common_items: int = 1000, threshold: float = 0.8) -> DataFrame:
    """(item, n_item, shingle) of each item's sketch; items has item and shingles."""
    rows = items.select("item", F.size("shingles").alias("n_item"), F.explode("shingles").alias("shingle"))
    common = stored(rows.groupBy("shingle").count().where(F.col("count") > common_items).select("shingle", F.lit(True).alias("_common")), "common-shingles")
    if not common.isEmpty():
        rows = rows.join(common, "shingle", "left")
        of_common = rows.where("_common").groupBy("item").agg(F.count("*").alias("_n_common"))
        rows = rows.join(of_common, "item", "left")
        rows = stored(rows.select("item", "n_item", "shingle", "_n_common", F.col("_common").isNull().alias("_rare")), "item-shingles")
        others = rows.where("_n_common is not null").where(F.col("_rare") | (F.col("_n_common") >= F.lit(threshold) * F.col("n_item"))).select("item", "n_item", "shingle")
        rows = rows.where("_n_common is null").select("item", "n_item", "shingle")
    few, many = rows.where(F.col("n_item") <= hashes), rows.where(F.col("n_item") > hashes)
    least = many.groupBy("item", "n_item").agg(F.array(*(F.min_by("shingle", F.struct(F.xxhash64("shingle", F.lit(k)), "shingle")) for k in range(hashes))).alias("least"))
    sketches = few.unionByName(least.select("item", "n_item", F.explode(F.array_distinct("least")).alias("shingle")))
    return sketches if common.isEmpty() else sketches.unionByName(others)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 5, threshold: float = 0.8, hashes: int = 12, broadcast_items: int = 100_000, broadcast_bytes: int = 64 << 20, common_items: int = 1000) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every item of which a document holds enough."""
    texts = benchmark.where("item_id is not null").select("item_id", F.explode(F.array(words_of(F.col("text")))).alias("words")).distinct()
    items = stored(texts.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("words").alias("n_words"), item_shingles(F.col("words"), width).alias("shingles")).where("n_words > 0"), "items")
    lengths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(width))).distinct().collect()) or [width]  # width numbers at most
    size = items.agg(F.count("*").alias("items"), F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda n, x: n + F.length(x) + 40)).alias("bytes")).first()  # of all shingles, as rows
    side = F.broadcast if size["items"] <= broadcast_items and (size["bytes"] or 0) <= broadcast_bytes else (lambda x: x)
    percent = round(threshold * 100)
    sketches = item_sketches(items, hashes, common_items, threshold).withColumn("key", F.xxhash64("shingle"))
    # the partition of an item: the power of two above its size; its documents have at least the share of its least size
    sketches = stored(sketches.withColumn("least_doc", F.ceil(F.lit(threshold) * F.pow(2.0, F.floor(F.log2("n_item"))))), "sketches")
    probes = sketches.groupBy("key").agg(F.min("least_doc").alias("least_doc"))

    # words go through explode: they are then made once a row, not again for every window
    words = docs.where("doc_id is not null").select("doc_id", F.explode(F.array(words_of(F.col(text)))).alias("words"))
    n = F.size("words")
    keys = F.concat(*(F.transform(windows_of(F.col("words"), k), lambda w: F.xxhash64(w)) for k in lengths))
    probed = words.select("doc_id", F.greatest(n - (width - 1), F.lit(1)).alias("n_doc"), F.explode(keys).alias("key"))
    hits = probed.join(side(probes), "key").where("n_doc >= least_doc").select("doc_id", "key").distinct()
    candidates = stored(hits.join(side(sketches.select("key", "item")), "key").select("doc_id", "item").distinct(), "candidates")

    ids = candidates.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= 2_000_000 else ids
    shingles = words.join(ids, "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(F.concat(*(windows_of(F.col("words"), k) for k in lengths)))).alias("shingle"))
    wanted = items.select(F.explode("shingles").alias("shingle")).distinct()
    held = shingles.join(side(wanted), "shingle", "left_semi").groupBy("doc_id").agg(F.collect_set("shingle").alias("held"))  # those of one document
    both = candidates.join(held, "doc_id").join(side(items), "item")
    shared = both.select("doc_id", "item_id", F.size(F.array_intersect("held", "shingles")).cast("long").alias("n_shared"), F.size("shingles").cast("long").alias("n_item"))
    found = shared.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).distinct()
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    rows = keyed(docs)
    leaks = contaminated(rows.select(F.col("key").alias("doc_id"), F.col(f"row.{text}").alias("text")), benchmark, **options)
    leaks = stored(leaks.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return rows.join(F.broadcast(leaks) if leaks.count() <= 2_000_000 else leaks, "key", "left_anti").select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, w FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT least(len(w), 5) AS l FROM i),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, lengths WHERE len(w) >= l)),
bs AS (SELECT DISTINCT item, item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item, item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i)),
sizes AS (SELECT item, count(*) AS n_item FROM bs GROUP BY item),
shared AS (SELECT doc_id, item, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item, item_id)
SELECT DISTINCT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item) WHERE n_shared * 100 >= n_item * 80
"""
