"""The operators on the given tables, one query each, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinbuild.llm import decontamination, language_id, language_model, license_scan, merkle_manifest, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, token_counts, toxicity, url_filter
from twinbuild.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


YEAR_START, YEAR_SECONDS, DAY = 1_704_067_200, 31_536_000, 86_400


def captures(pages: DataFrame) -> DataFrame:
    """pages with a fetch time in the course of a year, which the id says (the table has none)."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(YEAR_START) + F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(YEAR_SECONDS))).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts, domains and first path parts of pages; a hash of the pattern gives kind and dates."""
    at = pages.select(url_filter.host_of(F.coalesce("url", F.lit(""))).alias("host"), url_filter.path_of(F.coalesce("url", F.lit(""))).alias("path")).where("host <> ''")
    first = F.filter(F.split("path", "/"), lambda p: p != "")
    kinds = at.select(
        F.explode(
            F.array(
                F.struct(F.col("host").alias("pattern"), F.lit("host").alias("kind")),
                F.struct(F.regexp_extract("host", r"(\.[^.].*)$", 1).alias("pattern"), F.lit("domain").alias("kind")),
                F.struct(F.when(F.size(first) > 0, F.concat("host", F.lit("/"), F.element_at(first, 1))).alias("pattern"), F.lit("path").alias("kind")),
            )
        ).alias("_e")
    )
    named = kinds.select("_e.*").where("pattern <> ''").distinct().withColumn("x", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("long"))
    x = F.col("x")

    def entry(action: str, op: str, day, when):
        return F.when(when, F.struct(F.lit(action).alias("action"), F.lit(op).alias("op"), F.timestamp_seconds(F.lit(YEAR_START) + day * DAY).alias("changed_at")))

    host, domain, path = (F.col("kind") == k for k in ("host", "domain", "path"))
    start = x % 300
    dated = F.array(
        entry("block", "add", start, host & (x % 3 != 2)), entry("block", "remove", start + 10 + x % 40, host & (x % 3 == 0)), entry("block", "add", start + 60 + x % 50, host & (x % 6 == 0)),
        entry("allow", "add", x % 200, domain), entry("allow", "remove", x % 200 + x % 90 + 5, domain),
        entry("allow", "add", x % 330, path & (x % 4 == 0)), entry("block", "add", x % 330, path & (x % 4 == 1)),
    )
    return named.select("pattern", F.explode(F.array_compact(dated)).alias("_d")).select("pattern", "_d.*")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_filter.url_verdicts(captures(pages), list_entries(pages))
    return judged.withColumn("fetched_at", F.unix_timestamp("fetched_at")).withColumnRenamed("fetched_at", "fetched_s")


OP1_ORACLE = """
WITH p AS (SELECT page_id, 1704067200 + (page_id * 7919) % 31536000 AS fetched_s,
  regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\\.', '') AS host,
  list_filter(string_split(regexp_extract(trim(coalesce(url, '')), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
k AS (SELECT DISTINCT pattern, kind, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS x FROM (
  SELECT host AS pattern, 'host' AS kind FROM p WHERE host <> '' UNION ALL
  SELECT regexp_extract(host, '(\\.[^.].*)$', 1), 'domain' FROM p WHERE host <> '' UNION ALL
  SELECT host || '/' || parts[1], 'path' FROM p WHERE host <> '' AND len(parts) > 0) WHERE pattern <> ''),
e AS (
  SELECT pattern, 'block' AS action, 'add' AS op, x % 300 AS day FROM k WHERE kind = 'host' AND x % 3 <> 2 UNION ALL
  SELECT pattern, 'block', 'remove', x % 300 + 10 + x % 40 FROM k WHERE kind = 'host' AND x % 3 = 0 UNION ALL
  SELECT pattern, 'block', 'add', x % 300 + 60 + x % 50 FROM k WHERE kind = 'host' AND x % 6 = 0 UNION ALL
  SELECT pattern, 'allow', 'add', x % 200 FROM k WHERE kind = 'domain' UNION ALL
  SELECT pattern, 'allow', 'remove', x % 200 + x % 90 + 5 FROM k WHERE kind = 'domain' UNION ALL
  SELECT pattern, 'allow', 'add', x % 330 FROM k WHERE kind = 'path' AND x % 4 = 0 UNION ALL
  SELECT pattern, 'block', 'add', x % 330 FROM k WHERE kind = 'path' AND x % 4 = 1),
m AS (SELECT p.page_id, e.pattern, e.action, max_by(e.op, e.day * 2 + (e.op = 'remove')::INT) AS op
  FROM p JOIN e ON p.host <> '' AND (e.pattern = p.host OR (starts_with(e.pattern, '.') AND ends_with('.' || p.host, e.pattern))
    OR (contains(e.pattern, '/') AND starts_with(p.host || '/' || array_to_string(p.parts, '/') || '/', e.pattern || '/')))
  WHERE 1704067200 + e.day * 86400 <= p.fetched_s GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY
    CASE WHEN contains(pattern, '/') THEN 2000000 WHEN starts_with(pattern, '.') THEN 0 ELSE 1000000 END + length(pattern) DESC, action = 'allow' DESC, pattern DESC, action DESC) AS rank,
    count(*) OVER (PARTITION BY page_id) AS n_active FROM m WHERE op = 'add')
SELECT p.page_id, p.host, p.fetched_s, coalesce(a.n_active, 0) AS n_active, a.pattern, a.action, coalesce(a.action <> 'block', TRUE) AS kept
FROM p LEFT JOIN a ON a.page_id = p.page_id AND a.rank = 1
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.piece_scores(_tokenizer("piece_bpe_32k.model")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = quality_classifier.fit_quality(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4), metadata=("n_chars",))
    scored = quality_classifier.score_quality(docs, known, metadata=("n_chars",))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "anomaly")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("doc_id")
    scored = language_model.score_documents(_table(spark, sf_dir, "documents"), ~held_out(out, 7))
    return scored.withColumn("held_out", held_out(out, 7))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.Banding(width=2))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    predicted = language_id.predict_language(docs, language_id.fit_language(docs, ~held_out(F.col("doc_id"), 4)))
    return predicted.withColumn("held_out", held_out(F.col("doc_id"), 4))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4))
    scored = toxicity.score_toxicity(docs, known)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose crc32 7 divides are held against their proofs with one more character than they have."""
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle_manifest.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    return merkle_manifest.verified(*merkle_manifest.manifest(docs, claimed=F.when(hit, tampered))).withColumnRenamed("id", "doc_id")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = periodic_runs.repeated_from(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periodic_runs.run_digest(periodic_runs.find_runs(turned))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_token_counts, op3_packing, op4_decontamination, op5_quality, op6_quality_rules, op7_language_model, op8_licenses, op9_near_duplicates, op10_language, op11_toxicity, op12_merkle_manifest, op13_periodic_runs, pipeline)
}
ORACLES = {"op1_url_filter": OP1_ORACLE, "op4_decontamination": decontamination.ORACLE, "op12_merkle_manifest": merkle_manifest.ORACLE}
