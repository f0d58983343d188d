"""URL filters: captures against dated block and allow lists, as the lists stood at fetch time.

All of it is DataFrame expressions. A list entry is (pattern, action, changed_at, op): `pattern` is a host
(`a.example.com`), a domain (`.example.com`, which covers its subdomains) or a host with a path
(`a.example.com/x`, which covers what lies under it); `action` is `block` or `allow`; `op` is `add` or
`remove`. The dated entries of one pattern and action become validity intervals [from, until). The as-of
join meets every capture with the intervals of the patterns that its URL can match, and keeps those that
hold its fetch time. Of the active entries the most specific pattern decides, and `allow` wins a tie.

Captures are stored under a row key first, so the key is the same when an executor is lost. Of a URL's path only
as many leading parts are asked for as the longest listed path has.

Hot hosts: a capture asks with its few patterns, and its rows are salted; the intervals are copied to
each salt, or broadcast where they are few. A pattern's intervals are split at month borders, so that a
capture meets only those of its own month.

Defined cases: a null, empty or hostless URL has no host and no verdict but `kept`; a capture without a
fetch time meets no entry; entries with a null pattern, action or date are ignored; entries of one pattern
and action at the same moment count as one, and removal wins; repeated captures are answered each; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinbuild.llm.common import stored

SALTS = 16
FOREVER = "9999-01-01 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a leading www."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment, `/` where there is none."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _patterns(host: Column, path: Column, depth: int) -> Column:
    """The patterns that cover the URL: the host, its domains, and the host with each of the first `depth` leading parts of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    paths = F.when((F.size(parts) > 0) & (F.lit(depth) > 0), F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(F.array(host), domains, paths))).otherwise(F.array().cast("array<string>"))


def _specific(pattern: Column) -> Column:
    """Paths before hosts before domains, longer ones first."""
    return F.when(pattern.contains("/"), 2_000_000).when(pattern.startswith("."), 0).otherwise(1_000_000) + F.length(pattern)


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_until): one row per time that an entry was on a list."""
    dated = entries.where("pattern is not null and action in ('block', 'allow') and changed_at is not null").groupBy("pattern", "action", "changed_at").agg(F.max(F.col("op") == "remove").alias("gone"))
    own = Window.partitionBy("pattern", "action").orderBy("changed_at")
    turns = dated.withColumn("was", F.lag("gone").over(own)).where("was is null or was <> gone")
    spans = turns.withColumn("valid_until", F.coalesce(F.lead("changed_at").over(own), F.lit(FOREVER).cast("timestamp")))
    return spans.where("not gone").select("pattern", "action", F.col("changed_at").alias("valid_from"), "valid_until")


def url_verdicts(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at", broadcast_spans: int = 100_000) -> DataFrame:
    """key, host, fetch time, number of active entries, the deciding pattern and action, kept."""
    rows = stored(captures.select(F.monotonically_increasing_id().alias("_row"), F.col(key), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("_path"), F.col(fetched).alias("fetched_at")), "captures")
    spans = stored(validity(entries), "spans")
    dates = rows.agg(F.min("fetched_at").alias("low"), F.max("fetched_at").alias("high")).first()
    deepest = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0  # no listed path has more parts, so none further down can match
    month = lambda at: F.date_trunc("month", at)
    if dates["low"] is None:
        monthly = spans.where("false").withColumn("_month", month(F.col("valid_from")))
    else:
        low, high = F.lit(dates["low"]).cast("timestamp"), F.lit(dates["high"]).cast("timestamp")
        inside = spans.where((F.col("valid_until") > low) & (F.col("valid_from") <= high))
        monthly = inside.withColumn("_month", F.explode(F.sequence(month(F.greatest("valid_from", low)), month(F.least("valid_until", high)), F.expr("interval 1 month"))))
    asked = rows.select("_row", "fetched_at", month(F.col("fetched_at")).alias("_month"), F.explode(_patterns(F.col("host"), F.col("_path"), deepest)).alias("pattern"))
    if monthly.count() <= broadcast_spans:
        met = asked.join(F.broadcast(monthly), ["pattern", "_month"])
    else:
        salted = monthly.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = asked.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "_month", "_salt"])
    active = met.where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("fetched_at") < F.col("valid_until")))
    best = F.struct(_specific(F.col("pattern")).alias("at"), (F.col("action") == "allow").alias("allows"), "pattern", "action")
    decided = active.groupBy("_row").agg(F.count("*").alias("n_active"), F.max(best).alias("_best"))
    out = rows.join(decided, "_row", "left")
    return out.select(key, "host", "fetched_at", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("_best.pattern").alias("pattern"), F.col("_best.action").alias("action"), F.coalesce(F.col("_best.action") != "block", F.lit(True)).alias("kept"))
