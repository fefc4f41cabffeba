"""URL filters by temporal list join.

A list is a log of dated entries (pattern, action, listed_at): `block` and `allow` put a pattern on the list from that
instant on, `remove` takes it off; an entry stands until the next one for its pattern. Entries become validity intervals
[valid_from, valid_to), and every capture is judged by the intervals that hold at its fetch time: an as-of join.

A pattern is a host, which covers its subdomains, or host/path, which covers that path's segments and below. The most
specific pattern decides: more host labels, then more path segments. URLs are tried down to as many path segments as the
longest entry has. Everything is DataFrame operations. Distinct hosts are held
against the list's hosts first, so only captures of listed hosts go on, with the hosts that cover them. Captures and
intervals meet on (pattern, period), intervals being entered in each period that they touch between the first and last
fetch, so a pattern with a long history, or a host with a third of all captures, is spread over periods, and no capture is
compared with entries of other times; both joins are plain exchanges, so what is still hot is split.

Defined results: a null, empty or host-less URL, one whose host is no host name as it has over MAX_HOST characters, or a null fetch time, matches nothing and is not blocked;
very long paths are tried down to the list's depth; entries with a null pattern or
time or another action are ignored; of entries for one pattern at one instant, `remove` loses to `allow`, and that to
`block`; repeated captures return a row each; an empty list blocks nothing; further columns of captures pass through, but for
those named like an output column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_struct, table

PERIOD_S = 30 * 86_400
#: The most characters that a host name can have.
MAX_HOST = 253
OUT = ("host", "blocked", "action", "pattern", "since")


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def hosts_of(host: Column) -> Column:
    """(labels, covering) of a host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("labels"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("covering")))


def paths_of(path: Column, depth: int) -> Column:
    """(segments, path) of a path and those above it, down to `depth` segments."""
    parts = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, depth)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("segments"), F.array_join(F.concat(F.array(F.lit("")), F.slice(parts, 1, i)), "/").alias("path")))


def _normal(pattern: Column) -> Column:
    """A list entry as captures are read: its host in small letters, its path without empty segments."""
    parts = F.split(pattern, "/")
    return F.array_join(F.concat(F.array(F.lower(parts[0])), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x != "")), "/")


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of block and allow entries; valid_to is null while they stand."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    named = entries.select(_normal(F.col("pattern")).alias("pattern"), "listed_at", rank.alias("rank")).where("pattern <> '' and listed_at is not null and rank is not null")
    one = named.groupBy("pattern", "listed_at").agg(F.max("rank").alias("rank"))
    until = F.lead("listed_at").over(W.partitionBy("pattern").orderBy("listed_at"))
    spans = one.select("pattern", "rank", F.col("listed_at").alias("valid_from"), until.alias("valid_to"))
    return spans.where("rank > 0").select("pattern", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to")


def list_depth(entries: DataFrame) -> int:
    """The greatest number of path segments of any entry."""
    parts = F.filter(F.split("pattern", "/"), lambda x: x != "")
    return max(0, (entries.agg(F.max(F.size(parts))).first()[0] or 0) - 1)


def judge_urls(captures: DataFrame, entries: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """captures: url, fetched_at and more. Adds host, blocked, and the deciding entry's action, pattern and start."""
    seconds = lambda c: F.floor(F.unix_micros(c) / (period_s * 1_000_000))
    seen = captures.where("fetched_at is not null").select("url", "fetched_at").distinct().withColumn("host", url_host(F.col("url"))).where((F.col("host") != "") & (F.length("host") <= MAX_HOST))
    listed = entries.select(_normal(F.col("pattern")).alias("pattern")).select(F.substring_index("pattern", "/", 1).alias("covering")).where("covering <> ''").distinct()
    hosts = captures.select(url_host(F.col("url")).alias("host")).where((F.col("host") != "") & (F.length("host") <= MAX_HOST)).distinct()
    covered = hosts.select("host", F.explode(hosts_of(F.col("host"))).alias("h")).select("host", "h.*").join(listed, "covering")
    of_host = covered.groupBy("host").agg(F.collect_list(F.struct("labels", "covering")).alias("covers"))  # at most one for each of a host's labels
    keys = seen.join(of_host, "host").select("url", "fetched_at", F.explode("covers").alias("h"), seconds(F.col("fetched_at")).alias("period"))
    keys = keys.select("url", "fetched_at", "h.*", "period", F.explode(paths_of(url_path(F.col("url")), list_depth(entries))).alias("p")).select("url", "fetched_at", "period", "labels", "p.segments", F.concat("covering", "p.path").alias("pattern"))
    first, last = captures.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    spans = validity(entries)
    if first is None:
        spans = spans.limit(0).withColumn("period", F.lit(0).cast("long"))
    else:
        lo, hi = F.lit(first), F.lit(last)
        spans = spans.where((F.col("valid_from") <= hi) & (F.coalesce(F.col("valid_to"), hi) >= lo))
        spans = spans.withColumn("period", F.explode(F.sequence(seconds(F.greatest("valid_from", lo)), seconds(F.least(F.coalesce("valid_to", hi), hi)))))
    held = keys.join(spans, ["pattern", "period"]).where((F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    best = held.groupBy("url", "fetched_at").agg(F.max(F.struct("labels", "segments", "action", "pattern", F.col("valid_from").alias("since"))).alias("best"))
    names = [c for c in captures.columns if c.lower() not in OUT]
    out = captures.select("url", "fetched_at", row_struct(captures, *(c for c in captures.columns if c not in names)).alias("row")).join(best, ["url", "fetched_at"], "left")
    return out.select(*(F.col("row")[c].alias(c) for c in names), F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), "best.action", "best.pattern", "best.since")


def page_captures(pages: DataFrame) -> DataFrame:
    """The table has no fetch times: page_id stands for one, spread over 2024."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 37, F.lit(366)) * 86400 + F.pmod(F.col("page_id"), F.lit(24)) * 3600)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list over the sites of the table itself, dated by digits of each pattern's MD5: sites are blocked, some are taken off or
    blocked again later; some mobile hosts and language paths are allowed."""
    host = url_host(F.col("url"))
    site, path = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1), F.regexp_extract(url_path(F.col("url")), r"^(/[^/]+)", 1)
    digit = lambda c, at, n: F.conv(F.substring(F.md5(c), at, n), 16, 10).cast("long")
    day = lambda d: F.timestamp_seconds(F.lit(1704067200) + d * 86400)
    of = pages.select(host.alias("host"), site.alias("site"), F.concat(site, path).alias("below"), path.alias("path")).where("site <> ''").distinct()
    sites = of.select(F.col("site").alias("pattern")).distinct()
    kind, start = digit("pattern", 1, 2), F.pmod(digit("pattern", 3, 4), F.lit(250))
    blocked = sites.where(kind < 128).select("pattern", F.lit("block").alias("action"), day(start).alias("listed_at"))
    removed = sites.where(kind < 64).select("pattern", F.lit("remove").alias("action"), day(start + 40).alias("listed_at"))
    again = sites.where(kind < 32).select("pattern", F.lit("block").alias("action"), day(start + 80).alias("listed_at"))
    below = of.where("path <> ''").select(F.col("below").alias("pattern")).distinct()
    allowed = below.where(kind < 40).select("pattern", F.lit("allow").alias("action"), day(start).alias("listed_at"))
    mobile = of.where("host <> site").select(F.col("host").alias("pattern")).distinct().where(kind < 100).select("pattern", F.lit("allow").alias("action"), day(start).alias("listed_at"))
    return blocked.unionByName(removed).unionByName(again).unionByName(allowed).unionByName(mobile)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    got = judge_urls(page_captures(pages), dated_list(pages))
    return got.select("page_id", "host", "blocked", "action", "pattern", F.unix_seconds("since").alias("since_s"))


OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, url, 1704067200 + ((page_id * 37) % 366) * 86400 + (page_id % 24) * 3600 AS at_s,
         lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages
), known AS (
  SELECT DISTINCT host, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS site, parts[1] AS part FROM captures
), hashed AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 2))::BIGINT AS kind, (('0x' || substr(md5(pattern), 3, 4))::BIGINT) % 250 AS start
  FROM (SELECT DISTINCT 'site' AS what, site AS pattern FROM known WHERE site <> ''
        UNION SELECT 'below', site || '/' || part FROM known WHERE site <> '' AND part IS NOT NULL
        UNION SELECT 'mobile', host FROM known WHERE site <> '' AND host <> site)
), entries AS (
  SELECT pattern, 2 AS rank, start AS d FROM hashed WHERE what = 'site' AND kind < 128
  UNION ALL SELECT pattern, 0, start + 40 FROM hashed WHERE what = 'site' AND kind < 64
  UNION ALL SELECT pattern, 2, start + 80 FROM hashed WHERE what = 'site' AND kind < 32
  UNION ALL SELECT pattern, 1, start FROM hashed WHERE what = 'below' AND kind < 40
  UNION ALL SELECT pattern, 1, start FROM hashed WHERE what = 'mobile' AND kind < 100
), spans AS (
  SELECT pattern, rank, 1704067200 + d * 86400 AS from_s, lead(1704067200 + d * 86400) OVER (PARTITION BY pattern ORDER BY d) AS to_s
  FROM (SELECT pattern, d, max(rank) AS rank FROM entries GROUP BY ALL)
), labels AS (
  SELECT page_id, at_s, string_split(host, '.') AS l, parts FROM captures WHERE host <> '' AND length(host) <= 253
), keys AS (
  SELECT page_id, at_s, i, j, array_to_string(l[len(l) - i + 1:], '.') || CASE WHEN j = 0 THEN '' ELSE '/' || array_to_string(parts[1:j], '/') END AS pattern
  FROM (SELECT *, unnest(range(0, len(parts) + 1)) AS j FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labels))
), held AS (
  SELECT page_id, max({'i': i, 'j': j, 'action': CASE rank WHEN 2 THEN 'block' ELSE 'allow' END, 'pattern': k.pattern, 's': from_s}) AS best
  FROM keys k JOIN spans s ON k.pattern = s.pattern AND rank > 0 AND at_s >= from_s AND (to_s IS NULL OR at_s < to_s)
  GROUP BY page_id
)
SELECT page_id, host, coalesce(best.action = 'block', false) AS blocked, best.action AS action, best.pattern AS pattern, best.s AS since_s
FROM captures LEFT JOIN held USING (page_id)
"""
