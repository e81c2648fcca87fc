"""URL filter with dated lists: which entries held when a page was fetched.

List entries are dated: an ``add`` puts a pattern on a list, a ``remove`` takes
it off. Each ``add`` becomes a validity interval that ends with the pattern's
next entry. A pattern is a host, which stands for its subdomains too, or a host
and the first part of a path. A capture is held against the intervals that
contain its time of fetching; the longest pattern decides, ``allow`` before
``block``.

The span of the captures is cut into ``BUCKETS`` stretches of time (or into
stretches of ``bucket_seconds``): a pattern with a third of all captures, or a
third of all entries, is spread over them, an entry that holds for years is a
row of ``BUCKETS`` at most, and within a stretch Spark may split the join further
as it is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import table
from rollspark.plans.index import hashed_index

DAY = 86_400
BUCKETS = 128


def host(url) -> Column:
    """Lower-case host name without user, port and closing dot; empty if there is none."""
    raw = F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.regexp_replace(F.lower(raw), r"\.$", "")


def section(url) -> Column:
    """First part of the path; empty if there is none."""
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def url_patterns(url) -> Column:
    """The patterns that can stand for a URL: its host and each parent of two labels at least, alone and with the section."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    sec = section(url)
    both = F.concat(hosts, F.when(sec != "", F.transform(hosts, lambda h: F.concat(h, F.lit("/"), sec))).otherwise(F.array().cast("array<string>")))
    return F.when(host(url) != "", both).otherwise(F.array().cast("array<string>"))


def seconds(time: str) -> Column:
    """Epoch seconds; a time without a zone counts in the session's zone."""
    return F.unix_seconds(F.col(time).cast("timestamp"))


def _bucket(second: Column, width: int | Column) -> Column:
    return F.floor(second / width)


def intervals(entries: DataFrame, bucket_seconds: int | Column = DAY) -> DataFrame:
    """(list, pattern, valid_from, valid_to) in epoch seconds from (list, pattern, action, ts); valid_to null: still on.

    Entries of one pattern in one second count as one; a removal wins. The next
    entry is looked up within a bucket, and across buckets over one row a
    bucket, so no task sorts all entries of a pattern.
    """
    e = (entries.where("pattern is not null and ts is not null and action in ('add', 'remove')")
         .groupBy("list", "pattern", seconds("ts").alias("s")).agg(F.max("action").alias("action"))
         .withColumn("b", _bucket(F.col("s"), bucket_seconds)))
    inside = Window.partitionBy("list", "pattern", "b").orderBy("s")
    firsts = e.groupBy("list", "pattern", "b").agg(F.min("s").alias("first"))
    firsts = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("list", "pattern").orderBy("b")))
    e = e.withColumn("next", F.lead("s").over(inside))
    joined = e.join(firsts.select(F.col("list").alias("l2"), F.col("pattern").alias("p2"), F.col("b").alias("b2"), "after"),
                    F.col("list").eqNullSafe(F.col("l2")) & (F.col("pattern") == F.col("p2")) & (F.col("b") == F.col("b2")))
    return joined.where("action = 'add'").select("list", "pattern", F.col("s").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))


def verdicts(captures: DataFrame, entries: DataFrame, bucket_seconds: int | None = None) -> DataFrame:
    """One row per distinct capture (``page_id``, ``url``, ``fetched_at``).

    ``n_rows`` repeated rows, ``n_active`` entries that held, the deciding
    ``rule`` with its ``rule_list`` and ``rule_since``, and ``kept``. A capture
    without a usable host or time meets no entry and is kept. Null ids are kept
    apart from others. Columns besides those named are not read.
    """
    span = captures.agg(F.min(seconds("fetched_at")).alias("lo"), F.max(seconds("fetched_at")).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    if bucket_seconds is None:
        bucket_seconds = F.coalesce(F.ceil((hi - lo + 1) / BUCKETS), F.lit(1))
    caps = captures.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n_rows"))
    at = caps.where("url is not null and fetched_at is not null").withColumn("s", seconds("fetched_at"))
    asked = at.select("page_id", "url", "fetched_at", "s", F.explode(F.array_distinct(url_patterns("url"))).alias("pattern")) \
        .withColumn("b", _bucket(F.col("s"), bucket_seconds))
    iv = (intervals(entries, bucket_seconds).where((F.col("valid_from") <= hi) & (F.coalesce("valid_to", hi + 1) > lo))
          .withColumn("b", F.explode(F.sequence(_bucket(F.greatest("valid_from", lo), bucket_seconds),
                                                _bucket(F.least(F.coalesce(F.col("valid_to") - 1, hi), hi), bucket_seconds)))))
    hits = asked.join(iv, ["pattern", "b"]).where((F.col("s") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("s") < F.col("valid_to"))))
    rank = F.struct(F.length("pattern").alias("len"), (F.col("list") == "allow").cast("int").alias("allow"), F.col("pattern"), F.col("list"), F.col("valid_from"))
    found = hits.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n_active"), F.max(rank).alias("best"))
    f = found.select(F.col("page_id").alias("k1"), F.col("url").alias("k2"), F.col("fetched_at").alias("k3"), "n_active", "best")
    out = caps.join(f, F.col("page_id").eqNullSafe(F.col("k1")) & (F.col("url") == F.col("k2")) & (F.col("fetched_at") == F.col("k3")), "left")
    return out.select("page_id", "url", "fetched_at", "n_rows", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
                      F.col("best.pattern").alias("rule"), F.col("best.list").alias("rule_list"), F.col("best.valid_from").alias("rule_since"),
                      (F.col("best").isNull() | (F.col("best.list") == "allow")).alias("kept"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The crawl: each page with a fetch time within January 2024, spread by its id."""
    s = F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(30 * DAY))
    return pages.select("page_id", "url", F.timestamp_seconds(s).alias("fetched_at"))


def dated_entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """A dated block and allow list over the crawl's hosts, from the ``events`` log.

    Every event of a kind below becomes an entry of one host: the hosts are
    numbered by the digest of their name, and the events of user u go to the host
    with number u modulo the hosts (no user: host 0). Errors put the host on the
    block list, purchases take it off, sign-ups and clicks do the same for the
    allow list and the host's section ``en``.
    """
    hosts = pages.select(host("url").alias("host")).where("host <> ''").distinct()
    n_hosts = hosts.agg(F.count("*").alias("n")).select("n").scalar()
    numbered = hashed_index(hosts.withColumn("digest", F.md5("host")), "digest", tiebreak=["host"], name="number")
    act = {"error": ("block", "add"), "purchase": ("block", "remove"), "signup": ("allow", "add"), "click": ("allow", "remove")}
    kind = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v[i])) for k, v in act.items()])
    number = F.pmod(F.coalesce("user_id", F.lit(0)), F.nullif(n_hosts, F.lit(0)))
    e = events.where(F.col("event_type").isin(list(act))).select(number.alias("number"), "ts", kind(0).alias("list"), kind(1).alias("action"))
    return e.join(numbered, "number").select(
        "list", "action", "ts", F.when(F.col("list") == "block", F.col("host")).otherwise(F.concat("host", F.lit("/en"))).alias("pattern"))


def op5_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    return verdicts(page_captures(pages), dated_entries(pages, events))


ORACLE = r"""
WITH caps AS (
  SELECT page_id, url, make_timestamp((1704067200 + (((page_id * 7919) % 2592000) + 2592000) % 2592000) * 1000000) AS fetched_at, count(*) AS n_rows
  FROM pages GROUP BY ALL),
parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS sec, CAST(epoch(fetched_at) AS BIGINT) AS s FROM caps),
hosts AS (SELECT host, row_number() OVER (ORDER BY md5(host), host) - 1 AS number, count(*) OVER () AS n
  FROM (SELECT DISTINCT host FROM parts WHERE host <> '')),
entries AS (
  SELECT CASE WHEN event_type IN ('error', 'purchase') THEN 'block' ELSE 'allow' END AS list,
    CASE WHEN event_type IN ('error', 'signup') THEN 'add' ELSE 'remove' END AS action, CAST(floor(epoch(ts)) AS BIGINT) AS s,
    CASE WHEN event_type IN ('error', 'purchase') THEN host ELSE host || '/en' END AS pattern
  FROM events JOIN hosts ON number = (coalesce(user_id, 0) % n + n) % n WHERE event_type IN ('error', 'purchase', 'signup', 'click')),
once AS (SELECT list, pattern, s, max(action) AS action FROM entries GROUP BY ALL),
iv AS (SELECT list, pattern, action, s AS valid_from, lead(s) OVER (PARTITION BY list, pattern ORDER BY s) AS valid_to FROM once),
asked AS (SELECT DISTINCT page_id, url, fetched_at, s, p AS pattern FROM (
  SELECT page_id, url, fetched_at, s, host, sec, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
    lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS h FROM parts WHERE host <> ''),
  LATERAL (SELECT unnest(CASE WHEN sec <> '' THEN [h, h || '/' || sec] ELSE [h] END) AS p)),
hits AS (SELECT a.*, list, valid_from, row_number() OVER (PARTITION BY page_id, url, fetched_at
    ORDER BY length(a.pattern) DESC, (list = 'allow') DESC, a.pattern DESC, list DESC, valid_from DESC) AS r,
    count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n_active
  FROM asked a JOIN iv ON a.pattern = iv.pattern AND action = 'add' AND a.s >= valid_from AND (valid_to IS NULL OR a.s < valid_to))
SELECT c.page_id, c.url, c.fetched_at, c.n_rows, coalesce(h.n_active, 0) AS n_active, h.pattern AS rule, h.list AS rule_list,
  h.valid_from AS rule_since, coalesce(h.list = 'allow', true) AS kept
FROM caps c LEFT JOIN hits h ON h.r = 1 AND c.page_id = h.page_id AND c.url = h.url AND c.fetched_at = h.fetched_at
"""
