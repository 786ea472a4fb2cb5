"""URL filters by dated lists: list entries become validity intervals, captures are matched with those valid at fetch time.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bucket: captures and intervals of a key meet only within one.
BUCKET_DAYS = 32
#: Entries that end a key's validity; all others begin it.
REMOVE = "remove"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)"
_ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host, lower case, without user, port and a dot at the end; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def url_keys(url: Column, most_labels: Column | None = None, most_segments: Column | None = None) -> Column:
    """What entries may name of a URL: its host, each suffix of the host of two labels or more, and the host with its first path segments.

    Suffixes and paths go as deep as told, two labels and one segment at least; else to the end. An IP address has no suffixes.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(_ADDRESS), F.lit(0)).otherwise(F.size(labels))
    deep = F.greatest(n if most_labels is None else F.least(n, most_labels), F.lit(2))
    domains = F.transform(F.sequence(F.lit(2), deep), lambda k: F.when(k <= n, F.array_join(F.slice(labels, n - k + 1, k), ".")))
    segments = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    m = F.size(segments)
    far = F.greatest(m if most_segments is None else F.least(m, most_segments), F.lit(1))
    paths = F.transform(F.sequence(F.lit(1), far), lambda k: F.when(k <= m, F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/"))))
    keys = F.array_distinct(F.filter(F.concat(F.array(host), domains, paths), lambda k: k.isNotNull() & (k != "")))
    return F.when(host != "", keys)


def _entry_key(key: Column) -> Column:
    """The key of an entry as url_keys writes it: the host in lower case, the path as it is."""
    host = F.substring_index(key, "/", 1)
    return F.concat(F.lower(host), F.substr(key, F.length(host) + 1))


def _deepest(intervals: DataFrame) -> DataFrame:
    """One row: labels and path segments of the deepest keys."""
    parts = F.split("key", "/")
    return intervals.agg(F.coalesce(F.max(F.size(F.split(parts[0], r"\."))), F.lit(2)).alias("most_labels"), F.coalesce(F.max(F.size(parts) - 1), F.lit(1)).alias("most_segments"))


def _bucket(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BUCKET_DAYS).cast("int")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, list, valid_from, valid_to): from an entry that adds the key to a list until the next that removes it, the end exclusive.

    entries: key, list, day, action. Of entries of a key and list on the same day, one that removes wins. Repeated adds
    change nothing. Entries without key, list or day are left out; a null action adds.
    """
    e = entries.select(_entry_key(F.col("key")).alias("key"), "list", F.col("day").cast("date").alias("day"), (F.coalesce("action", F.lit("add")) != REMOVE).alias("on")).filter("key is not null and list is not null and day is not null")
    e = e.groupBy("key", "list", "day").agg(F.bool_and("on").alias("on"))
    order = Window.partitionBy("key", "list").orderBy("day")
    e = e.withColumn("before", F.lag("on", 1, False).over(order)).filter("on <> before")
    e = e.withColumn("valid_to", F.lead("day").over(order))
    return e.filter("on").select("key", "list", F.col("day").alias("valid_from"), "valid_to")


def match_captures(captures: DataFrame, entries: DataFrame, id_col: str = "capture_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(id, list, key, valid_from): each entry of each list that is valid for a capture when it was fetched.

    A key's captures and intervals are joined on the key and a time bucket, so a host with most captures is met by a
    few intervals at a time, and Spark can split its captures; an interval is repeated once for each bucket it spans,
    an open one up to the last capture. Captures without id, URL with a host, or day match nothing.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day")).filter("id is not null and day is not null and url is not null")
    last = c.agg(F.max("day").alias("last"))
    valid = validity_intervals(entries)
    keys = url_keys(F.col("url"), F.col("most_labels"), F.col("most_segments"))
    keyed = c.crossJoin(F.broadcast(_deepest(valid))).select("id", "day", _bucket(F.col("day")).alias("bucket"), F.explode(keys).alias("key"))
    spans = valid.crossJoin(F.broadcast(last))  # one row
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last"))
    spans = spans.filter(F.col("valid_from") <= end).withColumn("bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(end))))
    found = keyed.join(spans, ["key", "bucket"]).filter((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    return found.select("id", "list", "key", "valid_from")


def filter_urls(captures: DataFrame, entries: DataFrame, allow_list: str = "allow", id_col: str = "capture_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(id, blocked, n_valid, list, key, valid_from): one row for each capture, repeated ones too.

    The decision is that of the longest key valid at fetch time, then the larger key, then the allow list, then the smaller list;
    a capture is blocked if that list isn't the allow list. Null if nothing is valid, and then it isn't blocked. Captures
    that share an id but not the URL or day are each decided by their own; without id, host or day nothing is valid.
    No captures give no rows; other columns don't matter.
    """
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day"))
    c = c.withColumn("one", F.xxhash64("id", "url", "day"))  # keeps what is joined and grouped small; id, url and day decide
    hits = match_captures(c.select(F.struct("id", "one").alias("capture"), "url", "day").filter("capture.id is not null").distinct(), entries, "capture", "url", "day").distinct()
    by_key = hits.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((F.col("list") != allow_list).alias("no"), "list", "valid_from")).alias("first"))
    chosen = by_key.groupBy("id").agg(F.sum("n").alias("n_valid"), F.max(F.struct(F.length("key").alias("long"), "key", "first")).alias("c"))
    chosen = chosen.select(F.col("id.id").alias("id"), F.col("id.one").alias("one"), "n_valid", F.struct("c.first.list", "c.key", "c.first.valid_from").alias("c"))
    out = c.select("id", "one").join(chosen, ["id", "one"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("c.list") != allow_list, F.lit(False)).alias("blocked"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.col("c.list").alias("list"), F.col("c.key").alias("key"), F.col("c.valid_from").alias("valid_from"))


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages as captures of 2024: the table has no fetch time, so the id's remainder by 366 is the day."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts and paths of any depth, as no list is given: days and lists follow from md5 of the key."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).distinct()
    h = F.md5(F.col("key").cast("binary"))
    digit = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    start = F.date_add(F.lit("2023-12-01").cast("date"), digit(1))
    name = F.element_at(F.array(F.lit("ads"), F.lit("adult"), F.lit("malware"), F.lit("allow")), digit(3) % 4 + 1)
    keys = keys.select("key", name.alias("list"), start.alias("start"), digit(5).alias("pick"), digit(7).alias("gap")).filter(F.col("pick") < 96)
    events = F.array(F.struct(F.col("start").alias("day"), F.lit("add").alias("action")), F.struct(F.expr("date_add(start, 20 + gap)").alias("day"), F.lit("remove").alias("action")), F.struct(F.expr("date_add(start, 60 + 2 * gap)").alias("day"), F.lit("add").alias("action")))
    return keys.select("key", "list", F.explode(F.slice(events, F.lit(1), F.col("pick") % 3 + 1)).alias("e")).select("key", "list", "e.day", "e.action")


def op6(spark, sf_dir: str) -> DataFrame:
    """filter_urls of pages as captures by lists made of their own URLs. Odd rows: see filter_urls."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(page_captures(pages), page_entries(pages)).withColumnRenamed("capture_id", "page_id")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[]+)', 1)), '\.$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages
), l AS (SELECT *, CASE WHEN regexp_matches(host, '^(\[.*|[0-9]+(\.[0-9]+){3})$') THEN [] ELSE string_split(host, '.') END AS lab FROM u WHERE host <> ''),
k AS (
  SELECT DISTINCT page_id, day, unnest(list_concat(list_concat([host],
    list_transform(generate_series(2, len(lab)), lambda i: array_to_string(lab[len(lab) - i + 1:], '.'))),
    list_transform(generate_series(1, len(seg)), lambda i: host || '/' || array_to_string(seg[1:i], '/')))) AS key
  FROM l
), h AS (
  SELECT key, ['ads', 'adult', 'malware', 'allow'][CAST(('0x' || substr(md5(key), 3, 2)) AS INTEGER) % 4 + 1] AS list,
         DATE '2023-12-01' + CAST(('0x' || substr(md5(key), 1, 2)) AS INTEGER) AS start,
         CAST(('0x' || substr(md5(key), 5, 2)) AS INTEGER) AS pick, CAST(('0x' || substr(md5(key), 7, 2)) AS INTEGER) AS gap
  FROM (SELECT DISTINCT key FROM k)
), s AS (
  SELECT key, list, start AS valid_from, CASE WHEN pick % 3 >= 1 THEN start + (20 + gap) END AS valid_to FROM h WHERE pick < 96
  UNION ALL SELECT key, list, start + (60 + 2 * gap), NULL FROM h WHERE pick < 96 AND pick % 3 = 2
), m AS (
  SELECT page_id, list, k.key, valid_from FROM k JOIN s ON k.key = s.key AND day >= valid_from AND (valid_to IS NULL OR day < valid_to)
), b AS (
  SELECT page_id, count(*) OVER (PARTITION BY page_id) AS n_valid, list, key, valid_from,
         row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, key DESC, list <> 'allow', list) AS rn FROM m
)
SELECT p.page_id, coalesce(b.list <> 'allow', false) AS blocked, coalesce(n_valid, 0) AS n_valid, b.list, b.key, CAST(b.valid_from AS DATE) AS valid_from
FROM pages p LEFT JOIN b ON p.page_id = b.page_id AND b.rn = 1
"""
