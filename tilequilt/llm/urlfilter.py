"""URL filtering against dated lists: entries become validity intervals, and each capture is held against those that
were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action, day) list changes -> (rule, since, until) spans of days in which a rule is active.

    rule is a host or domain (which covers its subdomains), or a host and a first path segment ('host/segment'). An
    add opens an interval, the next change of any kind closes it; of changes on one day a removal counts last.
    Until is exclusive, null while open. Null rules or days are ignored; repeated changes count once.
    """
    rows = columns(entries, "rule", "action", "day").where("rule IS NOT NULL AND day IS NOT NULL").distinct()
    order = Window.partitionBy("rule").orderBy("day", F.when(F.col("action") == "add", 0).otherwise(1))
    spans = rows.withColumn("until", F.lead("day").over(order))
    return spans.where((F.col("action") == "add") & (F.col("until").isNull() | (F.col("until") > F.col("day")))).select("rule", F.col("day").alias("since"), "until")


def _rules(host: Column, segment: Column) -> Column:
    """All rules that could cover a URL, most specific first: host/segment, host, parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parents = F.filter(parents, lambda p: p.contains(".") | (p == host))
    prefix = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(prefix, parents)).otherwise(F.array().cast("array<string>"))


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, day, blocked, rule, since) of every row of captures (key, url, day).

    blocked: a rule of entries (see intervals) that covers the URL was active on its day; rule is the most specific
    such one, since the day that it became active. URLs are first brought down to distinct (host, first segment, day),
    which is what a decision depends on, so a host with a third of all captures is joined with the lists once a
    segment and day. A null or unparsable URL, or a null day, is covered by nothing. Repeated rows each come back; an
    empty table gives an empty one; extra columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    segment = F.coalesce(F.regexp_extract("url", SEGMENT, 1), F.lit(""))
    rows = columns(captures, key, "url", "day").select(F.col(key), "day", host.alias("host"), segment.alias("segment"))
    asked = rows.where("host <> '' AND day IS NOT NULL").groupBy("host", "segment", "day").agg(F.lit(1).alias("one")).drop("one")
    keyed = asked.select("*", F.posexplode(_rules(F.col("host"), F.col("segment"))).alias("at", "rule"))
    spans = intervals(entries)
    active = keyed.join(spans, "rule").where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    best = active.groupBy("host", "segment", "day").agg(F.min(F.struct("at", "rule", "since")).alias("hit"))
    out = rows.join(best, ["host", "segment", "day"], "left")
    return out.select(key, "day", F.col("hit").isNotNull().alias("blocked"), F.col("hit.rule").alias("rule"), F.col("hit.since").alias("since"))


#: The lists of the query: a rule for every host, its registered domain and its first path segments, dated by a hash.
_DIGIT = "0123456789abcdef"


def page_captures(pages: DataFrame) -> DataFrame:
    """pages as captures: the day of fetching (0 to 365) follows from page_id, as the table has none."""
    return columns(pages, "page_id", "url").withColumn("day", F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and host/segment prefixes of pages: up to three changes a rule, by md5."""
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    segment = F.coalesce(F.regexp_extract("url", SEGMENT, 1), F.lit(""))
    rows = columns(pages, "url").select(host.alias("host"), segment.alias("segment")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    rules = rows.select(F.explode(F.array("host", domain, F.concat("host", F.lit("/"), "segment"))).alias("rule")).distinct().withColumn("h", F.md5("rule"))

    def digit(i: int) -> Column:
        return F.instr(F.lit(_DIGIT), F.substring("h", i, 1)) - 1

    first = digit(1) * 16 + digit(2)
    second = first + 1 + digit(3) * 8
    third = second + 1 + digit(4) * 16
    changes = F.array(*(F.struct(F.lit(a).alias("action"), d.cast("int").alias("day")) for a, d in (("add", first), ("remove", second), ("add", third))))
    return rules.where(digit(5) < 6).select("rule", F.explode(changes).alias("c")).select("rule", "c.action", "c.day")


ORACLE = rf"""
WITH c AS (SELECT page_id, CAST((page_id * 7919) % 366 AS INTEGER) AS day,
    lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host, coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS segment FROM pages),
h AS (SELECT DISTINCT host, segment, string_split(host, '.') AS labels FROM c WHERE host <> ''),
r AS (SELECT DISTINCT rule, md5(rule) AS m FROM (SELECT host AS rule FROM h UNION ALL SELECT array_to_string(labels[-3:], '.') FROM h UNION ALL SELECT host || '/' || segment FROM h)),
d AS (SELECT rule, strpos('{_DIGIT}', m[1]) - 1 AS a, strpos('{_DIGIT}', m[2]) - 1 AS b, strpos('{_DIGIT}', m[3]) - 1 AS e, strpos('{_DIGIT}', m[4]) - 1 AS f
    FROM r WHERE strpos('{_DIGIT}', m[5]) - 1 < 6),
v AS (SELECT rule, a * 16 + b AS since, a * 16 + b + 1 + e * 8 AS until FROM d
    UNION ALL SELECT rule, a * 16 + b + 1 + e * 8 + 1 + f * 16, NULL FROM d),
k AS (SELECT page_id, day, 0 AS lvl, host || '/' || segment AS rule FROM c WHERE host <> '' AND segment <> ''
    UNION ALL SELECT page_id, day, i, array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '')
    WHERE i = 1 OR i < len(string_split(host, '.'))),
b AS (SELECT page_id, arg_min(k.rule, lvl) AS rule, arg_min(since, lvl) AS since FROM k JOIN v ON k.rule = v.rule AND since <= day AND (until IS NULL OR day < until) GROUP BY page_id)
SELECT c.page_id, c.day, b.rule IS NOT NULL AS blocked, b.rule, CAST(b.since AS INTEGER) AS since FROM c LEFT JOIN b ON c.page_id = b.page_id
"""
