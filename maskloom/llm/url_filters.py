"""URL filters as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: on a day, a list puts a scope on (``add``) or takes it off
(``remove``). A scope is a host, which holds for its subdomains too, or a host with the first segment of
a path. The entries of one list and scope become validity intervals: from an entry up to, not including,
the next of that list and scope (as-of semantics); intervals that a ``remove`` begins are dropped. Each
capture is then joined, on its few candidate scopes, to the intervals that hold its fetch day, and the
most specific active entry decides (longest scope, then the list's name).

Cases: a null or unreadable URL has no host and is kept with verdict ``keep``; a null fetch day matches
nothing; of entries of one list, scope and day the ``remove`` counts; a null scope, day or list is no
entry; captures that repeat have a row each; URL hosts are compared in lower case, without user, port or
final dot. Other columns are ignored. A host that a third of the captures share splits in the join,
whose other side has the entries of that host only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"
#: A fixed value: the part of an absolute URL that names the host, and the path's first segment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, scope, action, day. Returns list, scope, from_day, to_day (exclusive)."""
    known = entries.where("list is not null and scope is not null and day is not null")
    days = known.groupBy("list", "scope", "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    after = F.lead("day").over(Window.partitionBy("list", "scope").orderBy("day"))
    return days.withColumn("to_day", F.coalesce(after, F.lit(FOREVER).cast("date"))).where("gone = 0").select("list", "scope", F.col("day").alias("from_day"), "to_day")


def candidate_scopes(host: Column, segment: Column) -> Column:
    """The host, the domains above it with two labels or more, and the host with the path's first segment."""
    labels = F.split(host, r"\.")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(up, own)))


def temporal_list_join(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: capture_id, url, day. Returns capture_id, host, day, verdict, list, scope, from_day."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = captures.select("capture_id", "day", host_of(url).alias("host"), F.regexp_extract(url, SEGMENT, 1).alias("segment"))
    alike = rows.groupBy("capture_id", "day", "host", "segment").agg(F.count("*").alias("copies"))
    each = alike.select("*", F.explode_outer(candidate_scopes(F.col("host"), F.col("segment"))).alias("scope"))
    held = intervals(entries)
    active = each.join(held, (each["scope"] == held["scope"]) & (each["day"] >= held["from_day"]) & (each["day"] < held["to_day"]), "left").drop(each["scope"])
    entry = F.struct((-F.length("scope")).alias("rank"), "list", "scope", "from_day")
    decided = active.groupBy("capture_id", "day", "host", "segment").agg(F.max("copies").alias("copies"), F.min(F.when(F.col("list").isNotNull(), entry)).alias("best"))
    out = decided.select("capture_id", "host", "day", "best", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(
        "capture_id", "host", "day",
        F.when(F.col("best").isNull(), "keep").otherwise("drop").alias("verdict"),
        F.col("best.list").alias("list"), F.col("best.scope").alias("scope"), F.col("best.from_day").alias("from_day"),
    )


def dated_pages(pages: DataFrame) -> DataFrame:
    """The pages as captures; the table has no fetch time, so the day follows from page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(360)).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("day"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list log over the hosts of the pages; which scopes are listed, when and for how long follows from their MD5."""
    rows = pages.select(host_of(F.coalesce(F.col("url"), F.lit(""))).alias("host"), F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), SEGMENT, 1).alias("segment")).where("host <> ''").distinct()
    parent = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    scopes = rows.select(F.explode(F.array("host", parent, F.concat("host", F.lit("/"), "segment"))).alias("scope")).distinct()
    v = scopes.withColumn("v", F.conv(F.substring(F.md5("scope"), 1, 6), 16, 10).cast("int")).where("v % 3 = 0")
    name = F.when(F.col("scope").rlike("casino|bets|win"), "gambling").when(F.col("v") % 2 == 0, "ads").otherwise("malware")
    first = F.date_add(F.lit("2024-01-01").cast("date"), F.col("v") % 200)
    steps = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), F.when(F.col("v") % 5 < 3, F.date_add(first, 20 + F.col("v") % 70)).alias("day")),
        F.struct(F.lit("add").alias("action"), F.when(F.col("v") % 15 == 0, F.date_add(first, 120)).alias("day")),
    )
    return v.select(name.alias("list"), "scope", F.explode(steps).alias("s")).select("list", "scope", "s.action", "s.day")


ORACLE = r"""
with p as (select page_id as capture_id, date '2024-01-01' + (page_id % 360)::int as day, coalesce(url, '') as url from pages),
h as (select capture_id, day, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', '') as host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) as segment from p),
sc as (select distinct unnest([host, regexp_replace(host, '^(www|m|blog)\.', ''), host || '/' || segment]) as scope from h where host <> ''),
v as (select scope, ('0x' || substr(md5(scope), 1, 6))::int as v from sc),
w as (select scope, v, case when regexp_matches(scope, 'casino|bets|win') then 'gambling' when v % 2 = 0 then 'ads' else 'malware' end as list, date '2024-01-01' + v % 200 as first from v where v % 3 = 0),
e as (select list, scope, 'add' as action, first as day from w union all
  select list, scope, 'remove', first + (20 + v % 70) from w where v % 5 < 3 union all
  select list, scope, 'add', first + 120 from w where v % 15 = 0),
g as (select list, scope, day, max((action = 'remove')::int) as gone from e group by all),
i as (select list, scope, day as from_day, coalesce(lead(day) over (partition by list, scope order by day), date '9999-12-31') as to_day, gone from g),
n as (select *, string_split(host, '.') as labels from h),
k as (select distinct capture_id, day, host, segment, unnest(list_concat(list_transform(generate_series(1, greatest(len(labels) - 1, 1)), lambda x: array_to_string(labels[x:], '.')),
  case when segment <> '' then [host || '/' || segment] else [] end)) as scope from n where host <> ''),
b as (select k.capture_id, k.day, k.host, k.segment, i.list, i.scope, i.from_day,
  row_number() over (partition by k.capture_id, k.day, k.host, k.segment order by -length(i.scope), i.list, i.scope, i.from_day) as r
  from k join i on k.scope = i.scope and i.gone = 0 and k.day >= i.from_day and k.day < i.to_day)
select h.capture_id, h.host, h.day, case when b.list is null then 'keep' else 'drop' end as verdict, b.list, b.scope, b.from_day
from h left join b on b.r = 1 and h.capture_id = b.capture_id and h.day = b.day and h.host = b.host and h.segment = b.segment
"""
