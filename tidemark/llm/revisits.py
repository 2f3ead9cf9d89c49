"""Web captures that say "not modified", resolved to the capture they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import table
from tidemark.llm.registry import query

# Headers that a 304 answer may renew; all others stay as first stored.
RENEWED = ["cache_control", "content_location", "date", "etag", "expires", "vary"]
STORED = ["content_type", "content_length", "last_modified"]
# Captures of one URL are ordered inside slices of so many seconds.
SLICE_SECONDS = 3600
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters, their order and a last slash make no difference."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(
        F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING)))
    query_ = F.array_join(F.array_sort(asked), "&")
    return F.when(url.isNotNull(), F.concat(F.lit("//"), host, path, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise("")))


def _strong(tag: Column) -> Column:
    """The entity tag for the weak comparison that a 304 needs."""
    return F.regexp_replace(tag, "^W/", "")


def resolve(captures: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL, checked and merged.

    ``captures``: record_id, kind ("response" or "revisit"), status, url, captured_at (long
    seconds), digest, the headers of RENEWED and STORED.  Only responses of status 200
    can be referred to, and only earlier ones; of several at one time the largest
    record_id counts.  The first validator the revisit has decides: entity tag (weak
    comparison), last modification, payload digest.  ``outcome`` is "resolved",
    "mismatch", "unchecked" (no validator) or "no_response" (also for a null URL or
    time); headers are merged only where it is resolved or unchecked.

    A URL's captures are cut into slices of time.  Inside a slice a window finds the
    latest response; the latest of earlier slices comes from one row per URL and
    slice.  So a URL with most of all captures is spread over its slices.
    """
    fields = ["captured_at", "record_id", "digest", *RENEWED, *STORED]
    rows = captures.select(
        "record_id", "kind", "status", "digest", F.col("captured_at").cast("long").alias("captured_at"), *RENEWED, *STORED,
        canonical_url(F.col("url")).alias("page")).withColumn("slice", F.floor(F.col("captured_at") / slice_seconds))
    known = rows.filter(F.col("page").isNotNull() & F.col("captured_at").isNotNull())
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct(*fields))
    inside = Window.partitionBy("page", "slice").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    found = known.withColumn("near", F.max(full).over(inside)).filter("kind = 'revisit'")
    before = Window.partitionBy("page").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    slices = known.groupBy("page", "slice").agg(F.max(full).alias("latest")).select(
        "page", "slice", F.max("latest").over(before).alias("far"))
    joined = found.join(slices, ["page", "slice"]).withColumn("was", F.coalesce("near", "far")).drop("near", "far")
    lost = rows.filter("kind = 'revisit'").filter(F.col("page").isNull() | F.col("captured_at").isNull()).withColumn(
        "was", F.lit(None).cast(joined.schema["was"].dataType))
    judged = joined.unionByName(lost).withColumn(
        "same",
        F.when(F.col("etag").isNotNull(), _strong(F.col("etag")).eqNullSafe(_strong(F.col("was.etag"))))
        .when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("was.last_modified")))
        .when(F.col("digest").isNotNull(), F.col("digest").eqNullSafe(F.col("was.digest"))))
    outcome = (F.when(F.col("was").isNull(), "no_response").when(F.col("same").isNull(), "unchecked")
               .when(F.col("same"), "resolved").otherwise("mismatch"))
    merged = outcome.isin("resolved", "unchecked")
    return judged.select(
        "record_id", "page", "captured_at", outcome.alias("outcome"), F.col("was.record_id").alias("refers_to"),
        F.col("was.captured_at").alias("refers_at"),
        *[F.when(merged, F.coalesce(F.col(h), F.col(f"was.{h}"))).alias(h) for h in RENEWED],
        *[F.when(merged, F.col(f"was.{h}")).alias(h) for h in STORED])


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl of the pages: each is captured in full, and asked for again later with "not modified" as the answer.

    Times, headers and validators follow from page_id and the html, so that all
    outcomes occur: some later answers carry the tag of other contents, some only a
    date or a digest, some nothing.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    none = F.lit(None).cast("string")
    case = F.col("page_id") % 8
    common = ["page_id", "url"]
    first = pages.select(
        *common, (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 16 == 9, 503).otherwise(200).alias("status"),
        (F.col("page_id") * 60).alias("captured_at"), F.md5("html").alias("digest"),
        F.lit("max-age=60").alias("cache_control"), none.alias("content_location"),
        F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("date"),
        F.when(case != 5, F.when(case == 2, F.concat(F.lit("W/"), tag)).otherwise(tag)).alias("etag"),
        F.lit("soon").alias("expires"), F.lit("accept-encoding").alias("vary"), F.lit("text/html").alias("content_type"),
        F.octet_length("html").cast("string").alias("content_length"), day.alias("last_modified"))
    again = pages.select(
        *common, (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        (F.col("page_id") * 60 + (F.col("page_id") * 7919) % 40000 - 600).alias("captured_at"),
        F.when(case == 6, F.md5("html")).alias("digest"),
        F.when(case != 1, F.lit("max-age=600")).alias("cache_control"), none.alias("content_location"),
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("date"),
        F.when(case < 3, tag).when(case == 3, F.lit('"other"')).alias("etag"), none.alias("expires"), none.alias("vary"),
        F.lit("text/plain").alias("content_type"), F.lit("0").alias("content_length"),
        F.when(case.isin(4, 5), day).alias("last_modified"))
    return first.unionByName(again).drop("page_id")


_CANONICAL = r"""
case when url is not null then '//' ||
  regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') ||
  regexp_replace(regexp_extract(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') ||
  case when asked <> '' then '?' || asked else '' end end
"""
SQL = rf"""
with shortened as (
  select *, regexp_replace(url, '#.*$', '') bare from pages
), pages2 as (
  select *, coalesce(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
    lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))), '&'), '') asked from shortened
), named as (
  select page_id, html, {_CANONICAL} page, '"' || substr(md5(html), 1, 16) || '"' tag,
    'day ' || cast(page_id % 97 as varchar) as day_, page_id % 8 as kase from pages2
), responses as (
  select page, page_id * 60 as captured_at, 2 * page_id as record_id, md5(html) digest, 't' || cast(page_id as varchar) as date,
    case when kase <> 5 then case when kase = 2 then 'W/' || tag else tag end end etag,
    cast(strlen(html) as varchar) content_length, day_ last_modified,
    row_number() over (partition by page, page_id * 60 order by page_id desc) as nth
  from named where page_id % 16 <> 9
), revisits as (
  select page, page_id * 60 + (page_id * 7919) % 40000 - 600 as captured_at, 2 * page_id + 1 as record_id,
    case when kase = 6 then md5(html) end digest, case when kase <> 1 then 'max-age=600' end cache_control,
    'r' || cast(page_id as varchar) as date, case when kase < 3 then tag when kase = 3 then '"other"' end etag,
    case when kase in (4, 5) then day_ end last_modified
  from named
), paired as (
  select v.*, r.record_id rid, r.captured_at rat, r.etag retag, r.last_modified rmod, r.digest rdig, r.content_length rlen
  from revisits v asof left join (select * from responses where nth = 1) r on v.page = r.page and v.captured_at > r.captured_at
), judged as (
  select *, case when etag is not null then coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(retag, '^W/', ''), false)
    when last_modified is not null then coalesce(last_modified = rmod, false)
    when digest is not null then coalesce(digest = rdig, false) end same
  from paired
), outcomes as (
  select *, case when rid is null then 'no_response' when same is null then 'unchecked' when same then 'resolved'
    else 'mismatch' end outcome from judged
)
select record_id, page, captured_at, outcome, rid refers_to, rat refers_at,
  case when outcome in ('resolved', 'unchecked') then coalesce(cache_control, 'max-age=60') end cache_control,
  case when outcome in ('resolved', 'unchecked') then date end date,
  case when outcome in ('resolved', 'unchecked') then coalesce(etag, retag) end etag,
  case when outcome in ('resolved', 'unchecked') then 'soon' end expires,
  case when outcome in ('resolved', 'unchecked') then 'accept-encoding' end vary,
  case when outcome in ('resolved', 'unchecked') then 'text/html' end content_type,
  case when outcome in ('resolved', 'unchecked') then rlen end content_length,
  case when outcome in ('resolved', 'unchecked') then rmod end last_modified
from outcomes
"""


@query("op2_revisit_resolution", SQL)
def revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every "not modified" answer of a crawl of all pages, resolved."""
    return resolve(crawl(table(spark, sf_dir, "pages"))).drop("content_location")
