"""Resolution of not-modified revisit records.

A revisit has no body; it stands for the latest earlier full response of its URL, if
that is the one its validators name.  The as-of join runs in two levels: time is cut
into slices of about equally many captures, and within (URL, slice) a window carries the last full response forward;
the last one of every slice is carried over the slices, a few rows for each URL.  So a
URL with a great share of all captures is spread over its slices.  All of it is
DataFrame expressions; bodies never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices at least; more, if the cluster has more shuffle partitions, up to MOST_SLICES.
SLICES, MOST_SLICES = 64, 1024
#: Headers that a not-modified answer may update in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only tell where a visitor came from.
TRACKING = "utm_[a-z]+|fbclid|gclid|ref"


def canonical_url(url: Column) -> Column:
    """One name for a page's addresses: no scheme, www. or m., fragment, tracking parameters, default file or final slash.

    All is put in lower case, so paths that differ by case alone are one page, and so are a host and its m. host."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"#.*$", "")
    u = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"^(www|m)\.", "")
    u = F.regexp_replace(u, rf"([?&])({TRACKING})=[^&]*", r"$1")
    u = F.regexp_replace(u, r"&+", "&")
    u = F.regexp_replace(u, r"\?&", "?")
    u = F.regexp_replace(u, r"[?&]$", "")
    u = F.regexp_replace(u, r"(/index)?\.html?(\?|$)", r"$2")
    return F.regexp_replace(u, r"/(\?|$)", r"$1")


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those permitted ones that the update has; names in lower case; of names that differ only by case the greatest counts, so small letters before capitals.

    Null headers are none; the result is null only if both are."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def low(headers: Column) -> Column:
        entries = F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lower(e["key"]).alias("name")))
        names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
        values = F.transform(names, lambda n: F.array_max(F.filter(entries, lambda e: e["name"] == n))["value"])
        return F.coalesce(F.map_from_arrays(names, values), none)

    new = F.map_filter(low(update), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(low(stored), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    return F.when(stored.isNotNull() | update.isNotNull(), merged)


def slice_of(time: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are under time: by stretches of them first, then within one."""
    k = max(1, int(len(cuts) ** 0.5))
    under = lambda values: F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda c: c < time))
    out = None
    for i in range(((len(cuts) - 1) // k) * k, -1, -k):
        here = F.lit(i) + under(cuts[i : i + k])
        out = here if out is None else F.when(time > cuts[i + k], out).otherwise(here)
    return out if out is not None else F.lit(0)


def resolve(captures: DataFrame, slices: int | None = None) -> DataFrame:
    """Every revisit with the response that it stands for.

    captures: record_id, url, time (long), kind ("response" or "revisit"), etag,
    last_modified, headers (map).  Returns record_id, canonical, time, ``refers_to``,
    ``verdict`` and ``headers``.  The verdict is ``resolved`` if the entity tags agree (weak
    or strong), or without a tag on both sides the dates of change; ``unchecked`` if
    there is nothing to compare; ``changed`` if they differ; ``orphan`` if no full
    response is earlier.  Headers are merged for the first two, else the revisit's own.
    A response at a revisit's own time isn't earlier; of several at one time the
    greatest record_id counts.  Captures with a null url or time, or of another kind, take no
    part; repeated revisits each give a row; of headers whose names differ only by case the
    greatest name counts; texts are carried however long; an empty table gives an empty one, and
    other columns are not carried.

    No slice has many more captures than its share, so neither has a URL's part of one,
    unless that many are of one time.
    """
    c = captures.select("record_id", canonical_url(F.col("url")).alias("canonical"), F.col("time").cast("long").alias("time"), "kind", "etag", "last_modified", "headers")
    c = c.filter(F.col("canonical").isNotNull() & F.col("time").isNotNull() & F.col("kind").isin("response", "revisit"))
    n = slices or min(MOST_SLICES, max(SLICES, int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = c.agg(F.percentile_approx("time", [i / n for i in range(1, n)], 10 * MOST_SLICES)).first()[0] if n > 1 else []
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    c = c.withColumn("slice", slice_of(F.col("time"), sorted(set(cuts or [])))).withColumn("full", full)
    # at one time revisits come first, so that they never see a response of their own time
    order = [F.col("time"), (F.col("kind") == "response").cast("int"), F.col("record_id")]
    inside = Window.partitionBy("canonical", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = c.withColumn("here", F.last("full", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    ends = c.filter("full is not null").groupBy("canonical", "slice").agg(F.max_by("full", F.struct("time", "record_id")).alias("full"))
    need = seen.filter("here is null").select("canonical", "slice").distinct()
    steps = ends.unionByName(need.join(ends, ["canonical", "slice"], "left_anti").withColumn("full", F.lit(None).cast(ends.schema["full"].dataType)))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("full", ignorenulls=True).over(before)).select("canonical", "slice", "carried")
    r = seen.join(carried, ["canonical", "slice"], "left").withColumn("found", F.coalesce("here", "carried"))
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    verdict = (
        F.when(F.col("found").isNull(), "orphan")
        .when(tags, F.when(_strong(F.col("etag")) == _strong(F.col("found.etag")), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("found.last_modified"), "resolved").otherwise("changed"))
        .otherwise("unchecked")
    )
    r = r.withColumn("verdict", verdict)
    headers = F.when(F.col("verdict").isin("resolved", "unchecked"), merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return r.select("record_id", "canonical", "time", F.col("found.record_id").alias("refers_to"), "verdict", headers.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures made from pages: each page's full response, and a later revisit of its address.

    Page p is captured at time 4p; its revisit follows after 1 to 4,000, names the
    page's tag (every fifth: another tag; every seventh: no tag but a date)."""
    p = pages.select("page_id", "url", F.md5("html").alias("tag"))
    stored = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("content-type", F.lit("text/html"), "etag", F.col("tag"), "server", F.lit("full"), "cache-control", F.lit("max-age=60"))])
    update = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in ("content-type", F.lit("text/plain"), "server", F.lit("revisit"), "Cache-Control", F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string")))])
    day = F.concat(F.lit("day "), (F.col("page_id") % 3).cast("string"))
    responses = p.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 4).alias("time"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), day.alias("last_modified"), stored.alias("headers"))
    tag = F.when(F.col("page_id") % 7 == 0, F.lit(None).cast("string")).when(F.col("page_id") % 5 == 0, F.lit("another")).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    revisits = p.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 4 + 1 + F.col("page_id") * 37 % 4000).alias("time"), F.lit("revisit").alias("kind"), tag.alias("etag"), day.alias("last_modified"), update.alias("headers"))
    return responses.unionByName(revisits)


def op3_warc_revisit(spark, sf_dir: str) -> DataFrame:
    r = resolve(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    h = F.col("headers")
    return r.select("record_id", "canonical", "time", "refers_to", "verdict", F.try_element_at(h, F.lit("content-type")).alias("content_type"), F.try_element_at(h, F.lit("server")).alias("server"), F.try_element_at(h, F.lit("etag")).alias("etag"), F.coalesce(F.try_element_at(h, F.lit("cache-control")), F.try_element_at(h, F.lit("Cache-Control"))).alias("cache_control"))


OP3_SQL = rf"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, url,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''),
      '^[a-z][a-z0-9+.-]*://', ''), '^(www|m)\.', ''), '([?&])({TRACKING})=[^&]*', '\1', 'g'), '&+', '&', 'g'),
      '\?&', '?', 'g'), '[?&]$', ''), '(/index)?\.html?(\?|$)', '\2'), '/(\?|$)', '\1') AS canonical
  FROM pages WHERE url IS NOT NULL
), full_r AS (
  SELECT page_id * 2 AS record_id, canonical, page_id * 4 AS time, tag, 'day ' || (page_id % 3) AS day FROM p
), revisit AS (
  SELECT page_id * 2 + 1 AS record_id, page_id, canonical, page_id * 4 + 1 + page_id * 37 % 4000 AS time, 'day ' || (page_id % 3) AS day,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN 'another' ELSE tag END AS tag FROM p
), best AS (
  SELECT r.record_id, arg_max(f, f.time * 1000000000 + f.record_id) AS f
  FROM revisit r JOIN full_r f ON r.canonical = f.canonical AND f.time < r.time GROUP BY r.record_id
), judged AS (
  SELECT r.*, b.f, CASE WHEN b.f IS NULL THEN 'orphan'
    WHEN r.tag IS NOT NULL AND b.f.tag IS NOT NULL THEN CASE WHEN r.tag = b.f.tag THEN 'resolved' ELSE 'changed' END
    WHEN r.day = b.f.day THEN 'resolved' ELSE 'changed' END AS verdict
  FROM revisit r LEFT JOIN best b USING (record_id)
)
SELECT record_id, canonical, time, f.record_id AS refers_to, verdict,
  CASE WHEN verdict = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE WHEN verdict = 'resolved' THEN 'full' ELSE 'revisit' END AS server,
  CASE WHEN verdict = 'resolved' THEN f.tag END AS etag,
  'max-age=' || (page_id % 100) AS cache_control
FROM judged
"""
