"""WARC: resolution of not-modified revisits by an as-of join on canonical URLs, with DataFrame functions only.

A revisit (a 304 answer) refers to the latest earlier full response for its canonical URL. The as-of join has two
levels, so captures of one URL that hold a third of all rows spread over tasks: captures are cut into chunks of time,
the last response of every chunk is an aggregate, a short window over chunks carries it on, and a window inside each
chunk finishes. A chunk is a day, or as much less as the busiest URL's captures ask for (one count by URL first), down to
a second. Bodies stay out of the join; they can be fetched by `refers_to` afterwards.

Validators: an ETag of the revisit must equal the response's weakly (RFC 9110), else its Last-Modified must be equal,
else its payload digest; with none of the three the revisit is `unverified`. If they hold, headers that a 304 may
update replace those of the response (RFC 9111).

Defined results: `state` is resolved, unverified, mismatch or missing (no earlier response, or a null URL or time);
responses at the same time count as earlier if their record id is lower, null ids first; repeated rows give repeated
results; header names are compared in lower case, the greatest value wins where two differ in case alone; null headers
are no headers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Seconds of a chunk of captures at most, and captures of one URL that a chunk should hold at most.
CHUNK, CAPTURES = 86_400, 20_000
#: Query parameters that do not name a resource (fixed values), as a pattern.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Headers of a 304 that do not replace the stored ones: of one connection, or about the missing body (fixed values).
KEPT_OUT = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, `www.` and default port; path without a closing slash; sorted parameters
    without those of trackers; no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """A map with lower-case names."""
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value"))))
    last = F.filter(entries, lambda e, i: (i + 1 >= F.size(entries)) | (F.get(entries, i + 1).key != e.key))
    return F.map_from_entries(last)


def strong(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def chunk_seconds(records: DataFrame, captures: int = CAPTURES) -> int:
    """Seconds in which no URL has more than `captures` captures, if they come evenly over the time that it was met."""
    busy = records.where("at is not null").groupBy(canonical_url(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), (F.max("at") - F.min("at") + 1).alias("span")).where(F.col("n") > captures)
    least = busy.agg(F.min(F.floor(F.col("span") * captures / F.col("n")))).first()[0]
    return CHUNK if least is None else max(1, min(CHUNK, int(least)))


def resolve_revisits(records: DataFrame, chunk: int | None = None) -> DataFrame:
    """From (record_id, url, at seconds, kind response or revisit, status, headers, digest, length), for each revisit:
    record_id, canonical, at, state, refers_to, headers (merged), digest and length of the payload."""
    chunk = chunk or chunk_seconds(records)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "at", "kind", lower_names(F.col("headers")).alias("headers"), "digest", "length", ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full")).where("full or kind = 'revisit'")
    rows = rows.withColumns({"chunk": F.floor(F.col("at") / chunk), "hit": F.when(F.col("full") & F.col("at").isNotNull(), F.struct("at", F.col("record_id").isNotNull().alias("known"), "record_id", F.map_entries("headers").alias("h"), "digest", "length"))})
    lost = rows.where("not full and (canonical is null or at is null)").withColumn("found", F.col("hit"))
    rows = rows.where("canonical is not null and at is not null")
    last = rows.where("full").groupBy("canonical", "chunk").agg(F.max("hit").alias("last"))
    keys = rows.groupBy("canonical", "chunk").agg(F.count("*").alias("n")).drop("n")
    above = Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = keys.join(last, ["canonical", "chunk"], "left").select("canonical", "chunk", F.last("last", ignorenulls=True).over(above).alias("carried"))
    inside = Window.partitionBy("canonical", "chunk").orderBy("at", F.asc_nulls_first("record_id"), F.desc("full")).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("inner", F.last("hit", ignorenulls=True).over(inside)).where("not full")
    found = here.join(carried, ["canonical", "chunk"], "left").withColumn("found", F.coalesce("inner", "carried"))
    return verdict(found.drop("inner", "carried").unionByName(lost))


def verdict(df: DataFrame) -> DataFrame:
    """Checks validators of each revisit against `found` and merges the headers."""
    own, theirs = F.col("headers"), F.map_from_entries(F.coalesce("found.h", F.expr("cast(array() as array<struct<key:string,value:string>>)")))
    df = df.withColumns({"theirs": theirs, "etag": own["etag"], "modified": own["last-modified"]})
    equal = F.when(F.col("etag").isNotNull(), strong(F.col("etag")) == strong(F.col("theirs")["etag"])).when(F.col("modified").isNotNull(), F.col("modified") == F.col("theirs")["last-modified"]).when(F.col("digest").isNotNull(), F.col("digest") == F.col("found.digest"))
    none = F.col("etag").isNull() & F.col("modified").isNull() & F.col("digest").isNull()
    state = F.when(F.col("found").isNull(), "missing").when(none, "unverified").when(F.coalesce(equal, F.lit(False)), "resolved").otherwise("mismatch")
    allowed = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_OUT))
    stays = F.map_filter("theirs", lambda k, v: ~F.map_contains_key(allowed, k))
    df = df.withColumn("state", state)
    ok = F.col("state").isin("resolved", "unverified")
    return df.select("record_id", "canonical", "at", "state", F.when(ok, F.col("found.record_id")).alias("refers_to"), F.when(ok, F.map_concat(stays, allowed)).alias("headers"), F.when(ok, F.col("found.digest")).alias("digest"), F.when(ok, F.col("found.length")).alias("length"))


def with_payload(resolved: DataFrame, records: DataFrame, body_col: str = "body") -> DataFrame:
    """Adds the body of the response that each resolved revisit refers to."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), body_col)
    return resolved.join(bodies, "refers_to", "left")


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Every page captured in full, minute by minute in the order of page_id, and again a week later as not modified:
    one in seven without validators, one in five of the rest with Last-Modified alone, else with a weak ETag."""
    digest = F.md5("html")
    at = (F.col("page_id") * 60).alias("at")
    tag, day = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')), F.concat(F.lit("day "), F.expr("page_id div 100").cast("string"))
    kept = pages.select("page_id", "url", "html")
    full = kept.select((F.col("page_id") * 2).alias("record_id"), "url", at, F.lit("response").alias("kind"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), digest.alias("digest"), F.octet_length("html").cast("long").alias("length"))
    bare = F.create_map(F.lit("Date"), F.concat(F.lit("visit "), F.col("page_id").cast("string")), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=600"))
    validators = F.when(F.col("page_id") % 7 == 0, bare).when(F.col("page_id") % 5 == 0, F.map_concat(bare, F.create_map(F.lit("Last-Modified"), day))).otherwise(F.map_concat(bare, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag))))
    again = kept.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 60 + 7 * 86_400).alias("at"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), validators.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length"))
    return full.unionByName(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, and each again as a revisit to resolve."""
    out = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    return out.withColumns({"headers": header_text(F.col("headers")), "refers_to": F.coalesce("refers_to", F.lit(-1)), "length": F.coalesce("length", F.lit(-1))})


OP9_SQL = r"""
WITH u AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
x AS (SELECT page_id, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS length, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM u),
c AS (SELECT page_id, digest, length, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || CAST(page_id // 100 AS VARCHAR) AS day FROM x),
r AS (SELECT a.page_id, a.canonical, a.page_id * 60 + 604800 AS "at", a.tag, a.day, b.page_id AS other, b.tag AS otag, b.day AS oday, b.digest AS odigest, b.length AS olength
  FROM c a LEFT JOIN c b ON a.canonical = b.canonical AND (b.page_id * 60 < a.page_id * 60 + 604800 OR b.page_id * 60 = a.page_id * 60 + 604800 AND b.page_id * 2 < a.page_id * 2 + 1)
  QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC) = 1),
s AS (SELECT *, CASE WHEN other IS NULL THEN 'missing' WHEN page_id % 7 = 0 THEN 'unverified' WHEN page_id % 5 = 0 THEN CASE WHEN day = oday THEN 'resolved' ELSE 'mismatch' END WHEN tag = otag THEN 'resolved' ELSE 'mismatch' END AS state FROM r),
k AS (SELECT *, state IN ('resolved', 'unverified') AS ok FROM s)
SELECT page_id * 2 + 1 AS record_id, canonical, "at", state, CASE WHEN ok THEN other * 2 ELSE -1 END AS refers_to,
  CASE WHEN ok THEN 'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: visit ' || page_id || chr(10) || 'etag: ' || CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN 'W/' || tag ELSE otag END || chr(10) || 'last-modified: ' || CASE WHEN page_id % 7 <> 0 AND page_id % 5 = 0 THEN day ELSE oday END END AS headers,
  CASE WHEN ok THEN odigest END AS digest, CASE WHEN ok THEN olength ELSE -1 END AS length FROM k
"""
