"""Not-modified revisits in a web archive: as-of join to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096                                   # time units of one capture-time bucket

# Header fields that describe the body sent along, so a 304 must not change them.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")

# Header fields that only concern one connection; so do those that "connection" lists.
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")

TRACKING = r"(?i)(^|&)(?:(?:utm_[a-z]+|ref|sessionid)=[^&]*(?:&|$))+"   # whole parameters of a query


def canonical_url(url: Column) -> Column:
    """Without scheme, its default port, ``www.``, fragment, tracking parameters and a path's trailing slashes, the
    host in lower case. Paths and parameters keep their case: servers tell them apart."""
    bare = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), r"(?i)^https?://(www\.)?", "")
    path = F.regexp_extract(bare, r"(?s)^[^?]*", 0)
    host = F.regexp_extract(path, r"(?s)^[^/]*", 0)
    port = F.when(url.rlike("(?i)^https:"), ":443$").when(url.rlike("(?i)^http:"), ":80$").otherwise(":(80|443)$")
    query = F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, "$1"), r"[?&]+$", "")
    page = F.concat(F.regexp_replace(F.lower(host), port, F.lit("")), path.substr(F.char_length(host) + 1, F.char_length(path)))
    return F.when(query == "", F.regexp_replace(page, r"/+$", "")).otherwise(F.concat(page, F.lit("?"), query))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """What each revisit stands for.

    ``records``: record_id, url, ts (a long), kind ('response' or 'revisit'), etag, last_modified
    (long), headers (map of lower-case names). Returns for each revisit: record_id, url_key, ts,
    status, response_id, response_ts, headers. The response is the latest of the same canonical
    URL before the revisit in the order of (ts, record_id). Status: ``resolved``;
    ``validator_mismatch`` (both have an etag and they differ, or, where one has none, both
    have a last_modified and they differ, or no validator is common to both);
    ``no_earlier_response``, also for a null URL or null ts. Resolved headers are the
    response's, with the revisit's in place of or beside them, but for BODY_HEADERS, HOP_HEADERS and what its
    ``connection`` lists; others have the revisit's own (null headers: an empty map). Entity tags
    are compared as a 304 is: weakly, without ``W/``. Repeated records resolve alike; further columns
    are not read.

    Records of one URL are searched in buckets of ``span`` time units, so that a URL with a third
    of all captures is spread over many tasks; the last response of each bucket, one small row,
    is carried to the later ones. Bodies take no part: join them by response_id.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "etag", "last_modified",
                          F.coalesce("headers", empty).alias("headers"), F.floor(F.col("ts") / span).alias("bucket"))
    own = F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("id"), "etag", "last_modified",
                   F.map_entries("headers").alias("headers"))
    response = F.when((F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("url_key").isNotNull(), own)
    # what can't be searched for is no key of a window or a join
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(~placed & (F.col("kind") == "revisit"))
    rows = rows.where(placed)
    before = Window.partitionBy("url_key", "bucket").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.last(response, ignorenulls=True).over(before)).where("kind = 'revisit'")
    last = rows.where("kind = 'response' and ts is not null and url_key is not null").groupBy("url_key", "bucket").agg(F.max(own).alias("r"))
    # the buckets that need a response from before, and those that have one, in one order
    need = inside.where("near is null and bucket is not null and url_key is not null").select("url_key", "bucket", F.lit(None).cast(last.schema["r"].dataType).alias("r")).distinct()
    both = last.unionByName(need).groupBy("url_key", "bucket").agg(F.max("r").alias("r"), F.max(F.col("r").isNull().cast("int")).alias("asked"))
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("far", F.last("r", ignorenulls=True).over(earlier)).where("asked = 1 and far is not null").select(
        F.col("url_key").alias("k"), F.col("bucket").alias("b"), "far")
    found = inside.join(carried, (F.col("url_key") == F.col("k")) & (F.col("bucket") == F.col("b")), "left").withColumn("r", F.coalesce("near", "far"))
    found = found.select(*rows.columns, "r").union(lost.select(*rows.columns, F.lit(None).cast(found.schema["r"].dataType)))
    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")
    etags, dates = tag("etag") == tag("r.etag"), F.col("last_modified") == F.col("r.last_modified")
    same = F.coalesce(etags, dates, F.lit(False))
    status = (F.when(F.col("r").isNull() | F.col("url_key").isNull(), "no_earlier_response")
              .when(same, "resolved").otherwise("validator_mismatch"))
    listed = F.split(F.lower(F.regexp_replace(F.coalesce(F.get(F.map_values(F.map_filter("headers", lambda k, _: k == "connection")), F.lit(0)), F.lit("")), r"\s", "")), ",")
    permitted = F.map_filter("headers", lambda k, _: ~(k.isin(*BODY_HEADERS, *HOP_HEADERS) | F.array_contains(listed, k)))
    kept = F.map_filter(F.map_from_entries("r.headers"), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(permitted), k), F.lit(False)))
    return found.withColumn("status", status).select(
        "record_id", "url_key", "ts", "status", F.when(F.col("status") != "no_earlier_response", F.col("r.id")).alias("response_id"),
        F.when(F.col("status") != "no_earlier_response", F.col("r.ts")).alias("response_ts"),
        F.when(F.col("status") == "resolved", F.map_concat(kept, permitted)).otherwise(F.col("headers")).alias("headers"))
