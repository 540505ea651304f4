"""WARC: resolution of not-modified revisits.

A revisit with status 304 has no body: it says that what was captured earlier
is still current.  It is resolved by an as-of join: the latest earlier full
response (status 200) with the same canonical URL.  The validators must agree:
the entity tag if the revisit has one, compared weakly, else the
last-modified date.  A resolved revisit gets the body of that response and its
headers, updated by those headers of the revisit that a 304 may change.

Any share of captures may have one URL: rows are dealt out by ranges of (URL,
time) and the last response of a range is handed to the ranges after it, so no
task needs a whole URL.  Only row numbers and validators take part in
the join; headers and bodies are fetched afterwards, by a key of the row's
record_id, URL, time and validators, since record_id may be null or repeated.
The revisits of one response are dealt out in parts when they are many.

Defined cases: a null URL or time resolves nothing (``no_response``); responses at the
revisit's own time are not earlier, and of responses at one time that with the largest
record_id counts; a revisit without any validator is ``no_validator``; null headers are
an empty map; rows that repeat a record_id are separate captures; of
responses with one URL, time and record_id that with the largest validators counts, of those
with equal ones the smallest body; empty input gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.llm.common import cut, hot_keys, spread_join, table

#: Headers that describe the stored body or one connection; a 304 does not change them.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Scheme, default port, ``www.``/``m.``, fragment, tracking parameters and a last slash dropped; host lower-cased."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^(www|m)\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+(\?|$)", "$1"))


def _lower_keys(headers: Column) -> Column:
    """Names in lower case; of names that then are equal the last stays."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda got, e: F.map_concat(F.map_filter(got, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merged_headers(stored: Column, update: Column) -> Column:
    changed = F.map_filter(update, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(changed, k)), changed)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^W/", "")


def _row_key(headers: Column) -> list[Column]:
    """128 bits of all that decides how a capture is matched; captures with one key have one outcome."""
    parts = [F.col("record_id"), F.col("url"), F.col("captured"), _tag(headers), headers["last-modified"]]
    parts += [x.isNull() for x in parts]  # hashes pass over nulls
    return [F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts)]


def resolve(captures: DataFrame) -> DataFrame:
    """record_id, url, captured, outcome, response_id, headers, body: one row a revisit.

    ``captures`` has record_id, url, captured, status, headers (map) and body.
    outcome is resolved, changed (validators differ), no_validator or
    no_response; only resolved revisits have a body, others keep their own
    headers.
    """
    known = F.col("url").isNotNull() & F.col("captured").isNotNull()
    rows = captures.filter(known).select(
        F.col("record_id"), F.col("url"), F.col("captured"), canonical_url(F.col("url")).alias("site"), (F.col("status") == 200).alias("full"), (F.col("status") == 304).alias("revisit"),
        _lower_keys(F.col("headers")).alias("h"),
    ).filter("full or revisit").select("record_id", "captured", "site", "full", _tag(F.col("h")).alias("etag"), F.col("h")["last-modified"].alias("modified"), *[k.alias(n) for k, n in zip(_row_key(F.col("h")), ("k1", "k2"))])
    # at one time revisits come before responses, so that these are not earlier
    order = ["captured", "full", "record_id", "etag", "modified", "k1", "k2"]
    ranged = cut(rows.repartitionByRange("site", *order).withColumn("_range", F.spark_partition_id()))
    response = F.when(F.col("full"), F.struct("captured", "record_id", "etag", "modified", "k1", "k2"))
    last = ranged.groupBy("site", "_range").agg(F.max(response).alias("last"))
    before = Window.partitionBy("site").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("site").alias("_site"), F.col("_range").alias("_r"), F.max("last").over(before).alias("carried"))
    within = Window.partitionBy("_range", "site").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (
        ranged.join(carried, (F.col("_range") == F.col("_r")) & (F.col("site") == F.col("_site")))
        .withColumn("stored", F.coalesce(F.last(response, ignorenulls=True).over(within), F.col("carried")))
        .filter("not full")
    )
    found = joined.withColumn(
        "outcome",
        F.when(F.col("stored").isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(F.col("etag") == F.col("stored.etag"), "resolved").otherwise("changed"))
        .when(F.col("modified").isNotNull(), F.when(F.col("modified") == F.col("stored.modified"), "resolved").otherwise("changed"))
        .otherwise("no_validator"),
    )
    found = cut(found.select("k1", "k2", "outcome", *[F.when(F.col("outcome") == "resolved", F.col(f"stored.{c}")).alias(n) for c, n in (("record_id", "response_id"), ("k1", "r1"), ("k2", "r2"))]).distinct())
    headers = _lower_keys(F.col("headers"))
    b1, b2 = _row_key(headers)
    bodies = captures.filter("status = 200").filter(known).select(b1.alias("r1"), b2.alias("r2"), F.struct("body", F.to_json(headers).alias("h")).alias("stored"))
    revisits = found.filter("r1 is not null").groupBy("r1", "r2").agg(F.count("*").alias("n"))
    bodies = bodies.join(revisits, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.min("stored").alias("stored"))
    own = captures.filter("status = 304").select("record_id", "url", "captured", headers.alias("own"))
    o1, o2 = _row_key(F.col("own"))
    told = own.filter(known).withColumn("_o1", o1).withColumn("_o2", o2).join(found, (F.col("_o1") == F.col("k1")) & (F.col("_o2") == F.col("k2")))
    columns = ["record_id", "url", "captured", "outcome", "response_id"]
    # a popular response's revisits are dealt out in parts, each of which gets a copy of the body
    with_body = spread_join(told.filter("outcome = 'resolved'"), bodies, ["r1", "r2"], ["k1", "k2"], hot_keys(revisits, ["r1", "r2"])).select(
        *columns, merged_headers(F.from_json("stored.h", "map<string,string>"), F.col("own")).alias("headers"), F.col("stored.body").alias("body"))
    # the others have no response to join with; as null keys they would meet in one task
    unknown = own.filter(~known).withColumn("outcome", F.lit("no_response")).withColumn("response_id", F.lit(None).cast(captures.schema["record_id"].dataType))
    rest = told.filter("outcome <> 'resolved'").select(*columns, "own").unionByName(unknown.select(*columns, "own"))
    return with_body.unionByName(rest.select(*columns, F.col("own").alias("headers"), F.lit(None).cast("string").alias("body")))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made of every row of ``pages``: a full response and, later, a revisit.

    Page p is captured at second 10 p.  Its entity tag is a digest of its
    html; every third page has a weak tag.  The revisit follows at 10 p +
    5, spelt with scheme and fragment of its own, and by p mod 5 carries the tag (0, 1), the date
    (2), another tag (3) or no validator (4).
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    tag = F.concat(F.when(p % 3 == 0, "W/").otherwise(""), F.lit('"'), digest, F.lit('"'))
    date = F.concat(F.lit("day "), (p % 365).cast("string"))
    text = lambda *x: F.map_from_arrays(F.array(*[F.lit(a) for a, _ in x]), F.array(*[b for _, b in x]))
    served = F.concat(F.lit("second "), (p * 10 + 5).cast("string"))
    common = [("Date", served), ("Cache-Control", F.lit("max-age=60")), ("Content-Length", F.lit("0")), ("Connection", F.lit("close"))]
    full = pages.select(
        (p * 2).alias("record_id"), "url", (p * 10).alias("captured"), F.lit(200).alias("status"),
        text(("ETag", tag), ("Last-Modified", date), ("Content-Length", F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")), ("Date", F.concat(F.lit("second "), (p * 10).cast("string")))).alias("headers"), F.col("html").alias("body"))
    again = pages.select(
        (p * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("#again")).alias("url"), (p * 10 + 5).alias("captured"), F.lit(304).alias("status"),
        F.when(p % 5 <= 1, text(("etag", F.concat(F.lit('"'), digest, F.lit('"'))), *common)).when(p % 5 == 2, text(("last-modified", date), *common))
        .when(p % 5 == 3, text(("etag", F.lit('"another"')), *common)).otherwise(text(*common)).alias("headers"), F.lit(None).cast("string").alias("body"))
    return full.unionByName(again)


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "captured", "outcome", "response_id", line.alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


_SITE = r"""regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^(www|m)\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g')"""

ORACLE_SQL = rf"""
WITH p AS (SELECT page_id AS p, url, html, md5(coalesce(html, '')) AS digest, 'day ' || (page_id % 365) AS day,
                  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
s AS (SELECT *, {_SITE} AS site FROM p),
r AS (
  SELECT v.p, v.p * 2 + 1 AS record_id, v.p * 10 + 5 AS captured, v.digest AS own, v.day AS own_day, w.p AS q, w.digest, w.day, w.html
  FROM s v ASOF LEFT JOIN s w ON v.site = w.site AND v.p * 10 + 5 > w.p * 10
), o AS (
  SELECT *, CASE WHEN q IS NULL THEN 'no_response' WHEN p % 5 <= 1 THEN CASE WHEN own = digest THEN 'resolved' ELSE 'changed' END
                 WHEN p % 5 = 2 THEN CASE WHEN own_day = day THEN 'resolved' ELSE 'changed' END WHEN p % 5 = 3 THEN 'changed' ELSE 'no_validator' END AS outcome FROM r
)
SELECT record_id, captured, outcome, CASE WHEN outcome = 'resolved' THEN q * 2 END AS response_id,
  CASE WHEN outcome = 'resolved' THEN
    'cache-control: max-age=60' || chr(10) || 'content-length: ' || coalesce(strlen(html), 0) || chr(10) || 'date: second ' || captured || chr(10)
    || 'etag: ' || CASE WHEN p % 5 <= 1 THEN '"' || own || '"' ELSE CASE WHEN q % 3 = 0 THEN 'W/' ELSE '' END || '"' || digest || '"' END || chr(10) || 'last-modified: ' || day
  ELSE 'cache-control: max-age=60' || chr(10) || 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: second ' || captured
    || CASE WHEN p % 5 <= 1 THEN chr(10) || 'etag: "' || own || '"' WHEN p % 5 = 2 THEN chr(10) || 'last-modified: ' || own_day WHEN p % 5 = 3 THEN chr(10) || 'etag: "another"' ELSE '' END
  END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM o
"""
