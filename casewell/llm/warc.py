"""WARC revisit resolution: as-of join of not-modified revisits to earlier full responses.

A revisit record names no body; it says that the resource at its URL was as the archive has it.
It is resolved to the latest earlier full response of the same canonical URL, and counts as
resolved if the validators agree. Headers of the response stay but for those that a 304 may
renew.

The as-of join is a distributed scan over the distinct times of all URLs in the order of URL and
time: range partitioning cuts that order into slices of about equal numbers of times wherever
they cluster, so a URL with a third of all captures, or with all of them within a second, is
many slices. Each slice hands on the last response of each of its URLs, the few slices of a URL
are scanned, and a time without an earlier response in its own slice takes the one handed to it.
Bodies take no part; a reference and a digest stand for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stored

#: Headers that a 304 response may renew.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query keys that name a campaign, a click or a server's session and never a resource.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid)(=|$)"
SLICE_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Scheme-free as in archive indexes, lower-case host without ``www.`` and without the port that is
    the scheme's own, no fragment, query sorted and without tracking keys, no slash at the end.
    Null for null and for text without ``://``."""
    scheme = ascii_lower(F.regexp_extract(url, r"^(?s)(.*?)://", 1))
    rest = F.regexp_extract(url, r"^(?s).*?://([^#]*)", 1)
    host = F.regexp_replace(ascii_lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"^(?s)[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, tail))


HEADERS = "array<struct<name:string,none:boolean,key:string,value:string>>"


def header_list(headers: Column) -> Column:
    """Headers by lower-case name, sorted. Of names that differ in case alone the one with a value wins,
    then the one least in code points (capitals before small letters)."""
    none = F.array().cast(HEADERS)
    one = lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].isNull().alias("none"), e["key"].alias("key"), e["value"].alias("value"))
    listed = F.coalesce(F.array_sort(F.transform(F.map_entries(headers), one)), none)
    firsts = lambda all_: F.filter(all_, lambda e, i: (i == 0) | (F.get(all_, i - 1)["name"] != e["name"]))
    return F.flatten(F.transform(F.array(listed), firsts))


def merge_headers(response: Column, revisit: Column) -> Column:
    """Headers of the response, lower-case names, renewed by what a 304 may carry. Null headers are none;
    names that differ in case alone are one header, see ``header_list``."""
    new = F.filter(header_list(revisit), lambda e: e["name"].isin(*RENEWED) & e["value"].isNotNull())
    both = lambda p: F.concat(F.filter(p["old"], lambda e: ~F.exists(p["new"], lambda n: n["name"] == e["name"])), p["new"])
    merged = F.transform(F.array(F.struct(header_list(response).alias("old"), new.alias("new"))), both)
    return F.map_from_entries(F.array_sort(F.transform(F.flatten(merged), lambda e: F.struct(e["name"], e["value"]))))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of ``records`` (``record_id, kind, url, ts, etag, last_modified, headers,
    digest``): these, ``canonical``, and ``resolved_id, resolved_digest, resolved_headers, state``.

    ``kind`` is ``response`` or ``revisit``; a response stands for itself (state ``response``).
    A revisit takes the response of the same canonical URL with the greatest ``(ts, record_id)``
    at an earlier ``ts``. Its state is ``resolved`` if a validator that both carry (etags without
    weakness marks, then last-modified) agrees and none differs, ``unchecked`` if they share
    none, ``conflict`` if one differs, ``orphan`` if there is no earlier response; only the first
    two carry a resolution. Null URLs, times and kinds are orphans; equal records are rows like
    others; an empty table gives no rows. A response without ``record_id`` answers like others,
    with a null ``resolved_id``; of several responses of one id and time the one least by digest,
    validators and headers answers. Other columns are ignored, whatever their names.
    """
    names = ["record_id", "kind", "url", "ts", "etag", "last_modified", "headers", "digest"]
    base = records.select(*names, canonical_url(F.col("url")).alias("canonical"))
    rows = stored(base, "records")
    usable = rows.filter("canonical is not null and ts is not null and kind in ('response', 'revisit')")
    # captures of one time count once, so neither a burst nor its URL is a large group
    answers = F.max(F.when(F.col("kind") == "response", F.struct("record_id")))
    times = usable.groupBy("canonical", "ts").agg(answers.alias("answer"))
    times = stored(times.select("canonical", "ts", F.when(F.col("answer").isNotNull(), F.struct("ts", "answer")).alias("one")), "times")
    slices = max(-(-times.count() // slice_rows), 1)
    cut = stored(times.repartitionByRange(slices, "canonical", "ts").withColumn("slice", F.spark_partition_id()), "slices")
    last = cut.groupBy("canonical", "slice").agg(F.max("one").alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.withColumn("handed", F.last("last", ignorenulls=True).over(before)).select("canonical", "slice", "handed")
    inside = Window.partitionBy("canonical", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("own", F.last("one", ignorenulls=True).over(inside)).join(handed, ["canonical", "slice"])
    seen = seen.withColumn("best", F.coalesce("own", "handed")).filter("best is not null")
    seen = stored(seen.select("canonical", "ts", F.col("best.ts").alias("__ts"), F.col("best.answer.record_id").alias("__id")), "seen")
    discard(times, cut)
    found = usable.filter("kind = 'revisit'").join(seen, ["canonical", "ts"], "left")
    shown = F.struct("digest", "etag", "last_modified", F.to_json("headers").alias("h"))
    responses = usable.filter("kind = 'response'").groupBy(F.col("canonical").alias("__c"), F.col("ts").alias("__t"), F.col("record_id").alias("__r"))
    responses = responses.agg(F.min_by(F.struct("etag", "last_modified", "headers", "digest"), shown).alias("r"))
    responses = responses.select(
        "__c", "__t", "__r", F.lit(True).alias("__hit"),
        F.col("r.etag").alias("r_etag"), F.col("r.last_modified").alias("r_modified"), F.col("r.headers").alias("r_headers"), F.col("r.digest").alias("r_digest"),
    )
    responses = stored(responses, "responses")  # a plain shuffle, so that the join splits a response of many revisits
    met = found.join(responses, (F.col("canonical") == F.col("__c")) & (F.col("__ts") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__r")), "left")
    strong = lambda c: F.regexp_replace(c, r"^\s*W/", "")
    agree = [strong(F.col("etag")) == strong(F.col("r_etag")), F.col("last_modified") == F.col("r_modified")]
    differs = F.coalesce(~agree[0], F.lit(False)) | F.coalesce(~agree[1], F.lit(False))
    checked = agree[0].isNotNull() | agree[1].isNotNull()
    state = F.when(F.col("__hit").isNull(), "orphan").when(differs, "conflict").when(checked, "resolved").otherwise("unchecked")
    keep = F.col("state").isin("resolved", "unchecked")
    revisits = met.withColumn("state", state).select(
        *names,
        "canonical",
        F.when(keep, F.col("__r")).alias("resolved_id"),
        F.when(keep, F.col("r_digest")).alias("resolved_digest"),
        F.when(keep, merge_headers(F.col("r_headers"), F.col("headers"))).alias("resolved_headers"),
        "state",
    )
    own = rows.filter("kind = 'response'").select(
        *names,
        "canonical",
        F.col("record_id").alias("resolved_id"),
        F.col("digest").alias("resolved_digest"),
        merge_headers(F.col("headers"), F.lit(None).cast("map<string,string>")).alias("resolved_headers"),
        F.lit("response").alias("state"),
    )
    none = rows.filter("(kind is null or kind <> 'response') and (canonical is null or ts is null or kind is null or kind <> 'revisit')").select(
        *names,
        "canonical",
        F.lit(None).cast(rows.schema["record_id"].dataType).alias("resolved_id"),
        F.lit(None).cast(rows.schema["digest"].dataType).alias("resolved_digest"),
        F.lit(None).cast("map<string,string>").alias("resolved_headers"),
        F.lit("orphan").alias("state"),
    )
    return own.unionByName(revisits).unionByName(none)
