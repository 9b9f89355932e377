"""Web archives: revisit records resolved to the response that they say has not changed.

A revisit (or a 304 answer) stands for the latest earlier full response of its canonical URL. It
is resolved if its validators agree with that response: an entity tag (compared weakly), else
the time of last modification, else the payload digest; without any validator, or against a
response that lacks the given one, it stays unresolved. The resolved record has the response's
payload, and its headers updated by those that the revisit may update; headers that describe the
stored payload or the connection stay as they were.

The as-of join is one ordered pass. A URL with very many captures is cut into stretches of time:
each stretch hands its last full response on to the next ones, of which there is one small row a
stretch, and no window holds more than a stretch of one URL. Payloads aren't moved: the resolved
record names the record that holds them, and :func:`with_payloads` fetches them by an equi-join.

Defined results: records without a URL or time are kept and never matched; a revisit without an
earlier response has status ``orphan``. Of equal times, full responses come before revisits and
then the record id decides. Repeated rows are separate records. Header names fold their case; a
null header map is an empty one. Empty tables give no rows; other columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Headers of a 304 answer that must not replace the stored ones.
NOT_UPDATED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range",
    "content-type", "digest", "keep-alive", "proxy-authenticate", "proxy-authorization",
    "set-cookie", "te", "trailer", "transfer-encoding", "upgrade", "www-authenticate",
]
#: Query parameters that only track a visitor.
TRACKING = "(?i)(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)"


def canonical(url: Column) -> Column:
    """A URL without scheme, www, mobile prefix, default port, fragment, tracking or closing slash.

    The host is in lower case; parameters are sorted.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^(?i)https?://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^(?:www|m)\\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    parts = F.array_sort(
        F.filter(
            F.split(query, "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(f"^{TRACKING}$")
        )
    )
    text = F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))
    return F.when(url.isNotNull() & (F.trim(url) != ""), text)


def header_map(block: Column) -> Column:
    """Headers of an HTTP block as a map with names in lower case; the last of equal names wins."""
    lines = F.filter(F.split(block, "\r?\n"), lambda line: line.rlike("^[^:\\s]+:"))
    pairs = F.transform(
        lines,
        lambda line: F.struct(
            F.lower(F.regexp_extract(line, "^([^:]+):", 1)).alias("key"),
            F.trim(F.regexp_extract(line, "^[^:]+:(.*)$", 1)).alias("value"),
        ),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(
        names,
        lambda name: F.struct(
            name.alias("key"),
            F.element_at(F.filter(pairs, lambda p: p["key"] == name), -1)["value"].alias("value"),
        ),
    )
    return F.map_from_entries(last)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolved(records: DataFrame, stretch: int = 86_400) -> DataFrame:
    """Every record with its ``status``, ``payload_record`` and merged ``headers``.

    Needs record_id, url, ts (timestamp), kind ('response' or 'revisit'), http_status (int),
    headers (map with names in lower case), digest. ``stretch`` is in seconds.
    """
    response = F.struct("record_id", "headers", "digest", "ts")
    order = [F.col("ts"), F.col("full").desc(), F.col("record_id")]
    base = records.select(
        "record_id",
        canonical(F.col("url")).alias("place"),
        "ts",
        ((F.col("kind") == "response") & (F.coalesce("http_status", F.lit(200)) != 304)).alias("full"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "digest",
    )
    base = base.withColumn("part", F.floor(F.unix_timestamp("ts") / stretch))
    known = base.where("place IS NOT NULL AND ts IS NOT NULL")
    last = (
        known.where("full")
        .groupBy("place", "part")
        .agg(F.max_by(response, F.struct("ts", "record_id")).alias("ended"))
    )
    parts = known.groupBy("place", "part").agg(F.lit(1).alias("one")).join(last, ["place", "part"], "left")
    before = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "place", "part", F.last("ended", ignorenulls=True).over(before).alias("carried")
    )
    so_far = (
        Window.partitionBy("place", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.last(F.when(F.col("full"), response), ignorenulls=True).over(so_far)
    found = (
        known.withColumn("own", own)
        .join(carried, ["place", "part"], "left")
        .withColumn("from", F.when(~F.col("full"), F.coalesce("own", "carried")))
        .drop("own", "carried")
    )
    lost = base.where("place IS NULL OR ts IS NULL").withColumn(
        "from", F.lit(None).cast(found.schema["from"].dataType)
    )
    every = found.unionByName(lost)

    def value(source: str, name: str) -> Column:
        return F.try_element_at(F.col(source), F.lit(name))

    tag, since = value("headers", "etag"), value("headers", "last-modified")
    agrees = (
        F.when(tag.isNotNull(), F.equal_null(_weak(tag), _weak(value("from.headers", "etag"))))
        .when(since.isNotNull(), F.equal_null(since, value("from.headers", "last-modified")))
        .when(F.col("digest").isNotNull(), F.equal_null(F.col("digest"), F.col("from.digest")))
        .otherwise(F.lit(False))
    )
    status = (
        F.when(F.coalesce("full", F.lit(False)), "full")
        .when(F.col("from").isNull(), "orphan")
        .when(agrees, "resolved")
        .otherwise("changed")
    )
    allowed = F.map_filter("headers", lambda k, _: ~k.isin(NOT_UPDATED))
    stays = F.map_filter(
        F.col("from.headers"), lambda k, _: ~F.coalesce(F.map_contains_key(allowed, k), F.lit(False))
    )
    every = every.withColumn("status", status)
    return every.select(
        "record_id",
        "place",
        "ts",
        "status",
        F.when(F.col("status") == "full", F.col("record_id"))
        .when(F.col("status") == "resolved", F.col("from.record_id"))
        .alias("payload_record"),
        F.when(F.col("status") == "resolved", F.map_concat(stays, allowed))
        .otherwise(F.col("headers"))
        .alias("headers"),
    )


def with_payloads(found: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved records with their payload; ``payloads`` has one row (record_id, payload) each."""
    held = payloads.select(F.col("record_id").alias("payload_record"), "payload")
    return found.join(held, "payload_record", "left")
