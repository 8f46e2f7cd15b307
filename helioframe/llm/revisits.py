"""Not-modified revisits of web archives, resolved to the response that they repeat.

A revisit record says that a server answered "not modified"; its content is the
latest earlier full response of the same page. The join is as of the revisit's
time, by canonical address. Records of an address are divided by time, so that
an address with a third of all records is many groups: within a division a
window finds the latest response; between them one row per division carries the
latest one on. Then the validators are checked (entity tag, else modification
time, else digest), and the headers that a 304 answer may change are merged into
the response's. DataFrame functions throughout; no body is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Header fields that a 304 answer updates (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Parameters of an address that only track visits.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Seconds of a division of an address's records.
DIVISION = 6 * 3600


def canonical(url: Column) -> Column:
    """One spelling of an address: no scheme, fragment, user, `www.`, default port, tracking
    parameters or closing slash; host in lower case, parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(host, r"^[^@]*@", "")), r"^www[0-9]*\.", "")
    host = F.regexp_replace(host, r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
                                  lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&")))
                    .otherwise(""))


def lowered(headers: Column) -> Column:
    """The headers with names in lower case; of fields named twice the last in name order counts."""
    entries = F.array_sort(F.filter(F.map_entries(headers), lambda e: e["value"].isNotNull()))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.when(
        F.array_position(F.slice(names, i + 2, F.size(names)), F.lower(e["key"])) == 0,
        F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))), lambda e: e.isNotNull())
    return F.map_from_entries(last)


def resolve(records: DataFrame, division: int = DIVISION) -> DataFrame:
    """Every revisit with the response it repeats.

    `records` has record_id, kind (response, revisit, ...), uri, at (timestamp),
    status, headers (a map) and digest; other columns are left aside. A full
    response has the status 200; of several at one time the largest record_id
    counts, and "earlier" is strictly earlier. Result per revisit: record_id,
    url, at, outcome, response_id, response_at, digest, headers. The outcome is
    `resolved` (validators agree), `unchecked` (there are none to compare),
    `changed` (they differ), `missing` (no earlier response) or `unplaced` (no
    address or time); only the first two get headers. Repeated rows resolve
    alike; an empty table gives an empty result.
    """
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", "status", "at", "digest", canonical(F.col("uri")).alias("url"),
        lowered(own).alias("headers"), F.unix_micros("at").alias("time"))
    rows = rows.withColumn("part", F.floor(F.col("time") / (division * 1_000_000)))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("time").isNotNull()
    order = F.when(full, F.struct("time", "record_id"))
    said = F.struct("record_id", "at", "digest", "headers")
    # Records without an address never match, so they need no common group.
    spread = F.when(F.col("url").isNull() | F.col("time").isNull(), F.xxhash64("record_id"))
    rows = rows.withColumns({"said": F.when(full, said), "order": order, "spread": spread})

    within = (Window.partitionBy("url", "part", "spread").orderBy("time")
              .rangeBetween(Window.unboundedPreceding, -1))
    near = rows.withColumn("near", F.max_by("said", "order").over(within)).where("kind = 'revisit'")
    last = (rows.where("spread IS NULL").groupBy("url", "part")
            .agg(F.max_by("said", "order").alias("last")))
    carried = last.select("url", "part", F.last("last", ignorenulls=True).over(
        Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = near.join(carried.where("carried IS NOT NULL"), ["url", "part"], "left").withColumn(
        "base", F.coalesce("near", "carried"))

    tag = lambda h: F.regexp_replace(h["etag"], r"^[Ww]/", "")
    mine, base = F.col("headers"), F.col("base.headers")
    agree = F.coalesce(tag(mine) == tag(base), mine["last-modified"] == base["last-modified"],
                       F.col("digest") == F.col("base.digest"))
    outcome = (F.when(F.col("spread").isNotNull(), "unplaced").when(F.col("base").isNull(), "missing")
               .when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed"))
    permitted = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", "at", "outcome", F.col("base.record_id").alias("response_id"),
        F.col("base.at").alias("response_at"), F.col("base.digest").alias("digest"),
        F.when(F.col("outcome").isin("resolved", "unchecked"), merged).alias("headers"))
