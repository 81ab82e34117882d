"""URL filters as a temporal list join.

Dated list entries (blocked, allowed or taken off the list from a time on) become validity
intervals, by the next entry for the same value. Every capture is then looked up under
the values that could list it - its host, the host's domains and the beginnings of its
path - and evaluated against the entries active at its fetch time. The most specific
active entry decides. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import require
from caseflow.operators.skew import broadcast_if_small

#: Intervals that are broadcast at most. Longer lists are joined by a shuffle, in which
#: every list value has `SALTS` copies, so the captures of one host spread.
BROADCAST_INTERVALS = 200_000
SALTS = 32
#: Kinds of list values, from the least specific.
KINDS = ("domain", "host", "prefix")
#: Host names are no longer than this; others match nothing.
MAX_HOST = 253


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; NULL if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    host = F.lower(F.rtrim(bare, F.lit(".")))
    return F.when((host != "") & (F.char_length(host) <= MAX_HOST), host)


def path_of(url: Column) -> Column:
    """The path, without query and fragment; at least a slash."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Columns list, kind, value, status, valid_from, valid_to (exclusive; NULL: open).

    `entries`: list, kind (one of `KINDS`), value, listed_at, status (block, allow, off).
    An entry holds until the next one of its list for the same value. Of entries at one
    time `off` yields to `allow` and that to `block`; repeated ones count once. Entries
    with a NULL among kind, value, time or status are left out.
    """
    rows = require(entries, "list", "kind", "value", "listed_at", "status")
    rows = rows.dropna(subset=["kind", "value", "listed_at", "status"]).filter(F.col("kind").isin(*KINDS))
    rank = F.when(F.col("status") == "block", 2).when(F.col("status") == "allow", 1).otherwise(0)
    last = rows.groupBy("list", "kind", "value", "listed_at").agg(F.max_by("status", rank).alias("status"))
    by_value = Window.partitionBy("list", "kind", "value").orderBy("listed_at")
    held = last.withColumn("valid_to", F.lead("listed_at").over(by_value))
    return held.filter("status <> 'off'").withColumnRenamed("listed_at", "valid_from").select(
        "list", "kind", "value", "status", "valid_from", "valid_to"
    )


def lookup_values(host: Column, path: Column, depths: list[int]) -> Column:
    """Array of (kind, value) under which a capture can be listed.

    `depths`: the numbers of slashes of the prefixes in the list.
    """
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    parts = [domains, F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))]
    whole = F.concat(host, path)
    for depth in depths:
        begin = F.substring_index(whole, "/", depth)
        deep = F.char_length(whole) - F.char_length(F.replace(whole, F.lit("/"), F.lit(""))) >= depth
        one = F.array(F.struct(F.lit("prefix").alias("kind"), F.concat(begin, F.lit("/")).alias("value")))
        parts.append(F.when(deep, one).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    return F.when(host.isNotNull(), F.concat(*parts))


def judge_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of `captures` (page_id, url, fetched_at): those, host, n_active,
    verdict (block, allow, unlisted), list, kind, value, valid_from of the entry that decides.

    A domain lists itself and its subdomains, a host itself, a prefix (host and path up to
    a slash) what begins with it. The longest active value decides, then the later of
    `KINDS`, then a block, then the first list by name. Without host or fetch time a capture
    is unlisted; repeated rows are judged alike; an empty list leaves all unlisted.
    """
    intervals = validity_intervals(entries).filter("value <> ''")
    slashes = F.char_length("value") - F.char_length(F.replace("value", F.lit("/"), F.lit("")))
    found = intervals.filter("kind = 'prefix'").select(slashes.alias("depth")).distinct().collect()
    depths = sorted(r["depth"] for r in found if r["depth"])  # no more than a URL has slashes
    rows = require(captures, "page_id", "url", "fetched_at").groupBy("page_id", "url", "fetched_at")
    rows = rows.agg(F.count("*").alias("_copies")).withColumn("host", host_of(F.col("url")))
    looked = rows.withColumn("_key", F.explode_outer(lookup_values(F.col("host"), path_of(F.col("url")), depths)))
    keyed = intervals.select(
        "list", "status", "valid_from", "valid_to", F.col("kind").alias("_kind"), F.col("value").alias("_value")
    )
    small = broadcast_if_small(keyed, BROADCAST_INTERVALS)
    same = (
        (F.col("_key.kind") == F.col("_kind")) & (F.col("_key.value") == F.col("_value"))
        & (F.col("fetched_at") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    )
    if small is keyed:
        looked = looked.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
        small = keyed.withColumn("_list_salt", salts)
        same = same & (F.col("_salt") == F.col("_list_salt"))
    met = looked.join(small, same, "left")
    kinds = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("_kind"))
    best = F.when(F.col("_value").isNotNull(), F.struct(
        (-F.char_length("_value")).alias("size"), (-kinds).alias("kind_rank"), (F.col("status") != "block").alias("allows"),
        F.col("list"), F.col("status"), F.col("_kind"), F.col("_value"), F.col("valid_from"),
    ))
    judged = met.groupBy("page_id", "url", "fetched_at", "host", "_copies").agg(
        F.count("_value").alias("n_active"), F.min(best).alias("best")
    )
    return judged.select(
        "page_id", "url", "fetched_at", "host", "n_active", F.coalesce("best.status", F.lit("unlisted")).alias("verdict"),
        F.col("best.list").alias("list"), F.col("best._kind").alias("kind"), F.col("best._value").alias("value"),
        F.col("best.valid_from").alias("valid_from"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The judged captures that no active entry blocks."""
    return judge_captures(captures, entries).filter("verdict <> 'block'")
