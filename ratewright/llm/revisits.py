"""Not-modified revisits of web captures: an as-of join by canonical URL, in DataFrame functions.

A revisit record holds the validators and headers of a response without body. It takes its body from the latest
earlier full response of the same canonical URL, if a validator agrees. The join is a running last value over
captures by time. Captures of one URL are first dealt into spans of time of bounded size; each span hands its
last full response to the following ones, so that a URL with a third of all captures still spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewright.llm.common import cut, maybe_broadcast

#: Headers that a response without body may update, and query fields that don't name another page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"

#: Captures of a URL in one span of time, if they are evenly spread.
SPAN_ROWS = 5_000


def canonical(url: Column) -> Column:
    """Host in lower case without port and leading www, path without its last slash, query fields in order without
    tracking ones; no scheme and fragment. Null stays null."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    place, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, r"^[^/]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(.*)$", 1), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")))


def resolve(captures: DataFrame) -> DataFrame:
    """Each revisit of `captures` with the full response it stands for.

    captures: id, url, at (long), full (boolean), etag, digest (validators, or null), headers (map). Gives id,
    canonical, base_id, status and headers: `resolved` if the latest earlier full response of the canonical URL
    agrees in a validator that both have (etag; digest if either has no etag), `changed` if they disagree,
    `unchecked` if they share none, `missing` without earlier response. Headers of the base, and over them those
    of the revisit that a response without body may update; the revisit's own if nothing was resolved.

    Of full responses at the same time the largest id counts; one at the revisit's own time isn't earlier. Null
    URLs and times resolve nothing. Repeated revisits each give a row. An empty table gives none.
    """
    rows = captures.select("id", canonical(F.col("url")).alias("canonical"), "at", "full", "etag", "digest", "headers")
    rows = cut(rows, "captures")
    # without URL or time nothing is resolved: such captures don't take part in the as-of join
    apart = rows.filter((F.col("canonical").isNull() | F.col("at").isNull()) & ~F.col("full"))
    everything, rows = rows, rows.filter(F.col("canonical").isNotNull() & F.col("at").isNotNull())
    counts = rows.groupBy("canonical").agg(F.count("*").alias("n"), F.min("at").alias("from"), F.max("at").alias("to")).filter(F.col("n") > SPAN_ROWS)
    counts = counts.select("canonical", "from", F.greatest(F.ceil((F.col("to") - F.col("from") + 1) / F.ceil(F.col("n") / SPAN_ROWS)), F.lit(1)).alias("width"))
    hot = cut(counts, "captures-hot")
    rows = rows.join(maybe_broadcast(hot, most=10_000), "canonical", "left").withColumn("span", F.coalesce(F.floor((F.col("at") - F.col("from")) / F.col("width")), F.lit(0))).drop("from", "width")
    held = F.struct("at", "id", "etag", "digest", "headers")
    value = F.when(F.col("full") & F.col("at").isNotNull() & F.col("canonical").isNotNull(), F.struct("at", "id"))
    # what each span ends with, handed on to the spans after it; only URLs of several spans have any
    last = rows.filter("full").groupBy("canonical", "span").agg(F.max(value).alias("last"))
    carried = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.select("canonical", "span").distinct().join(last, ["canonical", "span"], "left").withColumn("before", F.max("last").over(carried)).filter("before is not null").select("canonical", "span", "before")
    inside = Window.partitionBy("canonical", "span").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.max(value).over(inside)).filter("not full").join(ends, ["canonical", "span"], "left")
    seen = seen.withColumn("base", F.coalesce("near", "before")).select("id", "canonical", "at", "etag", "digest", "headers", F.col("base.id").alias("base_id"))
    seen = seen.unionByName(apart.select("id", "canonical", "at", "etag", "digest", "headers", F.lit(None).cast(everything.schema["id"].dataType).alias("base_id")))
    base = rows.filter("full").select(F.col("canonical").alias("b_canonical"), F.col("id").alias("b_id"), held.alias("b")).dropDuplicates(["b_canonical", "b_id"])
    joined = seen.join(base, (F.col("canonical") == F.col("b_canonical")) & (F.col("base_id") == F.col("b_id")), "left")
    verdict = (
        F.when(F.col("b").isNull() | F.col("at").isNull(), "missing").when(F.col("etag").isNotNull() & F.col("b.etag").isNotNull(), F.when(F.col("etag") == F.col("b.etag"), "resolved").otherwise("changed"))
        .when(F.col("digest").isNotNull() & F.col("b.digest").isNotNull(), F.when(F.col("digest") == F.col("b.digest"), "resolved").otherwise("changed")).otherwise("unchecked")
    )
    none = F.create_map().cast("map<string,string>")
    own, theirs = F.coalesce("headers", none), F.coalesce("b.headers", none)
    update = F.map_filter(own, lambda k, v: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(update), k))
    joined = joined.withColumn("status", verdict)
    return joined.select("id", "canonical", F.when(F.col("status") != "missing", F.col("base_id")).alias("base_id"), "status", F.when(F.col("status") == "resolved", F.map_concat(kept, update)).otherwise(own).alias("headers"))
