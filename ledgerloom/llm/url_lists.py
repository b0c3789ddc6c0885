"""URL filters as a temporal list join.

A list is a table of dated entries (key, day, action 'add' or 'remove'); a key is a host, a parent
domain of at least two labels, or a host with its first path segment.  Entries become validity
intervals: a key is listed from an 'add' until its next 'remove'.  Every capture is evaluated
against the entries active when it was fetched: an as-of join puts entries and capture keys in one
stream per key, in time order, and carries the last entry forward.  A capture is listed when any
of its keys is, and the longest such key is reported with its interval.

A key with many captures is split over salts and its entries are repeated for each, so a host with
a third of all captures is many groups; the salts of a key follow from its number of captures.

Defined cases: an entry takes effect at its own instant; of several entries of one key and instant
'add' wins; an 'add' after an 'add' continues the interval; entries with a null key, day or an
unknown action are ignored; a null or malformed url or a null fetch day is never listed; repeated
captures repeat; an empty list lists nothing; an empty capture table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PER_SALT = 50_000
#: Scheme, optional user, host without port.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def keys_of(url: Column) -> Column:
    """The keys under which a url can be listed."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    segment = F.regexp_extract(F.lower(url), SEGMENT, 1)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, below)))


def intervals(entries: DataFrame) -> DataFrame:
    """key, since, until (null: still listed): the validity intervals of the dated entries."""
    dated = entries.where("key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    states = dated.groupBy("key", F.col("day").cast("timestamp").alias("at")).agg(F.max(F.col("action") == "add").alias("on"))
    in_time = Window.partitionBy("key").orderBy("at")
    changes = states.withColumn("was", F.lag("on").over(in_time)).where("NOT (on <=> coalesce(was, false))")
    return changes.withColumn("until", F.lead("at").over(in_time)).where("on").select("key", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched) with host, listed, list_key, since and until."""
    rows = captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched"))
    asked = rows.where("fetched IS NOT NULL").select("page_id", "url", "fetched", F.explode_outer(keys_of(F.col("url"))).alias("key")).where("key IS NOT NULL")
    valid = intervals(entries)
    salts = asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts"))
    known = valid.join(salts, "key")
    opened = known.select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("since").alias("at"), "since", "until")
    wanted = asked.join(known.select("key", "salts").distinct(), "key")
    wanted = wanted.select("key", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.col("salts")).cast("int").alias("salt"), F.col("fetched").alias("at"), "page_id", "url")
    stream = opened.withColumn("entry", F.lit(0)).unionByName(wanted.withColumn("entry", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("key", "salt").orderBy("at", "entry").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("entry") == 0, F.struct("since", "until")), ignorenulls=True).over(so_far)
    found = stream.withColumn("held", carried).where("entry = 1 AND held IS NOT NULL AND (held.until IS NULL OR at < held.until)")
    best = found.groupBy("page_id", "url", F.col("at").alias("fetched")).agg(F.max(F.struct(F.length("key").alias("n"), "key", "held")).alias("best"))
    joined = rows.alias("r").join(best.alias("b"), F.expr("r.page_id <=> b.page_id AND r.url = b.url AND r.fetched = b.fetched"), "left")
    return joined.select(
        "r.page_id",
        host_of(F.col("r.url")).alias("host"),
        F.col("r.fetched").cast("date").alias("fetched_on"),
        F.col("b.best").isNotNull().alias("listed"),
        F.col("b.best.key").alias("list_key"),
        F.col("b.best.held.since").cast("date").alias("listed_since"),
        F.col("b.best.held.until").cast("date").alias("listed_until"),
    )
