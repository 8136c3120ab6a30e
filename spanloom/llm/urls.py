"""URL filters: dated list entries become validity intervals; every capture is judged by the entries active when it was fetched.

Entries are (domain, action, day, listed_by): `action` is 'add' or 'remove'. An 'add' is active from its day until the
next entry of the same domain and list; a 'remove' ends it. A domain covers itself and all its subdomains. Where
several entries are active the longest domain wins, then the latest start, then the list's name.

Captures meet entries by host: the hosts are made distinct first, so a host with any number of captures is looked up
once, and a host's intervals are merged into a timeline of change points, of which a capture takes the last that is
not after its fetch (the as-of step). Captures join timelines on the host; only this join sees a hot host, as the
larger side, which adaptive execution splits, and only where the timelines are too large for a broadcast.

Defined results: a null or malformed URL has a null host and is not blocked; a null fetch day or null entry field never
matches; entries repeated on one day count once, and 'remove' wins a tie on a day; pages repeated stay repeated;
no entries block nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import small
from spanloom.scratch import settle

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries -> (domain, listed_by, since, until): half-open day ranges of validity; until is null while still listed."""
    per_day = (
        entries.where("domain is not null and action is not null and day is not null")
        .groupBy(F.lower("domain").alias("domain"), F.coalesce("listed_by", F.lit("")).alias("listed_by"), "day")
        .agg(F.max("action").alias("action"))  # 'remove' sorts after 'add'
    )
    order = Window.partitionBy("domain", "listed_by").orderBy("day")
    return (
        per_day.withColumn("until", F.lead("day").over(order))
        .where("action = 'add'")
        .select("domain", "listed_by", F.col("day").alias("since"), "until")
    )


def suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def timelines(hosts: DataFrame, valid: DataFrame) -> DataFrame:
    """Distinct hosts (host) and intervals -> (host, line): sorted change points with the winning entry, or nulls, from each on."""
    # Unlisted suffixes go before the shuffle, so that one like `com` brings all hosts together only if it is listed.
    listed = valid.select("domain").distinct()
    met = hosts.withColumn("domain", F.explode(suffixes(F.col("host")))).join(small(listed, "domain"), "domain", "left_semi").join(small(valid, "domain", "listed_by"), "domain")
    entry = F.struct(F.length("domain").alias("reach"), "since", "listed_by", "domain", "until")
    gathered = met.groupBy("host").agg(F.collect_set(entry).alias("all"))
    points = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform("all", lambda e: e.since), F.transform("all", lambda e: e.until)))))
    active = lambda p: F.array_max(F.filter("all", lambda e: (e.since <= p) & (e.until.isNull() | (e.until > p))))
    return gathered.select("host", F.transform(points, lambda p: F.struct(p.alias("day"), active(p).alias("entry"))).alias("line"))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) -> (page_id, host, fetched, blocked, domain, listed_by, since) for every row."""
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    lines = timelines(rows.where("host is not null").select("host").distinct(), intervals(entries))
    lines = settle(lines.withColumn("told", F.to_json("line")), "lines")  # told: its size decides on a broadcast
    held = rows.join(small(lines, "host", "told").drop("told"), "host", "left")
    at = F.element_at(F.filter("line", lambda p: p.day <= F.col("fetched")), -1)
    held = held.withColumn("hit", F.when(F.size(F.filter("line", lambda p: p.day <= F.col("fetched"))) > 0, at["entry"]))
    return held.select(
        "page_id",
        "host",
        "fetched",
        F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.domain").alias("domain"),
        F.col("hit.listed_by").alias("listed_by"),
        F.col("hit.since").alias("since"),
    )
