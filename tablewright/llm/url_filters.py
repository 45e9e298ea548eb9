"""URL filters by dated lists: which lists were in force when a page was fetched.

A list is a log of dated entries: a domain is added or removed. The log becomes validity
intervals [from, until); an as-of join then evaluates every capture against the intervals
of its host and its parent domains that hold on the day of the fetch. Only the distinct
(host, day) pairs take part in that join, and their verdicts go back to the captures on
salted keys, so a host with a large share of all pages meets in no single task.

Defined cases: on one day a removal wins over an addition; an entry without day or domain is
ignored; a URL that is null or has no host matches nothing and is kept, as is a capture
without a day; equal rows are evaluated each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.functions.hashing import hash_number
from tablewright.llm.registry import query, table

SALTS = 16
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL, empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """Entries (list, domain, added boolean, day) as intervals (list, domain, from, until).

    First one state per list, domain and day, so that the window over a domain is bounded
    by the calendar, then only the days on which the state changes. ``until`` is null
    while an entry is still in force.
    """
    days = (
        entries.where("domain IS NOT NULL AND day IS NOT NULL").groupBy("list", "domain", "day")
        .agg(F.min("added").alias("added"))
    )
    order = Window.partitionBy("list", "domain").orderBy("day")
    changes = days.withColumn("was", F.lag("added", 1, False).over(order)).where("added <> was")
    return changes.withColumn("until", F.lead("day").over(order)).where("added").select(
        "list", "domain", F.col("day").alias("from"), "until")


def evaluate(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """``captures`` (with url, day) plus host, n_lists and kept (no list in force)."""
    located = captures.withColumn("host", host_of(F.col("url")))
    asked = located.where("host <> '' AND day IS NOT NULL").select("host", "day").distinct()
    labels = F.split("host", r"\.")
    suffixes = asked.select("host", "day", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("domain"))
    hit = (
        suffixes.join(intervals, "domain")
        .where(F.col("from") <= F.col("day")).where(F.col("until").isNull() | (F.col("day") < F.col("until")))
        .groupBy("host", "day").agg(F.countDistinct("list").alias("n"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = located.withColumn("salt", F.pmod(F.xxhash64("url", *_keys(captures)), F.lit(SALTS)))
    return (
        salted.join(hit.hint("merge"), ["host", "day", "salt"], "left")
        .select(*captures.columns, "host", F.coalesce("n", F.lit(0)).cast("long").alias("n_lists"))
        .withColumn("kept", F.col("n_lists") == 0)
    )


def _keys(captures: DataFrame) -> list[str]:
    return [c for c, kind in captures.dtypes if kind in ("bigint", "int")]


def _entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the hosts that occur in ``pages``: one host in three is added to each of
    two lists on a day of 2024 that follows from its name, and removed 30 to 129 days later."""
    hosts = pages.select(host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    named = hosts.withColumn("list", F.explode(F.array(F.lit("adult"), F.lit("malware"))))
    numbered = named.withColumn("h", hash_number(["list", "domain"], 3)).where("h % 3 = 0")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("h") / 3) % 300).cast("int"))
    end = F.date_add(start, (30 + F.floor(F.col("h") / 900) % 100).cast("int"))
    return numbered.select("list", "domain", F.explode(F.array(
        F.struct(F.lit(True).alias("added"), start.alias("day")),
        F.struct(F.lit(False).alias("added"), end.alias("day")))).alias("e")).select("list", "domain", "e.*")


@query("op3_url_filters", r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
             DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages),
n AS (SELECT DISTINCT host AS domain, l.list FROM p, (VALUES ('adult'), ('malware')) l(list) WHERE host <> ''),
h AS (SELECT *, CAST('0x' || substr(md5('3:' || list || ':' || domain), 1, 8) AS BIGINT) AS h FROM n),
i AS (SELECT list, domain, DATE '2024-01-01' + CAST(h // 3 % 300 AS INTEGER) AS a, CAST(30 + h // 900 % 100 AS INTEGER) AS len
      FROM h WHERE h % 3 = 0),
hits AS (SELECT p.page_id, count(DISTINCT i.list) AS n FROM p JOIN i
         ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND i.a <= p.day AND p.day < i.a + i.len GROUP BY 1)
SELECT p.page_id, p.host, p.day, coalesce(hits.n, 0) AS n_lists, coalesce(hits.n, 0) = 0 AS kept
FROM p LEFT JOIN hits USING (page_id)""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Pages carry no fetch day; the query takes the day of 2024 given by the page's number."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    captures = pages.withColumn(
        "day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return evaluate(captures, validity(_entries(pages))).select("page_id", "host", "day", "n_lists", "kept")
