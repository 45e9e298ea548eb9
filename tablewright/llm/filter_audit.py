"""How filters interact: what each removes in every order, by a recursive CTE.

Every document gets a mask, one bit per filter that it fails. Documents are counted per part
and mask, so at most ``2 ** filters`` cells a part are left, packed into one array per part
and counter. A recursive CTE then starts from the empty prefix and, level by level, extends
each prefix of filters by every letter that it lacks (``explode``, no join), joins the
part's cells and carries the bits applied so far; the row of a level holds that step's
counts. Full orders read the rows of their prefixes.

Copies are found by the SHA-256 of the text: rows are first counted per (digest, part, mask,
labels, doc_id), so that no group of copies meets in one task, and what is left per digest is
at most one row per part and labels.

Defined cases: a null text is empty, a null language the part ``''``; a null doc_id has no
label, is no smaller than any other and counts as no copy; of equal rows with the smallest
doc_id all count as first; several labels of one doc_id count as 1 if any is 1, rows
of ``labels`` without doc_id are ignored; very long texts are read whole; ties cannot arise, as
thresholds are strict; an empty table gives no rows; other columns are ignored, whatever their
names. One row of the recursion per part and prefix: 325 a part for five filters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage, scratch_path

_WHITE = r"[ \t\n\x0B\f\r]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTERS = ("n", "good", "toxic")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that one text decides, as conditions for failing."""
    words = F.array_remove(F.split(text, _WHITE), "")
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, _CAPITALS, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * length,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mark(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, digest, mask) of the documents; bit i of the mask is the i-th filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = None
    for bit, failed in enumerate(text_failures(text).values()):
        own = F.when(failed, 1 << bit).otherwise(0)
        mask = own if mask is None else mask.bitwiseOR(own)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def with_labels(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked`` with good and toxic, 0 or 1. Rows without doc_id match nothing and are spread by their digest."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"), F.lit(0).alias("spread"))
    spread = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    return marked.withColumn("spread", spread).join(one, ["doc_id", "spread"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).drop("spread")


def mask_cells(labelled: DataFrame, copy_bit: int) -> DataFrame:
    """Rows (part, mask, n, good, toxic), with ``copy_bit`` set for documents whose text has a smaller doc_id."""
    keys = ["digest", "part", "mask", "good", "toxic"]
    once = labelled.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    grouped = once.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))  # one row per part and labels
    firsts = grouped.withColumn("smallest", smallest).select(
        "part", "mask", "good", "toxic", "n",
        (F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)).alias("firsts"))
    counted = firsts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("firsts").alias("firsts"))
    sides = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))
    split = counted.select("part", "good", "toxic", F.explode(sides).alias("s"))
    return split.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"),
        *[F.sum(F.when(F.col(c) == 1, F.col("s.n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def pack_cells(cells: DataFrame) -> DataFrame:
    """One row per part: its cells as an array, one struct per mask that occurs."""
    return cells.where("n > 0").groupBy("part").agg(
        F.sort_array(F.collect_list(F.struct("mask", *COUNTERS))).alias("cells"))


def _total(counter: str, condition: str) -> str:
    return f"aggregate(filter(c.cells, x -> {condition}), 0L, (s, x) -> s + x.{counter})"


def audit_prefixes(packed: DataFrame, letters: str) -> DataFrame:
    """One row per part and prefix of filters with the counts of its last step.

    Spark stops a recursion at a number of rows that suits endless ones; this one ends by itself, so
    the limit is lifted while the rows are written to the shared folder.
    """
    spark = packed.sparkSession
    listed = ", ".join(f"'{x}'" for x in letters)
    removed = "x.mask & e.applied = 0 AND x.mask & e.bit <> 0"
    text = f"""
    WITH RECURSIVE steps(part, prefix, letter, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
      SELECT part, '', '', 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{packed}}
      UNION ALL
      SELECT e.part, concat(e.prefix, e.letter), e.letter, e.step, e.applied | e.bit,
             {_total("n", "x.mask & (e.applied | e.bit) = 0")}, {_total("n", removed)},
             {_total("n", "x.mask & e.applied <> 0 AND x.mask & e.bit <> 0")}, {_total("n", "x.mask = e.bit")},
             {_total("good", removed)}, {_total("toxic", removed)}
      FROM (SELECT s.part, s.prefix, s.applied, s.step + 1 AS step, l.letter,
                   shiftleft(1, array_position(array({listed}), l.letter)::INT - 1) AS bit
            FROM steps s LATERAL VIEW explode(filter(array({listed}), l -> instr(s.prefix, l) = 0)) l AS letter) e
      JOIN {{packed}} c ON c.part = e.part)
    SELECT * FROM steps WHERE step > 0"""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return cut_lineage(spark.sql(text, packed=packed))
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """Every order of the filters, step by step, from rows (part, mask, n, good, toxic)."""
    path = scratch_path(cells.sparkSession, "cells")
    pack_cells(cells).write.parquet(path)
    steps = audit_prefixes(cells.sparkSession.read.parquet(path), letters)
    size = len(letters)
    # A prefix of k letters begins (size - k)! full orders.
    times = F.create_map(*[F.lit(x) for k in range(1, size + 1) for x in (k, math.factorial(size - k))])
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * times[F.col("step")]).alias("shapley"))
    orders = steps.where(F.col("step") == size).select(
        "part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    return (
        orders.withColumn("prefix", F.expr("left(filter_order, step)")).join(steps, ["part", "prefix", "step"])
        .join(shapley, ["part", "letter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to D of :func:`text_failures` and E, copies of a smaller doc_id."""
    return audit(mask_cells(with_labels(mark(docs), labels), copy_bit=16), "ABCDE")


_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 200)::INT
    + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT letter AS filter_order, bit AS bits, [bit] AS path FROM f
      UNION ALL SELECT filter_order || letter, bits | bit, path || [bit] FROM o JOIN f ON bits & bit = 0),
s AS (SELECT filter_order, step, path[step] AS bit, coalesce(list_sum(path[1:step - 1]), 0)::INT AS applied
      FROM (SELECT filter_order, path, unnest([1, 2, 3, 4, 5]) AS step FROM o WHERE len(path) = 5)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


@query("op13_filter_audit", _SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels"))
