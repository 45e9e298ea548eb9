"""Quality rules with thresholds that each language and source sets for itself.

Every document is measured with SQL functions only. Its rates go into a mergeable quantile
sketch per (lang, source): counts of buckets, of a fixed width below ``TOP`` and of 1/128 to 1/256 of the rate
beyond it, which add up in any order, so a repeated or retried task cannot move a threshold. The quartiles read from a sketch give the
fence ``q75 + max(3 * (q75 - q25), margin)``; a group with fewer than ``MIN_GROUP``
documents uses the merged sketch of its language, then that of all. Documents are joined
with their group's fences and filtered.

Defined cases: a null or empty text has no words and fails the base rule; a null language or
source is a group of its own; equal rows each count; an empty table gives no rows; other
columns are carried but never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200
# Rate in thousandths -> (bucket width, least distance of the fence from the upper quartile).
RATES = {"symbol_rate": (10, 100), "dup_line_rate": (10, 500), "word_length": (50, 4_000)}
# Buckets of rates from here on grow with the rate.
TOP = 20_000
SALTS = 16

_WHITE = r"[ \t\n\x0B\f\r]"


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    p = prefix
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(f"{p}words", F.array_remove(F.split(text, f"{_WHITE}+"), ""))
    words = F.col(f"{p}words")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    out = out.withColumns({
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}lines": lines,
        f"{p}windows": F.when(F.size(words) >= 3, F.transform(
            F.slice(words, 1, F.size(words) - 2),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))),
    })
    windows = F.col(f"{p}windows")
    out = out.withColumn(f"{p}repeated", F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.col(f"{p}repeated")
    hits = F.filter(repeated, lambda e, i: (
        (i > 0) & (F.get(repeated, F.greatest(i - 1, F.lit(0)))["h"] == e["h"])
    ) | F.coalesce(F.get(repeated, i + 1)["h"] == e["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(hits, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    return out.withColumns({
        f"{p}word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        f"{p}n_symbols": (F.char_length(text) - F.char_length(
            F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}n_repeat_words": F.when(repeated.isNotNull(), F.size(covered)).otherwise(0).cast("long"),
    }).drop(f"{p}words", f"{p}lines", f"{p}windows", f"{p}repeated")


def rates(prefix: str = "") -> dict[str, Column]:
    """Whole thousandths, exact in any engine: null for a text without words."""
    p = prefix

    def share(part: str, of: str) -> Column:
        return F.expr(f"CASE WHEN {p}{of} > 0 THEN 1000 * {p}{part} DIV {p}{of} END")

    return {
        "symbol_rate": share("n_symbols", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
    }


def bucket_width(value: Column, width: Column) -> Column:
    """Width of the bucket that holds ``value``: beyond ``TOP`` a power of two that leaves eight binary digits."""
    return F.when(value < TOP, width).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(value)) - 8))


def sketches(measured: DataFrame, prefix: str = "") -> DataFrame:
    """Bucket counts (lang, source, rate, bucket, n), a bucket named by its least value; map-side sums, so a
    hot source is cheap."""
    each = F.array(*[
        F.struct(F.lit(name).alias("rate"), (value - value % bucket_width(value, F.lit(RATES[name][0]))).cast("long").alias("bucket"))
        for name, value in rates(prefix).items()
    ])
    return (
        measured.where(f"{prefix}n_words > 0").select("lang", "source", F.explode(each).alias("s"))
        .groupBy("lang", "source", "s.rate", "s.bucket").agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys`` and rate: n and the buckets of the lower and upper quartile."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")  # TOP / width buckets, and 128 for each doubling of TOP
    run = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    counted = merged.select(*keys, "rate", "bucket", run.alias("run"), F.sum("n").over(group).alias("total"))
    return counted.groupBy(*keys, "rate").agg(
        F.max("total").alias("total"),
        F.min(F.expr("CASE WHEN 4 * run >= total THEN bucket END")).alias("q25"),
        F.min(F.expr("CASE WHEN 4 * run >= 3 * total THEN bucket END")).alias("q75"),
    )


def fences(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with a fence per rate, in thousandths."""
    own = quartiles(sketch, ["lang", "source"])
    parent = quartiles(sketch, ["lang"]).select(
        F.col("lang").alias("p_lang"), F.col("rate").alias("p_rate"), F.col("total").alias("p_total"),
        F.col("q25").alias("p_q25"), F.col("q75").alias("p_q75"))
    whole = quartiles(sketch, []).select(
        F.col("rate").alias("w_rate"), F.col("q25").alias("w_q25"), F.col("q75").alias("w_q75"))
    joined = (
        own.join(parent, own["lang"].eqNullSafe(F.col("p_lang")) & (F.col("rate") == F.col("p_rate")))
        .join(F.broadcast(whole), F.col("rate") == F.col("w_rate"))  # three rows
    )

    def chosen(q: str) -> Column:
        return (F.when(F.col("total") >= min_group, F.col(q)).when(F.col("p_total") >= min_group, F.col(f"p_{q}"))
                .otherwise(F.col(f"w_{q}")))

    width = F.create_map(*[F.lit(x) for name, (w, _) in RATES.items() for x in (name, w)])
    margin = F.create_map(*[F.lit(x) for name, (_, m) in RATES.items() for x in (name, m)])
    high = chosen("q75")
    fence = high + bucket_width(high, width[F.col("rate")]) + F.greatest(
        3 * (high - chosen("q25")), margin[F.col("rate")])
    return joined.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rate") == name, fence)).alias(f"{name}_fence") for name in RATES])


def judge(measured: DataFrame, prefix: str = "", min_group: int = MIN_GROUP) -> DataFrame:
    """``measured`` (stored or cheap to repeat) with {prefix}base_failed and {prefix}kept.

    The few fence rows are copied to ``SALTS`` salts, so that no source, however large its
    share of the documents, meets in one task.
    """
    p = prefix
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{p}g_salt")
    groups = fences(sketches(measured, p), min_group).select(
        F.col("lang").alias(f"{p}g_lang"), F.col("source").alias(f"{p}g_source"),
        *[F.col(f"{n}_fence").alias(f"{p}{n}_fence") for n in RATES], salts)
    failed = (F.col(f"{p}n_words") < MIN_WORDS) | (
        100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{p}n_words"))
    inside = None
    for name, value in rates(p).items():
        ok = value <= F.col(f"{p}{name}_fence")
        inside = ok if inside is None else inside & ok
    salted = measured.withColumn(f"{p}salt", F.pmod(F.xxhash64(f"{p}word_chars", f"{p}n_words"), F.lit(SALTS)))
    joined = salted.join(
        groups,
        F.col("lang").eqNullSafe(F.col(f"{p}g_lang")) & F.col("source").eqNullSafe(F.col(f"{p}g_source"))
        & (F.col(f"{p}salt") == F.col(f"{p}g_salt")), "left")
    return joined.withColumns({
        f"{p}base_failed": failed, f"{p}kept": F.coalesce(~failed & inside, F.lit(False)),
    }).drop(f"{p}salt", f"{p}g_salt", f"{p}g_lang", f"{p}g_source", *[f"{p}{n}_fence" for n in RATES])


def keep_good(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; measured once, into the shared folder."""
    p = "__q_"
    return judge(cut_lineage(measure(docs, p)), p, min_group).where(f"{p}kept").select(*docs.columns)


_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY 1),
m AS (SELECT d.doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT lang, source, unnest([
        {'rate': 'symbol_rate', 'w': 10, 'v': 1000 * n_symbols // n_words},
        {'rate': 'dup_line_rate', 'w': 10, 'v': 1000 * n_dup_lines // n_lines},
        {'rate': 'word_length', 'w': 50, 'v': 1000 * word_chars // n_words}]) AS s FROM m WHERE n_words > 0),
b AS (SELECT lang, source, s.rate AS rate, s.v - s.v % (CASE WHEN s.v < 20000 THEN s.w ELSE 1::BIGINT << (length(bin(s.v)) - 8) END) AS bucket FROM r),
own AS (SELECT lang, source, rate, count(*) AS total, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75 FROM b GROUP BY ALL),
par AS (SELECT lang, rate, count(*) AS total, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75 FROM b GROUP BY ALL),
al AS (SELECT rate, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75 FROM b GROUP BY ALL),
q AS (SELECT own.lang, own.source, rate,
        CASE WHEN own.total >= 200 THEN own.q25 WHEN par.total >= 200 THEN par.q25 ELSE al.q25 END AS q25,
        CASE WHEN own.total >= 200 THEN own.q75 WHEN par.total >= 200 THEN par.q75 ELSE al.q75 END AS q75,
        CASE WHEN rate = 'word_length' THEN 50 ELSE 10 END AS w,
        CASE rate WHEN 'symbol_rate' THEN 100 WHEN 'dup_line_rate' THEN 500 ELSE 4000 END AS margin
      FROM own JOIN par USING (lang, rate) JOIN al USING (rate)),
f AS (SELECT lang, source, max(fence) FILTER (rate = 'symbol_rate') AS fs, max(fence) FILTER (rate = 'dup_line_rate') AS fd,
        max(fence) FILTER (rate = 'word_length') AS fw
      FROM (SELECT *, q75 + CASE WHEN q75 < 20000 THEN w ELSE 1::BIGINT << (length(bin(q75)) - 8) END + greatest(3 * (q75 - q25), margin) AS fence FROM q) GROUP BY ALL),
j AS (SELECT m.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, fs, fd, fw
      FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND 1000 * n_symbols // n_words <= fs AND 1000 * n_dup_lines // n_lines <= fd
    AND 1000 * word_chars // n_words <= fw, FALSE) AS kept FROM j"""


@query("op5_quality_rules", _SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    measured = cut_lineage(measure(table(spark, sf, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
