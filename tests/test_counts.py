"""Value counts: long texts travel as digests, and whole texts decide."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from test_plan_shape import plan_of

from tablewright.analysis import categorical_insights
from tablewright.functions import counts as counting
from tablewright.functions import most_frequent, value_counts
from tablewright.operators import FillNa

LONG = "x" * counting.BEGINNING


def plain(rows, k):
    out = {}
    for name in rows[0]:
        seen = Counter(r[name] for r in rows if r[name] is not None)
        out[name] = [(i + 1, str(v), n) for i, (v, n) in enumerate(sorted(seen.items(), key=lambda e: (-e[1], e[0]))[:k])]
    return out


def found(df, columns, k):
    out = {c: [] for c in columns}
    for r in most_frequent(df, value_counts(df, columns), k).orderBy("column", "rank").collect():
        out[r["column"]].append((r["rank"], r["value"], r["n"]))
    return out


def test_most_frequent_equal_a_plain_count(spark):
    """Ties inside long texts with one beginning, a text that is such a beginning, empty texts, numbers, gaps."""
    rng = random.Random(4)
    texts = [LONG, LONG + "b", LONG + "a", LONG + "c" * 500, "", "short", "é" * 70, "é" * 70 + "z", None]
    rows = [{"a": rng.choice(texts), "b": rng.choice(texts), "n": rng.randrange(9), "x": rng.choice([0.5, 2.0, 10.0, None])} for _ in range(300)]
    rows += [{"a": LONG + f"{i:03}", "b": None, "n": 2, "x": None} for i in range(40)]
    df = spark.createDataFrame(rows, "a string, b string, n int, x double").repartition(4)
    for k in (1, 3, 20):
        assert found(df, ["a", "b", "n", "x"], k) == plain(rows, k)


def test_many_ties_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(counting, "BROADCAST_ROWS", 5)
    rows = [{"a": LONG + f"{i:03}"} for i in range(60)]
    df = spark.createDataFrame(rows, "a string").repartition(3)
    assert found(df, ["a"], 4) == plain(rows, 4)


def test_no_long_text_in_an_exchange(spark):
    df = spark.createDataFrame([(LONG * 20, 1)], "body string, n int")
    text = plan_of(value_counts(df, ["body", "n"]))
    carried = [line for part in re.findall(r"\) Exchange\nInput.*", text) for line in [part]]
    assert carried and all("body" not in line for line in carried)
    assert "substring(" in text and "md5(" in text


def test_reports_and_fills_show_whole_texts(spark):
    whole = "y" * 300
    df = spark.createDataFrame([(whole,), (whole,), ("z",), (None,)], "t string")
    assert [(r["value"], r["n"], r["n_distinct"]) for r in categorical_insights(df, ["t"]).orderBy("rank").collect()] == [(whole, 2, 2), ("z", 1, 2)]
    assert FillNa(method="mode", columns=["t"])(df).where(F.col("t") == whole).count() == 3
