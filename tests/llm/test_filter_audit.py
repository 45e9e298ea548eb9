"""The filter audit against a count over single documents."""

import math
import re
from collections import Counter
from itertools import permutations

from compare import connect, difference, oracle_rows, spark_rows
from odd_tables import ROWS

from tablewright.llm import filter_audit
from tablewright.llm.registry import ORACLES, QUERIES


def failures(rows):
    """(part, set of letters failed, good, toxic) per row, by the plain rules."""
    ids = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            ids[text or ""] = min(ids.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, lang, *_ in rows:
        text, failed = text or "", set()
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed |= {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        failed |= {"E"} if doc_id is not None and doc_id > ids[text] else set()
        out.append((doc_id, lang or "", failed))
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marked, out = failures(rows), Counter()
    for part in {p for _, p, _ in marked}:
        own, shapley, steps = [m for m in marked if m[1] == part], Counter(), []
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                fails = [m for m in own if letter in m[2]]
                new = [m for m in fails if not m[2] & set(order[:k])]
                shapley[letter] += len(new)
                steps.append((letter, (
                    part, "".join(order), k + 1, sum(not m[2] & set(order[:k + 1]) for m in own), len(new),
                    len(fails) - len(new), sum(m[2] == {letter} for m in own),
                    sum(m[0] in good for m in new), sum(m[0] in toxic for m in new))))
        out.update((*row, shapley[letter]) for letter, row in steps)
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_odd_documents_equal_a_plain_count(spark, odd, none):
    rows = ROWS + [(10, "A $ " * 300, "en", "a"), (11, "A $ " * 300, "de", "b"), (11, "A $ " * 300, "de", "b"), (None, "A $ " * 300, "de", "b")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, mask string, n string")
    labels = [(1, 1, 0), (1, 0, 1), (10, 1, 1), (11, None, 1), (None, 1, 1), (6, 1, None)]
    table = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, good string")
    assert rows_of(filter_audit.audit_filters(docs.repartition(3), table)) == brute(rows, labels)
    assert rows_of(filter_audit.audit_filters(odd, table)) == brute(ROWS, labels)
    assert filter_audit.audit_filters(none, table).count() == 0
    assert rows_of(filter_audit.audit_filters(docs, table.limit(0))) == brute(rows, [])


def test_first_step_and_shapley_add_up(spark):
    cells = spark.createDataFrame([("p", m, m + 1, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    rows = filter_audit.audit(cells, "ABC").collect()
    assert len(rows) == 6 * 3
    last = {r["filter_order"]: r["kept"] for r in rows if r["step"] == 3}
    assert set(last.values()) == {1}
    own = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows}
    assert sum(own.values()) == math.factorial(3) * sum(m + 1 for m in range(1, 8))


def test_many_parts_pass_the_usual_row_limit(spark):
    before = spark.conf.get(filter_audit.ROW_LIMIT, None)
    spark.conf.set(filter_audit.ROW_LIMIT, "1000")
    try:
        cells = spark.createDataFrame([(f"p{i}", 0, 1, 0, 0) for i in range(10)], "part string, mask int, n long, good long, toxic long")
        assert filter_audit.audit(cells, "ABCDE").count() == 10 * 600
        assert spark.conf.get(filter_audit.ROW_LIMIT) == "1000"
    finally:
        spark.conf.set(filter_audit.ROW_LIMIT, before) if before else spark.conf.unset(filter_audit.ROW_LIMIT)


def test_query_equals_sql(spark, sf):
    got = spark_rows(QUERIES["op13_filter_audit"](spark, sf))
    assert difference(got, oracle_rows(connect(sf), ORACLES["op13_filter_audit"])) is None
