"""Archives and capture index against plain counts and the pages themselves."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tablewright.llm import warc
from tablewright.llm.registry import QUERIES, table
from tablewright.session import scratch_path

SCHEMA = "page_id long, url string, html string, body string, copy string, refers string, surt string"
LONG = "".join(random.Random(1).choice("<p>abc é\r\n") for _ in range(300_000))


def odd_pages(spark):
    rows = [
        (1, "https://www.Example.com/a?b=c", "<p>one</p>"), (2, "http://example.com", "<p>one</p>"),
        (2, "http://example.com", "<p>one</p>"), (2, "http://example.org:8080/x", "<p>one</p>"),
        (3, None, None), (4, "not a url", ""), (None, "http://a.b/", ""), (None, "http://a.b/", ""),
        (None, None, "lonely"), (None, None, "lonely"), (5, "http://u:p@h.example/\r\nX: y", "head\r\n\r\nbody\r\n\r\n"),
        (6, "http://a.b/", LONG), (-7, "http://a.b/", LONG), (8, "http://a.b/é", "ünï 中 😀"),
    ]
    return rows, spark.createDataFrame([(*r, "b", "c", "r", "s") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    groups = defaultdict(list)
    for page_id, url, html in rows:
        groups[html or ""].append((page_id, url))
    out = Counter()
    for html, members in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        largest = max(members, key=lambda m: (m[0] is not None, m[0] or 0))[0]
        for k, (page_id, _) in enumerate(sorted(members, key=lambda m: (m[0] is not None, m[0] or 0), reverse=True)):
            out[page_id, len(data), digest, *(("response", None) if k == 0 else ("revisit", largest))] += 1
    return out


def digests(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def stored(spark, pages, **index):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path)
    warc.write_index(spark, path, **index)
    return path


def every_record(spark, path, pages):
    return warc.fetch(warc.lookup(spark, path, pages.select(warc.surt(F.col("url")).alias("surt"))), path)


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_odd_pages_come_back(spark, lines):
    rows, pages = odd_pages(spark)
    path = stored(spark, pages, block_lines=lines)
    back = every_record(spark, path, pages).collect()
    assert digests(every_record(spark, path, pages)) == expected(rows)
    payloads = {r["payload"].decode() for r in back if r["record_type"] == "response"}
    assert payloads == {html or "" for _, _, html in rows}
    assert len({r["record_id"] for r in back}) == len(rows)
    assert Counter(r["url"] for r in back) == Counter(u and u.replace("\r", "%0D").replace("\n", "%0A") for _, u, _ in rows)


def test_archives_are_plain_gzip_with_whole_records(spark):
    rows, pages = odd_pages(spark)
    path = stored(spark, pages)
    system, base = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(f"{base}/archives"))
    whole = b"".join(gzip.decompress(system.open_input_stream(f.path, compression=None).read()) for f in found)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)
    assert whole.count(b"WARC-Type: revisit") == len(rows) - len({h or "" for _, _, h in rows})


def test_hot_groups_take_the_other_join(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.example/{i}", "same" if i % 3 else f"own {i // 6}") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for bound in (1, 2, 1000):
        monkeypatch.setattr(warc, "HOT", bound)
        assert digests(every_record(spark, stored(spark, pages), pages)) == expected(rows)


def test_many_equal_rows_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES_AT_ONCE", 4)
    rows = [(1, "http://a.b/", "x")] * 11 + [(0, "http://a.b/", "x")] * 9
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert digests(every_record(spark, stored(spark, pages, block_lines=2), pages)) == expected(rows)


def test_lookup_returns_only_the_captures_of_a_key(spark):
    rows, pages = odd_pages(spark)
    path = stored(spark, pages, block_lines=2)
    keys = spark.createDataFrame([("b,a)/",), ("b,a)/",), ("com,example)/",), ("zz,none)/",), (None,)], "surt string")
    found = warc.lookup(spark, path, keys).collect()
    assert Counter(r["surt"] for r in found) == {"b,a)/": 4, "com,example)/": 2}


def test_keys(spark):
    cases = {
        "https://www.Example.com/a?b=c": "com,example,www)/a?b=c", "http://example.com": "com,example)/",
        "http://example.org:8080/x": "org,example:8080)/x", "http://u:p@h.example/y": "example,h)/y",
        "http://a.b?q": "b,a)?q", "plain": "plain", None: "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r["url"]: r["k"] for r in df.select("url", warc.surt(F.col("url")).alias("k")).collect()} == cases


def test_damaged_payloads_raise():
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:AAAA"}
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(warc.make_record(fields, b"abc", 3))


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert every_record(spark, stored(spark, pages), pages).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert digests(QUERIES["op12_capture_index"](spark, sf)) == expected(rows)
