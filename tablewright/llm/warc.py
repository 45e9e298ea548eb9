"""WARC archives with a two-level capture index.

Writing: every capture becomes a record in its own gzip member. Of the captures with equal
payloads the one with the largest page_id is stored as ``response``, each other one as a
``revisit`` that names it and has headers only. Tasks write whole files under names of their
own into the shared folder; a file counts only if the rows that describe it were committed,
so what a lost or repeated task leaves behind is never read.

Index: the captures, sorted by URL key with the host reversed (``com,example,www)/path``), are
cut into compressed blocks of ``BLOCK_LINES`` lines. Each range of the order has a block file
and a sparse directory with the first key and place of each block; above them stands one row per range.
A lookup finds the ranges of a key by binary search in those rows, the block by binary search
in the directory, reads that byte range, searches the block, and reads the records' byte ranges.

Defined cases: a null payload is empty, and empty payloads are equal; a null page_id is smaller
than any other and read back as null; with equal page_ids the larger URL is the response, of rows
equal in all of this one; repeated rows give one record each; a null URL has the key ``''``
and reads back as null, one without a host is its own key; line ends inside a URL are percent-encoded in the
record's header; long payloads are stored whole, one at a time; an empty table gives an empty index and no rows;
other columns are ignored. Files are opened by ``pyarrow.fs``, so the folder may be any that it can reach.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.common import arrow_schema, slices
from tablewright.llm.registry import query, table
from tablewright.session import cut_lineage, scratch_path

BLOCK_LINES = 1_000
ARCHIVE_BYTES = 1 << 30
# Neighbouring records are read at once while the gap and the whole stay below these.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
# A group of copies with more than one in HOT of all captures is joined by broadcast: under HOT rows.
HOT = 1_000
COPIES_AT_ONCE = 10_000
DATE = "2000-01-01T00:00:00Z"

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?"
ENTRY = "surt string, page_id long, kind string, file string, offset long, length long"
RECORD = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
          "refers_to long, record_id string")


def surt(url: Column) -> Column:
    """The sort key of a URL: host parts reversed, then port, path and query; other URLs as they are."""
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.")), ",")
    rest = F.regexp_replace(url, _HOST, "")
    keyed = F.concat(host, F.regexp_extract(url, _HOST, 2), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(url.rlike(_HOST), keyed).otherwise(url), F.lit(""))


# -- files ---------------------------------------------------------------------------------


class Folder:
    """Files below one path of any file system that pyarrow can reach."""

    def __init__(self, path: str):
        self.fs, self.base = fs.FileSystem.from_uri(path)
        self.open_name, self.open_file = None, None

    def create(self, name: str):
        self.fs.create_dir(f"{self.base}/{name}".rpartition("/")[0], recursive=True)
        return self.fs.open_output_stream(f"{self.base}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        """A byte range; the file stays open for the next one."""
        if name != self.open_name:
            self.close()
            self.open_name, self.open_file = name, self.fs.open_input_file(f"{self.base}/{name}")
        return self.open_file.read_at(length, offset)

    def read_all(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.base}/{name}", compression=None) as f:
            return f.read()

    def close(self) -> None:
        if self.open_file is not None:
            self.open_file.close()
        self.open_name = self.open_file = None


def own_name(folder: str, end: str) -> str:
    """A file name that no other attempt of this task uses."""
    return f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{end}"


# -- records -------------------------------------------------------------------------------


def record_id(page_id: int | None, url: str | None, body: bytes, copy: int) -> str:
    named = json.dumps([page_id, url, copy]).encode() + body
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(named).digest())}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def make_record(fields: dict, payload: bytes | None, n_bytes: int) -> bytes:
    """One record as a gzip member. ``payload`` None: the HTTP head only, which keeps the full length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = [f"{k}: {header_value(v)}" for k, v in fields.items() if v is not None]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    start = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return packer.compress(start) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The columns of ``RECORD`` from one gzip member; a payload that its digest denies raises."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        length, found = len(payload), base32_sha1(payload)
        if found != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged: its payload has SHA-1 {found}, not {digest}")
    number = {k: int(fields[k]) if k in fields else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")}
    return {
        "page_id": number["WARC-Page-ID"], "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload": payload if kind == "response" else None, "payload_bytes": length, "payload_digest": digest,
        "refers_to": number["WARC-Refers-To-Page-ID"], "record_id": fields["WARC-Record-ID"],
    }


# -- writing -------------------------------------------------------------------------------


def _captures(pages: DataFrame, payload: str) -> DataFrame:
    whole = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole.alias("payload"), F.unhex(F.sha2(whole, 256)).alias("body"))


def plan_records(pages: DataFrame, payload: str = "html") -> DataFrame:
    """One row per record to write: whose it is, what it refers to, and the payload of responses.

    A payload travels once per task and group of copies. Revisits are planned from small rows;
    groups that hold a large share of them are joined by broadcast (fewer than ``HOT`` such groups can exist).
    """
    captures = _captures(pages, payload)
    who = F.struct("page_id", "url")
    responses = captures.groupBy("body").agg(F.first("payload").alias("payload"), F.max(who).alias("w")).select(
        F.col("w.page_id").alias("page_id"), F.col("w.url").alias("url"), "payload", "body", F.lit(0).cast("long").alias("copy"),
        F.lit(None).cast("binary").alias("sha1"), F.lit(None).cast("long").alias("n_bytes"),
        F.lit(None).cast("struct<page_id:bigint,url:string>").alias("refers"))
    rows = cut_lineage(
        captures.select("page_id", "url", "body", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
        .groupBy("body", "page_id", "url", "sha1", "n_bytes").agg(F.count("*").alias("n")))
    copied = cut_lineage(rows.groupBy("body").agg(F.max(who).alias("refers"), F.sum("n").alias("n_group")).where("n_group > 1"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(copied.where(F.col("n_group") * HOT > total).select("body", F.col("refers").alias("hot")))
    marked = rows.join(hot, "body", "left")
    usual = marked.where("hot IS NULL").drop("hot").join(copied.where(F.col("n_group") * HOT <= total).select("body", "refers"), "body")
    members = marked.where("hot IS NOT NULL").withColumnRenamed("hot", "refers").unionByName(usual)
    first = (F.col("page_id").eqNullSafe(F.col("refers.page_id")) & F.col("url").eqNullSafe(F.col("refers.url"))).cast("long")
    some = members.withColumn("n", F.col("n") - first).where("n > 0")
    starts = some.withColumn("start", F.explode(F.expr(f"sequence(1L, n, {COPIES_AT_ONCE}L)")))
    revisits = starts.withColumn("copy", F.explode(F.expr(f"sequence(start, least(n, start + {COPIES_AT_ONCE - 1}L))"))).select(
        "page_id", "url", F.lit(None).cast("binary").alias("payload"), "body", "copy", "sha1", "n_bytes", "refers")
    return responses.unionByName(revisits).withColumn("surt", surt(F.col("url")))


def write_archives(pages: DataFrame, path: str, payload: str = "html", date: str = DATE) -> None:
    """Write a record per row of ``pages`` (page_id, url, ``payload``) below ``path``."""
    planned = plan_records(pages, payload)
    schema = pages.sparkSession.createDataFrame([], ENTRY).schema

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, folder, out, name, at = arrow_schema(schema), Folder(path), None, None, 0
        for batch in batches:
            lines = []
            columns = [batch[c] for c in ("page_id", "url", "payload", "body", "copy", "sha1", "n_bytes", "refers", "surt")]
            for row in zip(*columns):  # one value at a time: a batch may hold long payloads
                page_id, url, whole, body, copy, sha1, n_bytes, refers, key = (v.as_py() for v in row)
                fields = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": record_id(page_id, url, body, copy),
                          "WARC-Date": date, "WARC-Target-URI": url, "WARC-Page-ID": None if page_id is None else str(page_id)}
                if refers is None:
                    n_bytes, fields["WARC-Payload-Digest"] = len(whole), f"sha1:{base32_sha1(whole)}"
                else:
                    fields["WARC-Payload-Digest"] = f"sha1:{base64.b32encode(sha1).decode()}"
                    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    fields["WARC-Refers-To"] = record_id(refers["page_id"], refers["url"], body, 0)
                    fields["WARC-Refers-To-Target-URI"] = refers["url"]
                    fields["WARC-Refers-To-Page-ID"] = None if refers["page_id"] is None else str(refers["page_id"])
                fields["Content-Type"] = "application/http; msgtype=response"
                if out is None:
                    name, at = own_name("archives", ".warc.gz"), 0
                    out = folder.create(name)
                member = make_record(fields, whole, n_bytes)
                out.write(member)
                lines.append((key, page_id, fields["WARC-Type"], name, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), arrow)], schema=arrow)
        if out is not None:
            out.close()

    planned.mapInArrow(store, schema).write.parquet(f"{path}/entries")


def write_index(spark: SparkSession, path: str, block_lines: int = BLOCK_LINES) -> None:
    """Sort the captures of the archives below ``path`` into blocks and directories."""
    entries = spark.read.parquet(f"{path}/entries")
    order = ["surt", "page_id", "file", "offset"]  # a URL with very many captures spans several ranges
    ordered = entries.repartitionByRange(slices(entries), *order).sortWithinPartitions(*order)
    schema = spark.createDataFrame([], "first string, last string, blocks string, directory string, lines long").schema

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, folder, pending, places, at, lines = arrow_schema(schema), Folder(path), [], [], 0, 0
        name, out, last = own_name("index", ".blocks"), None, None

        def flush():
            nonlocal out, at, pending
            out = out or folder.create(name)
            block = zlib.compress("\n".join(map(json.dumps, pending)).encode())
            places.append([pending[0][0], at, len(block)])
            out.write(block)
            at, pending = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(row)
                last, lines = row[0], lines + 1
                if len(pending) >= block_lines:
                    flush()
        if pending:
            flush()
        if out is not None:
            out.close()
            directory = name.replace(".blocks", ".directory")
            with folder.create(directory) as f:
                f.write(zlib.compress(json.dumps(places).encode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip([places[0][0], last, name, directory, lines], arrow)], schema=arrow)

    ordered.mapInArrow(store, schema).write.parquet(f"{path}/ranges")


# -- reading -------------------------------------------------------------------------------


def search_range(folder: Folder, blocks: str, directory: str, keys: Iterable[str]) -> Iterator[list]:
    """The captures of ascending ``keys`` in one range of the index, each block read at most once in a row."""
    places = json.loads(zlib.decompress(folder.read_all(directory)))
    firsts = [p[0] for p in places]
    held, rows, names = None, [], []
    for key in keys:
        # Captures of the key may begin in the block before the first that starts with it.
        for i in range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key)):
            if i != held:
                block = zlib.decompress(folder.read(blocks, *places[i][1:])).decode()
                held, rows = i, json.loads(f"[{block.replace(chr(10), ',')}]")
                names = [r[0] for r in rows]
            yield from rows[bisect_left(names, key): bisect_right(names, key)]


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The captures (columns of ``ENTRY``) of the URL keys in column ``surt`` of ``keys``; repeated keys count once.

    The rows above the directories, one per range (as many as tasks wrote the index), go to every task.
    """
    top = sorted((r["first"], r["last"], r["blocks"], r["directory"]) for r in spark.read.parquet(f"{path}/ranges").collect())
    firsts, lasts = [t[0] for t in top], [t[1] for t in top]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for key in batch["surt"].to_pylist():
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    at.append(i)
                    found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found, pa.string())], names=["at", "surt"])

    schema = spark.createDataFrame([], ENTRY).schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, arrow = Folder(path), arrow_schema(schema)
        for batch in batches:
            at, names = batch["at"].to_pylist(), batch["surt"].to_pylist()
            begin = 0
            while begin < len(at):
                end = bisect_right(at, at[begin], begin)
                rows = []
                for row in search_range(folder, *top[at[begin]][2:], names[begin:end]):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                begin = end
        folder.close()

    placed = keys.where("surt IS NOT NULL").select("surt").distinct().mapInArrow(place, "at int, surt string")
    return placed.repartition(slices(keys), "at").sortWithinPartitions("at", "surt").mapInArrow(search, schema)


def fetch(captures: DataFrame, path: str) -> DataFrame:
    """The records (columns of ``RECORD``) at the places (file, offset, length) of ``captures``."""
    schema = captures.sparkSession.createDataFrame([], RECORD).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, arrow = Folder(path), arrow_schema(schema)
        for batch in batches:
            wanted = sorted(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length"))))
            begin = 0
            while begin < len(wanted):
                name, start, length = wanted[begin]
                end, stop = begin + 1, start + length
                while (end < len(wanted) and wanted[end][0] == name and wanted[end][1] <= stop + GAP_BYTES
                       and sum(wanted[end][1:]) - start <= READ_BYTES):
                    stop, end = max(stop, sum(wanted[end][1:])), end + 1
                data = folder.read(name, start, stop - start)
                rows = [parse_record(data[o - start: o - start + n]) for _, o, n in wanted[begin:end]]
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)
                begin = end
        folder.close()

    return captures.select("file", "offset", "length").mapInArrow(read, schema)


@query("op12_capture_index")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    write_index(spark, path)
    found = lookup(spark, path, pages.select(surt(F.col("url")).alias("surt")))
    return fetch(found, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
