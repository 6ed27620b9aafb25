"""WARC archives of pages, and a two-level index of their captures.

Archives are plain WARC 1.1 of ARCHIVE_BYTES or one larger record. The index sorts captures by URL key, host reversed,
and packs BLOCK of them in a compressed block; blocks are numbered in the order of their keys within a shard, and a
sparse directory holds each block's address (shard and number) with its first and last key. A look-up searches the
directory, then the block that it names, both by halving, then reads the record's range of its archive: lookup() for
one URL, lookup_all() for a table of them. Everything is written and read by Spark or Hadoop file systems, so archives
can lie wherever Spark reads.

Of records with equal payloads of at least REVISIT bytes, those of the smallest page id are responses and the others
revisits of it; a null id is never the smallest. Null and empty pages have empty payloads. Repeated rows are captures
of their own. A null URL has an empty key; one that can't be parsed is its own key. A very long page is one record, held
by one task at a time. Captures of one key that tie stand by page id, file and offset. Columns other than the three
named are not read. Empty tables make an empty store.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.lines import _join
from foliospark.sources.runtime import plan_bytes, scratch_path, ship, table

ARCHIVE_BYTES, BLOCK, REVISIT = 16 << 20, 256, 100
#: Bytes of a directory's files up to which it is sent to all tasks; look-ups in larger ones join keys instead.
DIRECTORY_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "shard int, number int, first_key string, last_key string, n int"
BLOCKS = "shard int, number int, first_key string, last_key string, n int, block binary"


@dataclass
class Store:
    """Paths of archives, index blocks and directory."""

    archives: str
    blocks: str
    directory: str


def url_key(url: str | None) -> str:
    """Host reversed, then the rest: org,example,www)/path?query. Scheme, user, default port and fragment don't count."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return url
    if not host:
        return url
    name = ",".join(reversed(host.split(".")))
    return name + (f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record without its last line feed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and where it ends."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    end = stop + 4 + int(head["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    return head, data[stop + 4 : end], end + 4


def _page(urn: str | None) -> int | None:
    n = (urn or "<urn:page:>")[10:-1]
    return int(n) if n else None


def write(pages: DataFrame, root: str) -> Store:
    """Archives of pages (page_id, url, html), and their index, under root."""
    spark = pages.sparkSession
    ship(spark)
    store = Store(f"{root}/archives", f"{root}/blocks", f"{root}/directory")
    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "coalesce(cast(html as string), '') as html").withColumn("digest", F.sha2("html", 256))
    again = rows.where(F.octet_length("html") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    again = table(again, "warc-repeated")
    rows = _join(rows, again, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            names, values = [], []
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = record(page_id, url, html.encode(), digest, refers)
                if size and size + len(r) > ARCHIVE_BYTES:
                    n, size = n + 1, 0
                size += len(r) + 1
                names.append(f"{part:06d}-{n:06d}")
                values.append(r.decode())
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(names, pa.string())], names=["value", "archive"])

    # the writer's line feed ends each record
    rows.mapInArrow(archive, "value string, archive string").write.partitionBy("archive").text(store.archives, lineSep="\n")

    captures = _captures(spark, store).repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard, number = TaskContext.get().partitionId(), 0

        def block(part: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            text = "\n".join(json.dumps(x) for x in part).encode()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([part[0][0]]), pa.array([part[-1][0]]), pa.array([len(part)], pa.int32()), pa.array([zlib.compress(text)], pa.binary())], names=["shard", "number", "first_key", "last_key", "n", "block"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    captures.mapInArrow(pack, BLOCKS).write.partitionBy("shard").parquet(store.blocks)
    blocks = spark.read.schema(BLOCKS).parquet(store.blocks)
    blocks.select("shard", "number", "first_key", "last_key", "n").repartitionByRange("first_key", "last_key", "shard", "number").sortWithinPartitions("first_key", "last_key", "shard", "number").write.parquet(store.directory)
    return store


def _files(spark: SparkSession, store: Store) -> DataFrame:
    """path and content of the archives; paths below the store, as schemes and prefixes differ from reader to reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(store.archives).select(F.regexp_extract("path", "(archive=[^/]*/[^/]*)$", 1).alias("file"), "content")


def _captures(spark: SparkSession, store: Store) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column(0), b.column(1), strict=True):
                name, data, at, rows = file.as_py(), data.as_py(), 0, []
                while at < len(data):
                    head, _, end = parse(data, at)
                    rows.append((url_key(head.get("WARC-Target-URI")), _page(head["WARC-Record-ID"]), name, at, end - at))
                    at = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])

    return _files(spark, store).mapInArrow(read, ENTRY)


def entries(spark: SparkSession, store: Store) -> DataFrame:
    """All captures, from the blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                rows = [json.loads(x) for x in zlib.decompress(block).split(b"\n")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])

    return spark.read.schema(BLOCKS).parquet(store.blocks).select("block").mapInArrow(unpack, ENTRY)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of all
    captures, by their ranges. A response's bytes and digest come from its payload."""
    ship(spark)
    return _ranges(spark, store, entries(spark, store).select("file", "offset", "length"))


def lookup_all(spark: SparkSession, store: Store, urls: DataFrame) -> DataFrame:
    """What read() gives, of the captures of a table's URLs (url), each once, however often a URL stands there."""
    ship(spark)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(url_key, b.column(0).to_pylist()), pa.string())], names=["key"])

    keys = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(keyed, "key string").distinct()
    directory = spark.read.schema(DIRECTORY).parquet(store.directory)
    if plan_bytes(directory) > DIRECTORY_BYTES:
        return _ranges(spark, store, entries(spark, store).join(keys, "key", "left_semi").select("file", "offset", "length"))
    rows = sorted(tuple(r) for r in directory.select("first_key", "last_key", "shard", "number").collect())
    firsts, lasts = [r[0] for r in rows], [r[1] for r in rows]
    sent = spark.sparkContext.broadcast((firsts, lasts, [r[2:] for r in rows]))

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, places = sent.value
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                # blocks follow each other, so those that can hold a key are neighbours
                at = bisect_left(lasts, k)
                while at < len(firsts) and firsts[at] <= k:
                    out.append((*places[at], k))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.string()), strict=True)], names=["shard", "number", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for wanted, data in zip(b.column(0), b.column(1), strict=True):
                rows = [json.loads(x) for x in zlib.decompress(data.as_py()).split(b"\n")]
                found = []
                for k in wanted.as_py():
                    at = bisect_left(rows, k, key=lambda x: x[0])
                    while at < len(rows) and rows[at][0] == k:
                        found.append(rows[at][2:])
                        at += 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    # a block's keys are BLOCK at most
    asked = keys.mapInArrow(address, "shard int, number int, key string").groupBy("shard", "number").agg(F.collect_list("key").alias("keys"))
    blocks = spark.read.schema(BLOCKS).parquet(store.blocks).select("shard", "number", "block")
    found = blocks.join(asked, ["shard", "number"]).select("keys", "block").mapInArrow(search, "file string, offset long, length long")
    return _ranges(spark, store, found)


def _ranges(spark: SparkSession, store: Store, ranges: DataFrame) -> DataFrame:
    """Captures at ranges (file, offset, length) of the archives; a file's are as many as its ARCHIVE_BYTES hold."""
    ranges = table(ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges")), "warc-ranges")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, spans in zip(b.column(0), b.column(1), strict=True):
                data, rows, size = content.as_buffer(), [], 0
                for s in spans.as_py():
                    rows.append(capture(data.slice(s["offset"], s["length"]).to_pybytes()))
                    size += s["length"]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return _join(_files(spark, store), ranges, "file", "inner").select("content", "ranges").mapInArrow(cut, schema)


def capture(data: bytes) -> tuple:
    """A record's fields, in the order of read()."""
    head, block, _ = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    if head["WARC-Type"] == "revisit":
        length = int(http.decode().rpartition("Content-Length: ")[2])
        return _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), "revisit", _page(head["WARC-Refers-To"]), length, head["WARC-Payload-Digest"].removeprefix("sha256:"), None
    return _page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), "response", None, len(payload), sha256(payload).hexdigest(), payload


def lookup(spark: SparkSession, store: Store, url: str) -> list[dict]:
    """Captures of a URL: the addresses of the blocks that can hold its key, a search by halving in each, a range read
    each. The directory is sorted, so Parquet's own statistics leave out what can't hold the key."""
    key = url_key(url)
    directory = spark.read.schema(DIRECTORY).parquet(store.directory)
    out = []
    for place in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("shard", "number").collect():
        block = spark.read.schema(BLOCKS).parquet(store.blocks).where((F.col("shard") == place["shard"]) & (F.col("number") == place["number"])).select("block")
        rows = [json.loads(x) for x in zlib.decompress(block.first()["block"]).split(b"\n")]
        at = bisect_left(rows, key, key=lambda x: x[0])
        while at < len(rows) and rows[at][0] == key:
            _, _, file, offset, length = rows[at]
            fields = capture(_range(spark, f"{store.archives}/{file}", offset, length))
            out.append(dict(zip(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"), fields, strict=True)))
            at += 1
    return out


def _range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(offset)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    store = write(pages, scratch_path(spark, "warc"))
    # every page is asked for by its URL
    return lookup_all(spark, store, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
