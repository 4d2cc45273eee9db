"""WARC archives with a two-level capture index."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, stable

# An empty gzip member: what Spark's text writer puts between records, so that each file is one valid .warc.gz.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
RECORDS_PER_FILE = 2_000
LINES_PER_BLOCK = 3_000
LEVEL = 5
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # the tables hold no capture time
ENTRY = "key string, page_id long, file string, offset long, length long"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def with_kinds(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, url, body, n_bytes, digest, refers_to): ``refers_to`` is the response of a revisit, else null.

    Of equal payloads of at least ``least_bytes`` the smallest page_id is the response. Rows without a
    page_id refer to it as well; where all lack one, they are responses. Repeated rows of the
    response's page_id are responses too. Only digests that occur more than once are joined: Spark
    sends them to the pages where they are few, and splits a digest that a third of the pages share.
    """
    body = pages.select("page_id", "url", payload(F.col("html")).alias("body"))
    rows = body.withColumn("n_bytes", F.octet_length("body")).withColumn("digest", F.sha2("body", 256))
    shared = stable(rows.where(F.col("n_bytes") >= least_bytes).groupBy(F.unhex("digest").alias("raw")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("raw", "first_id"))
    met = rows.withColumn("raw", F.unhex("digest")).join(shared, "raw", "left")
    return met.select("page_id", "url", "body", "n_bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, body: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100) -> None:
    """Writes one gzip member per row of ``pages(page_id, url, html)`` below ``folder``, at most 2,000 to a file.

    Null html is an empty payload, a null URL has no target header. A failed task's file is written again whole.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            absent = b["page_id"].isna(), b["refers_to"].isna()
            rows = zip(b["page_id"], b["url"], b["body"], b["n_bytes"], b["digest"], b["refers_to"], *absent)
            yield pd.DataFrame({"member": [_gzip(_record(None if no_id else int(i), u, p, n, d, None if no_ref else int(r))) for i, u, p, n, d, r, no_id, no_ref in rows]})

    members = with_kinds(pages, least_bytes).mapInPandas(pack, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _parse(record: bytes) -> tuple:
    """(page_id, url, kind, n_bytes, digest, refers_to, payload); the payload of a response is checked against its digest."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[:int(fields[b"Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    n_bytes = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(body) != n_bytes or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields[b'WARC-Record-ID']!r}")
    own, other = _ID.search(fields[b"WARC-Record-ID"]), _ID.search(fields.get(b"WARC-Refers-To", b""))
    url = fields.get(b"WARC-Target-URI")
    if url is not None:
        url = url.decode().replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return int(own[1]) if own else None, url, kind, n_bytes, digest, int(other[1]) if other else None, body if kind == "response" else None


def url_key(url: str | None) -> str:
    """Sort key of a capture: the host reversed by labels, then port, path and query; the scheme and a fragment do not count."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/")


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """(key, page_id, file, offset, length) of every record, found by reading the archives from end to end."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                at, rows = 0, []
                while at < len(content):
                    # a member's end is known only by unpacking it; windows keep what follows it from being copied
                    reader, end, out = zlib.decompressobj(31), at, []
                    while not reader.eof and end < len(content):
                        part = content[end:end + 65_536]
                        out.append(reader.decompress(part))
                        end += len(part) - len(reader.unused_data)
                    record = b"".join(out)
                    if record:
                        page_id, url = _parse(record)[:2]
                        rows.append((url_key(url), page_id, file, at, end - at))
                    at = end
                yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    return _archives(spark, folder).mapInPandas(scan, ENTRY)


def write_index(found: DataFrame, folder: str) -> None:
    """Sorts captures by key into compressed blocks of 3,000 lines below ``folder``/blocks and lists their
    first and last keys in ``folder``/directory. A URL that very many captures share fills several
    blocks: ranges are cut by key, page and place."""
    order = ["key", "page_id", "file", "offset"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block(lines: list[tuple]) -> dict:
            text = "\n".join("\t".join(("" if x is None or x is pd.NA else str(x)).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for x in line) for line in lines)
            return {"first_key": lines[0][0], "last_key": lines[-1][0], "lines": len(lines), "data": zlib.compress(text.encode(), 6)}

        for batch in batches:
            held += batch.astype({"page_id": "Int64"}).itertuples(index=False, name=None)
            full = [block(held[i:i + LINES_PER_BLOCK]) for i in range(0, len(held) - LINES_PER_BLOCK + 1, LINES_PER_BLOCK)]
            held = held[len(full) * LINES_PER_BLOCK:]
            if full:
                yield pd.DataFrame(full)
        if held:
            yield pd.DataFrame([block(held)])

    sorted_rows = found.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length")
    blocks = sorted_rows.mapInPandas(pack, "first_key string, last_key string, lines long, data binary")
    blocks.withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    found.sparkSession.read.parquet(f"{folder}/blocks").select("block", "first_key", "last_key", "lines").write.parquet(f"{folder}/directory")


_ESCAPES = {"\\\\": "\\", "\\t": "\t", "\\n": "\n"}


def _lines(data: bytes) -> list[tuple]:
    rows = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, page, file, offset, length = line.split("\t")
        if "\\" in key:
            key = re.sub(r"\\[\\tn]", lambda m: _ESCAPES[m[0]], key)
        rows.append((key, int(page) if page else None, file, int(offset), int(length)))
    return rows


def entries(spark: SparkSession, index: str) -> DataFrame:
    """Every capture of an index."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                yield pd.DataFrame(_lines(data), columns=["key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    return spark.read.parquet(f"{index}/blocks").select("data").mapInPandas(unpack, ENTRY)


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_captures(spark: SparkSession, folder: str, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at ``wanted(file, offset, length)``: archives are read once, only those ranges are unpacked.

    The ranges of one archive are at most 2,000, so the list that meets a file is bounded.
    """
    ranges = wanted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, places in zip(batch["content"], batch["ranges"]):
                rows = [_parse(zlib.decompress(content[p["offset"]:p["offset"] + p["length"]], 31)) for p in places]
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})
                yield out if with_payload else out.assign(payload=None)

    return _archives(spark, folder).join(ranges, "file").select("content", "ranges").mapInPandas(read, RECORD)


def lookup(spark: SparkSession, archives: str, index: str, urls: list[str]) -> list[dict]:
    """The captures of a few URLs, through both levels of the index and range reads.

    The sparse directory (one line in 3,000) is searched by bisection, only the blocks that may hold a
    key are read and searched again, and each record is read from its archive by offset through
    Hadoop's file system, wherever the archives are.
    """
    listed = sorted((r["first_key"], r["last_key"], r["block"]) for r in spark.read.parquet(f"{index}/directory").toLocalIterator())
    firsts, lasts = [r[0] for r in listed], [r[1] for r in listed]
    keys = sorted({url_key(u) for u in urls})
    near = {listed[i][2] for k in keys for i in range(bisect_left(lasts, k), bisect_right(firsts, k))}
    places = []
    for row in spark.read.parquet(f"{index}/blocks").where(F.col("block").isin(*near)).toLocalIterator() if near else ():
        lines = _lines(row["data"])
        names = [x[0] for x in lines]
        places += [x for k in keys for x in lines[bisect_left(names, k):bisect_right(names, k)]]
    jvm, found = spark._jvm, []
    for key, _, file, offset, length in sorted(places, key=lambda p: (p[0], p[1] is None, p[1] or 0, p[2], p[3])):
        path = jvm.org.apache.hadoop.fs.Path(f"{archives}/{file}")
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        stream.seek(offset)
        record = _parse(zlib.decompress(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length))), 31))
        stream.close()
        found.append({"key": key} | dict(zip(("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"), record)))
    return found


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Archives ``pages``, indexes the archives and reads every record back through the index."""
    spark = pages.sparkSession
    at = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, f"{at}/archives")
    write_index(stable(captures(spark, f"{at}/archives")), f"{at}/index")
    return read_captures(spark, f"{at}/archives", entries(spark, f"{at}/index"), with_payload)
