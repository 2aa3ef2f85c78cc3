"""WARC archives with revisit resolution.

Only headers are shuffled: (payload digest, page_id) is aggregated to the smallest page_id of each digest that occurs
more than once. Up to MOST_BROADCAST such digests are broadcast and no payload moves. More are laid in a bitmap of at most
2**MOST_BITS bits, which is broadcast instead: payloads outside it have no copy and stay where they are, and of those inside
it only headers are joined. Revisits are written from their headers; only the originals' payloads are then fetched, by a
second bitmap and a join. Each task writes its records: a response with its payload, or an identical-payload-digest
revisit that refers to the original response, all with fresh headers.

Archives are written by Spark's text sink whose line separator is the two line ends that close a WARC record, so the
files are byte-exact WARC 1.1 (gzip by default, one member a file) on any file system that Spark can write. A row of the sink
holds records of about ROW_BYTES, and a file FILE_ROWS rows, so files are bounded (one larger record makes a larger row).

Defined results: null html is an empty payload; a null url becomes ``urn:page:ID``, and line ends in a url are
percent-encoded; payloads smaller than min_payload are always responses; a null page_id is the last of its group and
a response only if all are null; rows repeating the response's page_id and payload are responses too; extra columns
are ignored; an empty table writes no record.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, stored

ROW_BYTES = 1 << 20
FILE_ROWS = 128
MOST_BROADCAST = 250_000
MOST_BITS = 28
END = "\r\n\r\n"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    """A record's id, the same whenever a lost task is run again."""
    h = hashlib.sha1(f"{kind} {page_id} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def target_uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, headers: dict[str, str], block: str) -> str:
    """One record without the two line ends that close it."""
    head = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{sha1_base32(block.encode())}", "Content-Length": str(len(block.encode()))}
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in head.items())]) + END + block


def _bitmap(keys: DataFrame, column: str, n: int) -> tuple[DataFrame, Column, Column]:
    """A broadcast bitmap of the hashes of about n keys, with a row's bucket and the test of its bit (of column ``m``)."""
    bits = 1 << min(MOST_BITS, max(15, (16 * n).bit_length()))
    at = F.expr(f"pmod(xxhash64({column}), {bits}L) + 1")  # bitmap buckets of positive numbers begin at 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m"))
    position = f"bitmap_bit_position(pmod(xxhash64({column}), {bits}L) + 1)"
    byte = f"cast(conv(hex(substring(m, cast({position} div 8 as int) + 1, 1)), 16, 10) as int)"
    inside = F.expr(f"m is not null and (shiftright({byte}, cast({position} % 8 as int)) & 1) = 1")
    return F.broadcast(rows), F.bitmap_bucket_number(at), inside  # 4 KB for each 32,768 bits


def resolved(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, digest, size, original, original_url): original is null for responses; html may be null for revisits."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    heads = p.where(F.col("size") >= min_payload).select("digest", "page_id", "url")
    # nulls count as the largest id
    first = heads.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("f"))
    first = stored(first.where("n > 1").select("digest", F.col("f.none").alias("none"), F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "digests")
    columns = ("page_id", "url", "html", "digest", "size")
    revisit = (F.col("size") >= min_payload) & F.col("none").isNotNull() & ~F.col("none") & ~F.col("page_id").eqNullSafe(F.col("first"))
    originals = (F.when(revisit, F.col("first")).alias("original"), F.when(revisit, F.col("first_url")).alias("original_url"))
    n = first.count()
    if n <= MOST_BROADCAST:
        return p.join(F.broadcast(first), "digest", "left").select(*columns, *originals)
    held, bucket, inside = _bitmap(first, "digest", n)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("original", "long"), ("original_url", "string"))]
    marked = p.join(held, bucket == F.col("k"), "left").withColumn("inside", inside)
    single = marked.where("not inside").select(*columns, *none)
    known = marked.where("inside").drop("html").join(first, "digest", "left")
    copies = known.where(revisit).select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", *originals)
    # responses among them: the originals, and payloads that only look repeated
    wanted = stored(known.where(~F.coalesce(revisit, F.lit(False))).select("digest", F.struct("page_id").alias("id")).distinct(), "wanted")
    held, bucket, inside = _bitmap(wanted, "digest, id.page_id", wanted.count())
    rest = marked.where("inside").drop("k", "m", "inside").withColumn("id", F.struct("page_id"))
    rest = rest.join(held, bucket == F.col("k"), "left").where(inside).join(wanted, ["digest", "id"], "left_semi").select(*columns, *none)
    return single.union(copies).union(rest)


def write_warc(pages: DataFrame, path: str, min_payload: int = 0, compression: str = "gzip", date: str | None = None, **columns: str) -> None:
    """Write one record for each row of pages, in files under path; a task's first file starts with a warcinfo record.

    date: the records' WARC-Date, by default the time of this call.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, size, begun = [], 0, False
        for b in batches:
            for page, url, html, digest, n, original, original_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun:
                    out.append(record("warcinfo", {"WARC-Record-ID": record_id("warcinfo", part, path), "WARC-Date": date, "Content-Type": "application/warc-fields"}, "software: sparkwell\r\nformat: WARC File Format 1.1\r\n"))
                    begun = True
                base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                headers = {
                    "WARC-Record-ID": record_id("revisit" if original is not None else "response", page, digest),
                    "WARC-Date": date, "WARC-Target-URI": target_uri(url, page), "WARC-Payload-Digest": f"sha1:{base32}",
                    "Content-Type": "application/http;msgtype=response", "X-Page-Id": "" if page is None else str(page),
                }
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}{END}"
                if original is None:
                    out.append(record("response", headers, http + html))
                else:
                    headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id("response", original, digest), "WARC-Refers-To-Target-URI": target_uri(original_url, original), "WARC-Refers-To-Date": date}
                    out.append(record("revisit", headers, http))
                size += len(out[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(out)], pa.string())], ["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(out)], pa.string())], ["value"])

    bounded_batches(pages.sparkSession)
    rows = resolved(pages, min_payload, **columns)
    rows.mapInArrow(run, "value string").write.option("maxRecordsPerFile", FILE_ROWS).option("lineSep", END).option("compression", compression).text(path)


_LINE = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.decode().lower(): v.decode() for k, v in _LINE.findall(data, data.index(b"\r\n", at), end)}
        block = data[end + 4 : (to := end + 4 + int(head["content-length"]))]
        if data[to : to + 4] != END.encode():
            raise ValueError(f"the record at byte {at} doesn't end after its block")
        yield head, block
        at = to + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under path: (record_id, record_type, page_id, url, refers_to_id, payload_bytes, payload_digest, html, file).

    Digests of blocks, and of payloads that are present, are checked; a wrong one raises. payload_bytes and
    payload_digest are of the full payload, also for revisits, whose html is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "page_id", "url", "refers_to_id", "payload_bytes", "payload_digest", "html", "file"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_buffer().to_pybytes()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                out: list[tuple] = []
                for h, block in parse(data):
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    if h["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
                        raise ValueError(f"{file}: wrong block digest in {h['warc-record-id']}")
                    http, payload = block.split(END.encode(), 1)
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    whole = h["warc-type"] == "response"
                    if whole and (digest != sha1_base32(payload) or size != len(payload)):
                        raise ValueError(f"{file}: wrong payload in {h['warc-record-id']}")
                    page = int(h["x-page-id"]) if h.get("x-page-id") else None
                    out.append((h["warc-record-id"], h["warc-type"], page, h.get("warc-target-uri"), h.get("warc-refers-to"), size, digest, payload.decode() if whole else None, file))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "record_id string, record_type string, page_id long, url string, refers_to_id string, payload_bytes long, payload_digest string, html string, file string")


def with_originals(records: DataFrame) -> DataFrame:
    """Records with refers_to, the page_id of the response that a revisit refers to."""
    r = records.drop("html")
    targets = r.where("refers_to_id is not null").select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = r.where("record_type = 'response'").join(targets, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    return r.join(stored(originals, "originals", records.count()), "refers_to_id", "left")


def write_and_read(spark: SparkSession, pages: DataFrame, min_payload: int = 0, date: str | None = None) -> DataFrame:
    """Write the archives to the shared folder and read every record back."""
    path = new_path(spark, "warc")
    write_warc(pages, path, min_payload, date=date)
    records = read_warc(spark, path)
    heads = stored(records.drop("html", "url", "file"), "heads")
    return with_originals(heads.withColumn("html", F.lit(None).cast("string")))
