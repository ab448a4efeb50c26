"""WARC archives as Zstandard frames with an embedded dictionary.

An archive starts with a skippable frame that holds a dictionary built from a
bounded sample of its own records; each record is then one frame of its own,
compressed with that dictionary, so any record can be read alone.  Of records
with equal payloads one is a response and the others revisit it.

Archives are rows (archive, data) of a table in the shared folder, so writing and
reading go through Spark's file systems; export() puts them into files.

Defined results: null html is an empty payload; a null url leaves out the target
URI; fully equal rows are one response and revisits of it; ids that are texts are escaped in
the records' names, and come back as they were, the empty one too; a page of any length is one record; columns besides page_id, url and
html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Records of an archive hold at most this many bytes before compression (a longer record is alone).
ARCHIVE_BYTES = 24 << 20
#: Bytes of the dictionary, and of the records it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
LEVEL = 3
#: Fixed value: magic number of the skippable frame of dictionaries.
MAGIC = 0x184D2A5D
_FRAME = b"\x28\xb5\x2f\xfd"
_WHEN = "1970-01-01T00:00:00Z"
_URN = "urn:x-page-id:"


def _urn(page_id) -> str:
    """The record's name of a page: its id with escapes, nothing for null, a single % for the empty text."""
    return _URN if page_id is None else _URN + (quote(str(page_id), safe="-") or "%")


def record(page_id, url, kind: str, digest: str, size: int, payload: bytes, refers_to=None) -> bytes:
    """One WARC record with an HTTP block; a revisit has the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {_WHEN}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and block of a record, and the HTTP header's length and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    return {"fields": fields, "size": size, "payload": payload}


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of evenly spaced records; raw content where they are too few to train on."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [r[: DICTIONARY_BYTES] if len(records) < 8 else r for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def pack(records: list[bytes]) -> bytes:
    """An archive of the records."""
    words = dictionary(records)
    shared = zstandard.ZstdCompressionDict(words)
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(words)), words, *(one.compress(r) for r in records)])


def _frame_end(data, at: int) -> int:
    """Where the frame that starts at `at` ends, by its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        head = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        end += 3 + (1 if kind == 1 else size)
    return end + 4 * (flags >> 2 & 1)


def unpack(data: bytes):
    """The records of an archive, one by one."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if data[at : at + 4] != _FRAME:
            raise ValueError("not a frame")
        end = _frame_end(view, at)
        yield one.decompress(view[at:end])
        at = end


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def classify(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records (page_id, url, sha, size, html, refers_to, kind): payloads of `least` bytes or more are kept once."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html")).select("page_id", "url", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("size"), "html")
    large, none = rows.where(F.col("size") >= least), F.lit(None).cast(pages.schema["page_id"].dataType)
    last = F.max(F.struct("page_id", F.struct("url").alias("u"))).alias("last")
    # equal digests have equal html, so any of them will do; copies are folded before they travel
    first = large.groupBy("sha").agg(last, F.first("size").alias("size"), F.first("html").alias("html"))
    responses = first.select("last.page_id", "last.u.url", "sha", "size", "html", none.alias("refers_to"), F.lit("response").alias("kind"))
    light = _spark.written(large.drop("html").groupBy("sha", "page_id", "url", "size").agg(F.count(F.lit(1)).alias("n")), "payloads")
    # only what has copies is joined, and the rows of one payload are not put into one task
    chosen = light.groupBy("sha").agg(last, F.count(F.lit(1)).alias("rows"), F.sum("n").alias("copies")).where("copies > 1").select("sha", "rows", F.col("last.page_id").alias("refers_to"), F.col("last.u.url").alias("its_url"))
    more = _spark.spread_join(light, _spark.written(chosen, "chosen"), "sha", "rows", light.count()).withColumn("n", F.col("n") - (F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("url").eqNullSafe(F.col("its_url"))).cast("long")).where("n > 0")
    revisits = more.select("page_id", "url", "sha", "size", F.lit(None).cast("binary").alias("html"), "refers_to", F.lit("revisit").alias("kind"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).drop("i")
    out = responses.unionByName(revisits)
    if least > 0:
        out = out.unionByName(rows.where(F.col("size") < least).select("*", none.alias("refers_to"), F.lit("response").alias("kind")))
    return out


def write(records: DataFrame) -> DataFrame:
    """The table of archives (archive, data) of classify()'s records, written to the shared folder."""

    def run(batches):
        held, size, part, n = [], 0, TaskContext.get().partitionId(), 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{n:05d}.warc.zst"]), pa.array([pack(held)], pa.binary())], ["archive", "data"])

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "kind", "sha", "size", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, kind, sha, length, html, refers_to = (c[i].as_py() for c in cols)
                one = record(page_id, url, kind, _base32(sha), length, html or b"", refers_to)
                if held and size + len(one) > ARCHIVE_BYTES:
                    yield archive()
                    held, size, n = [], 0, n + 1
                held.append(one)
                size += len(one)
        if held:
            yield archive()

    return _spark.written(_spark.arrow_map(records, run, "archive string, data binary"), "warc")


def read(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a response's digest is made anew from what was read."""
    integer = id_type in ("bigint", "int", "smallint", "tinyint")

    def name(urn):
        text = urn[1 + len(_URN) : -1] if urn else ""
        return None if not text else int(text) if integer else unquote(text) if text != "%" else ""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                rows = []
                for one in unpack(data.as_py()):
                    r = parse(one)
                    f = r["fields"]
                    digest, kind = f["warc-payload-digest"].partition(":")[2], f["warc-type"]
                    if kind == "response":
                        made = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                        if made != digest or len(r["payload"]) != r["size"]:
                            raise ValueError(f"{f['warc-record-id']}: the payload read is not the payload written")
                    rows.append((name(f["warc-record-id"]), r["size"], digest, kind, name(f.get("warc-refers-to"))))
                kinds = pa.int64() if integer else pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (kinds, pa.int64(), pa.string(), pa.string(), kinds))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = "bigint" if integer else "string"
    return _spark.arrow_map(archives.select("data"), run, f"page_id {out}, payload_bytes bigint, payload_digest string, record_type string, refers_to {out}")


def export(archives: DataFrame, folder: str) -> list[str]:
    """Puts each archive into a .warc.zst file of a folder that the driver can write, one at a time."""
    names = []
    for r in archives.select("archive", "data").toLocalIterator():
        with open(f"{folder}/{r['archive']}", "wb") as f:
            f.write(r["data"])
        names.append(r["archive"])
    return names


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = _spark.table(spark, sf_dir, "pages")
    return read(write(classify(pages)), _spark.id_type(pages, "page_id"))


_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_GROUPS = " || ".join(f"substr({_DIGITS}, (('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k} & 31)::INTEGER + 1, 1)" for g in range(4) for k in range(8))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_GROUPS} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM r
"""
