"""WARC archives compressed record by record with a dictionary of their own.

Each task writes one archive: it holds back its first records, trains a Zstandard dictionary on them,
puts the dictionary into a leading skippable frame (magic 0x184D2A5D, as the WARC/zstd specification
has it) and compresses every record as a frame of its own. Archives go to the shared folder under
names of their own for each attempt; the stored manifest lists those of the attempts that counted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_hot_apart, stored, text_or_empty
from .common import open_uri as _open

MAGIC = 0x184D2A5D
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES, RANGE_BYTES = 8_000_000, 4000, 112_640, 2_000_000
MOST_BROADCAST = 500_000  # rows of a digest and an id
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, start long, length long, records long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_record(page_id, url: str | None, html: str, refers_to, revisit: bool, date: str) -> bytes:
    """One capture as a response record, or as a revisit of the response that has its payload."""
    payload = html.encode()
    digest, page = digest32(payload), "" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date)]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: quote(m[0]), url)
        headers.append(("WARC-Target-URI", safe))
        if safe != url:  # so that it is read back as given
            headers.append(("X-Target-URI", quote(url, safe="")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", page))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("" if refers_to is None else str(refers_to), digest)), ("X-Payload-Length", str(len(payload)))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page", str(refers_to)))
    return _record(headers, http if revisit else http + payload)


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on records; too few or too small ones serve as they are."""
    import zstandard

    joined = b"".join(samples)
    if len(samples) >= 16 and len(joined) > 20_000:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, len(joined) // 8), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return joined[-DICTIONARY_BYTES:]


def _dict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data)


def _write(root: str, level: int, date: str):
    def run(batches):
        import zstandard

        held, held_bytes, out, compress, manifest = [], 0, None, None, []
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        at = start = records = 0

        def begin():
            nonlocal out, compress, at, start
            data = dictionary(held)
            filesystem, path = _open(name)
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            out = filesystem.open_output_stream(path, compression=None)
            out.write(struct.pack("<II", MAGIC, len(data)) + data)
            compress = zstandard.ZstdCompressor(level=level, dict_data=_dict(data), write_checksum=True).compress
            at = start = 8 + len(data)
            out.write(info := compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            at += len(info)
            for r in held:
                put(r)
            held.clear()

        def put(record):
            nonlocal at, start, records
            frame = compress(record)
            out.write(frame)
            at, records = at + len(frame), records + 1
            if at - start >= RANGE_BYTES:
                manifest.append((name, start, at - start, records))
                start, records = at, 0

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                record = build_record(*row, date)
                if out:
                    put(record)
                else:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= SAMPLE_BYTES or len(held) >= SAMPLE_RECORDS:
                        begin()
        if held:
            begin()
        if out:
            out.close()
            if at > start:
                manifest.append((name, start, at - start, records))
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*manifest, strict=True)], names=["archive", "start", "length", "records"])

    return run


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, html, refers_to, revisit. Only digests are grouped; those that occur more than once are
    broadcast, so no html moves, if there are at most ``most_broadcast``. If there are more, the pages are joined
    with them and the html is shuffled once, hot digests apart."""
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    shared = stored(base.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1").select("digest", "best", F.lit(True).alias("more")), "warc-shared")
    revisit = F.coalesce(F.col("more"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("best"))
    joined = base.join(F.broadcast(shared), "digest", "left") if shared.count() <= most_broadcast else join_hot_apart(base, shared, ["digest"], "left")
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("best")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages`` to archives under ``root`` (a URI that Spark and pyarrow both open; see ``common.open_uri``) and
    return the manifest: archive, start, length, records of ranges of whole frames.

    Payloads are the html in UTF-8, null as empty. Of records with equal payloads that with the largest
    id is the response and the others revisit it; a null id is below all others (if all are null, all
    are responses); rows that repeat the largest id with the same payload are all responses. A null
    url has no header. Other columns aren't read; an empty table gives no archive.
    """
    rows = with_revisits(pages, id_col, url_col, html_col)
    return stored(rows.mapInArrow(_write(root, level, date), MANIFEST), "warc-manifest")


def parse_records(stream):
    """(headers, block) of each WARC record of a decompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        yield headers, stream.read(int(headers["Content-Length"]))


def read_dictionary(f) -> bytes:
    magic, size = struct.unpack("<II", f.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    return f.read(size)


def _read(with_payload: bool):
    schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])

    def run(batches):
        import zstandard

        for b in batches:
            for name, start, length in zip(*(b.column(c).to_pylist() for c in ("archive", "start", "length")), strict=True):
                filesystem, path = _open(name)
                with filesystem.open_input_file(path) as f:
                    decompressor = zstandard.ZstdDecompressor(dict_data=_dict(read_dictionary(f)))
                    f.seek(start)
                    data = f.read(length)
                rows = []
                for h, block in parse_records(io.BufferedReader(decompressor.stream_reader(io.BytesIO(data), read_across_frames=True), 1 << 20)):
                    kind = h["WARC-Type"]
                    url = unquote(h["X-Target-URI"]) if "X-Target-URI" in h else h.get("WARC-Target-URI")
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        rows.append((h.get("X-Page-Id"), url, len(payload), digest32(payload), kind, None, payload if with_payload else None))
                    elif kind == "revisit":
                        rows.append((h.get("X-Page-Id"), url, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), kind, h.get("X-Refers-To-Page"), None))
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[k : k + 1000], strict=True), schema, strict=True)], schema=schema)

    return run


def read_archives(manifest: DataFrame, id_type: str = "bigint", id_col: str = "page_id", with_payload: bool = True) -> DataFrame:
    """One row per capture: id_col, url, payload_bytes, payload_digest (SHA-1 in base32), record_type,
    refers_to and, unless with_payload is false, payload (null for revisits). Ranges are dealt over tasks;
    lengths and digests of responses are those of the payload as read back."""
    parallel = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = manifest.repartition(parallel, "archive", "start").mapInArrow(_read(with_payload), "page string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary")
    out = rows.select(F.col("page").cast(id_type).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"), "payload")
    return out if with_payload else out.drop("payload")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(manifest, pages.schema["page_id"].dataType.simpleString(), with_payload=False).drop("url")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages
)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM p
"""
