import base64
import hashlib
import io
from collections import Counter, defaultdict

import pytest

zstandard = pytest.importorskip("zstandard")
from loomwright.llm import warc  # noqa: E402
from loomwright.llm.common import fresh_path  # noqa: E402

ROWS = [(None, None, None), (1, "http://a/", ""), (2, "u", "<p>x</p>"), (3, "u v\r\nX: y", "<p>x</p>"), (4, None, "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "é", "é中" * 50_000), (6, "r", "rep"), (6, "r", "rep"), (None, "n", "only null"), (None, "n", "only null")]
ROWS += [(k, f"http://h/{k}", f"<html><body>page {k} with a common frame</body></html>") for k in range(10, 300)] + [(k, "hot", "hot page") for k in range(1000, 1200)]


def brute():
    groups = defaultdict(list)
    for i, _, h in ROWS:
        groups[h or ""].append(i)
    out = Counter()
    for i, _, h in ROWS:
        best = max((x for x in groups[h or ""] if x is not None), default=None)
        p = (h or "").encode()
        out[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == best else "revisit", None if i == best else best] += 1
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_archives(pages, fresh_path(spark, "warc"))
    got = warc.read_archives(manifest).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute()
    html = defaultdict(set)
    for i, _, h in ROWS:
        html[i].add((h or "").encode())
    assert all(bytes(r.payload) in html[r.page_id] for r in got if r.record_type == "response")
    for (name,) in manifest.select("archive").distinct().collect():
        filesystem, path = warc._open(name)
        with filesystem.open_input_file(path) as f:
            data = f.read()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        d = zstandard.ZstdCompressionDict(warc.read_dictionary(io.BytesIO(data)))
        size, rest, kinds = int.from_bytes(data[4:8], "little"), data[8 + len(d.as_bytes()) :], []
        assert size == len(d.as_bytes())
        while rest:  # every frame is one record
            o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
            record = o.decompress(rest)
            kinds += [h["WARC-Type"] for h, _ in warc.parse_records(io.BytesIO(record))]
            assert record.endswith(b"\r\n\r\n")
            rest = o.unused_data
        assert kinds[0] == "warcinfo" and len(kinds) == 1 + sum(r.records for r in manifest.filter(manifest.archive == name).collect())
    assert warc.read_archives(warc.write_archives(pages.limit(0), fresh_path(spark, "warc"))).collect() == []


def test_urls_come_back_and_either_join_is_the_same(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    urls = {i: u for i, u, _ in ROWS if i is not None}
    got = warc.read_archives(warc.write_archives(pages, fresh_path(spark, "warc"))).collect()
    assert all(r.url == urls[r.page_id] for r in got if r.page_id is not None)
    joined, broadcast = (Counter(map(tuple, warc.with_revisits(pages, most_broadcast=n).collect())) for n in (0, 1000))
    assert joined == broadcast


def test_the_dictionary_pays():
    records = [warc.build_record(k, f"http://h/{k}", f"<html><head><title>{k}</title></head><body><nav>the same navigation bar everywhere</nav>{k * 7919}</body></html>", None, False, "d") for k in range(500)]
    d = zstandard.ZstdCompressionDict(warc.dictionary(records))
    with_it, without = (sum(len(zstandard.ZstdCompressor(dict_data=x).compress(r)) for r in records) for x in (d, zstandard.ZstdCompressionDict(b"")))
    assert with_it < 0.5 * without
