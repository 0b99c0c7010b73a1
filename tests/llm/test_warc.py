import hashlib
import struct

import zstandard

from tessella.llm import warc
from tessella.llm.common import scratch_path
from tessella.llm.files import open_input

BIG = "ü<p>x</p>" * 200


def test_records_come_back(spark):
    rows = [(1, "http://a\r\nX: y", BIG, 0), (5, "http://b", BIG, 0), (None, None, BIG, 0), (2, "u", "small", 0), (3, "u", "small", 0), (4, "u", None, 0), (6, "u", "", 0), (5, "http://b", BIG, 0), (7, "u", "y" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int").repartition(2)
    folder = scratch_path(spark, "w")
    manifest = warc.write_archives(pages, folder, archive_bytes=500)
    got = sorted(warc.read_archives(manifest).collect(), key=str)
    assert len(got) == len(rows) and manifest.count() > 2
    for r in got:
        html = (next(h for p, _, h, _ in rows if p == r.page_id) or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = r.page_id in (1, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
    assert warc.read_archives(warc.write_archives(pages.limit(0), scratch_path(spark, "w"))).collect() == []


def test_a_record_can_be_read_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 300) for i in range(40)], "page_id long, url string, html string").repartition(1)
    manifest = warc.write_archives(pages, scratch_path(spark, "w"))
    path = manifest.first().path
    r = warc.read_archives(manifest).where("page_id = 17").first()
    f = open_input(path)
    raw = f.read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + n])).decompressobj()
    assert warc.parse_record(d.decompress(raw[r.offset :]))["payload"] == b"<p>17</p>" * 300
