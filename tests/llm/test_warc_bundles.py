import base64
import hashlib
import re

import pyarrow.fs as pafs
import zstandard
from pyspark.sql import functions as F

from thermobox.llm.common import shared_folder
from thermobox.llm.warc_bundles import op3, read_archives, write_archives

PAGES = [
    (5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "http://a/3", "über\r\n\r\nx"),
    (7, "http://b\r\nX: y", None), (8, "http://b/8", ""), (1, "http://b/1", "z" * 700_000), (None, "http://n", "same"),
    (4, "http://c", "WARC/1.1\r\n\r\nHTTP/1.1\r\nContent-Length: 3\r\n\r\n"), (2, "http://a/2", "same"),
]


def want(rows):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        start = first.get(html or "")
        revisit = page_id != start and start is not None
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if revisit else "response", start if revisit else None))
    return sorted(out, key=str)


def test_rows(spark):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, first int")
    assert sorted(map(tuple, op3(pages).collect()), key=str) == want(PAGES)


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    rows += [(r[0] + 100_000, r[1], r[2]) for r in rows[::3]]
    both = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, op3(both).collect()), key=str) == want(rows)


def test_payloads_come_back_and_bundles_are_plain_zstd(spark):
    folder = shared_folder(spark, "warc-test")
    index = write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in read_archives(index).collect()}
    assert bytes(got[1].payload) == b"z" * 700_000 and bytes(got[3].payload) == "über\r\n\r\nx".encode()
    assert got[5].payload is None and got[7].url == "http://b X: y"
    assert read_archives(index.where(F.col("page_id") == 4)).collect()[0].payload == bytearray(PAGES[8][2].encode())
    system, path = pafs.FileSystem.from_uri(folder)
    records = 0
    for info in system.get_file_info(pafs.FileSelector(path)):
        with system.open_input_stream(info.path, compression=None) as f:
            reader = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
            records += len(re.findall(rb"WARC-Type: (?:response|revisit)\r\n", reader.read()))
    assert records == len(PAGES)


def test_small_payloads_are_all_responses(spark):
    folder = shared_folder(spark, "warc-test")
    index = write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder, min_bytes=5)
    assert {r.record_type for r in read_archives(index, with_payload=False).collect()} == {"response"}


def test_empty_table(spark):
    assert op3(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
