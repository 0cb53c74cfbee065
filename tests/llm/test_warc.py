import base64
import glob
import hashlib
import io
from collections import defaultdict

import pytest
import zstandard

from sparkloom.llm import warc
from sparkloom.llm.queries import op4_warc_archives


def brute(pages):
    last = defaultdict(list)
    for i, html in pages:
        last[(html or "").encode()].append(i)
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        ids = [x for x in last[raw] if x is not None]
        to = max(ids) if ids else None
        revisit = to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert rows(op4_warc_archives(spark, sf)) == brute(pages)


def test_round_trip_and_edges(spark, tmp_path):
    html = [None, "", "a", "a", "a", "é" * 9, "<p>\r\n\r\n</p>", "b" * 300000, "a", None]
    urls = [None, "", "http://x/ y\r\nz", "u", "u", "u", "u", "u", "u", "u"]
    data = [(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))] + [(8, "u", "a", ""), (None, "u", "a", ""), (None, "u", "null only", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, archive string").repartition(3)
    manifest = warc.write(df, str(tmp_path / "w"), warc.Writer(archive_bytes=200))
    files = glob.glob(str(tmp_path / "w" / "*.warc.zst"))
    assert {r.archive for r in manifest.collect()} == set(files) and len(files) > 3
    assert manifest.groupBy().sum("records").first()[0] == len(data)
    got = warc.read(manifest)
    assert rows(got) == brute([(d[0], d[2]) for d in data])
    back = {r.page_id: bytes(r.payload).decode() for r in got.collect() if r.payload is not None}
    assert back[7] == html[7] and back[6] == html[6] and back[5] == html[5]
    empty = warc.write(df.filter("false"), str(tmp_path / "e"))
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_archives_are_frames_after_a_dictionary_frame(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"<html><body>page {i} of many, with the same words around it</body></html>") for i in range(300)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path)).collect()
    (path,) = glob.glob(str(tmp_path / "*.warc.zst"))
    raw = open(path, "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    assert int.from_bytes(raw[:4], "little") == 0x184D2A5D and raw[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
    plain = sum(len(zstandard.compress(warc.record(i, u, h.encode()))) for i, u, h in pages)
    assert len(raw) - 8 - size < plain / 2
    fields, block = warc.parse(next(warc.records(io.BytesIO(raw))))
    assert fields["WARC-Type"] == "response" and block.startswith(b"HTTP/1.1 200 OK")
    for cut in (0, 5, 8, 20, 8 + size - 1, len(raw) - 5):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(raw[:cut])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(raw[8 + size :])))


def test_text_ids_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a-1", "u", "x"), ("b-2", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    got = warc.read(warc.write(df, str(tmp_path)))
    assert rows(got) == brute([("a-1", "x"), ("b-2", "x"), (None, "y")])
