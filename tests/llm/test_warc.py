import gzip
import hashlib
import io

import pytest

from seamline.llm import warc


def test_reader_frames_and_verifies():
    digest = hashlib.sha256(b"x\r\n\r\ny").hexdigest()
    one = warc.record("1", "http://a/\nb", "response", None, b"x\r\n\r\ny", 6, digest)
    two = warc.record("2", None, "revisit", "1", b"", 6, digest)
    got = list(warc.read_records(io.BytesIO(one + two)))
    assert [(f["x-page-id"], n, d, p) for f, n, d, p in got] == [("1", 6, digest, b"x\r\n\r\ny"), ("2", 6, digest, None)]
    assert got[1][0]["x-refers-to-page-id"] == "1"
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO((one + two)[:-9])))
    plain = gzip.decompress(one)
    for bad in (plain.replace(b"\r\n\r\ny\r\n", b"\r\n\r\nz\r\n"), plain[:-4], b"x" + plain):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))


def test_round_trip_matches_brute_force(spark):
    big, long = "é" * 60, "<p>" * 50_000
    html = [None, "", "short", "short", big, big, big, long, long, "y" * 99, "y" * 99, "y" * 100, "y" * 100]
    rows = [(100 - i, f"http://x/{i}", h, "e") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, archive_bytes=300).collect()}
    want = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(j for j, _, g, _ in rows if (g or "") == (h or "")) if len(b) >= 100 else i
        want[i] = (len(b), hashlib.sha256(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ids_of_any_text_come_back(spark):
    ids = ["a\r\nX: 1", " pad ", "", "ünï/%41", "\n", None, "z" * 5000]
    rows = [(i, "u", "p" * 200) for i in ids] + [("q%d" % k, None, "x" * k) for k in range(30)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()
    assert sorted(str(r.page_id) for r in out) == sorted(str(i) for i, _, _ in rows)
    same = {r.page_id: (r.record_type, r.refers_to) for r in out if r.payload_bytes == 200}
    assert same[None] == ("response", None) and all(v == ("revisit", None) for k, v in same.items() if k is not None)
    two = warc.record("2", None, "revisit", "a b", b"", 6, "0")
    fields = warc.parse(gzip.decompress(two))[0]
    assert fields["warc-refers-to"] == warc.record_id("a b")


def test_one_partition_for_each_archive(spark):
    pages = spark.createDataFrame([(i, "u", str(i) * 300) for i in range(60)], "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages, warc.shared_folder(spark) + "/test-warc", archive_bytes=200)
    assert manifest.count() > 20
    assert warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count()
