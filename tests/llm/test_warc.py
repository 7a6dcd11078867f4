import gzip
import hashlib

from brevier.llm import warc
from brevier.llm.warc import byte_runs, decode_record, read_records, write_archives

LONG = "<p>" + "payload \u00e9 " * 30


def test_round_trip(spark, monkeypatch):
    rows = [(5, "http://a/1", LONG, 1), (3, "http://a/2", LONG, 2), (9, None, LONG, 3), (1, "http://b\r\nX: y", "", 4), (2, "u", None, 5), (4, "u", "short", 6), (6, "u", "short", 7), (7, "u", "y" * 100_000, 8), (None, "u", LONG, 9), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long").repartition(3)
    index = write_archives(pages)
    assert index.count() == len(rows)
    got = {(r.page_id, r.payload_bytes): r for r in read_records(index).collect()}
    assert len(got) == len(rows)
    for page_id, url, html, _ in rows:
        body = (html or "").encode()
        r = got[page_id, len(body)]
        assert r.payload_digest == hashlib.sha256(body).hexdigest()
        revisit = html == LONG and page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == body
        assert r.url == ("http://b%0D%0AX:%20y" if page_id == 1 else url)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)  # by a shuffle of the payloads
    again = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in read_records(write_archives(pages)).collect()}
    assert again == {k: (r.record_type, r.refers_to) for k, r in got.items()}
    few = read_records(index.where("page_id in (3, 7)"), max_gap=0)
    assert {r.page_id for r in few.collect()} == {3, 7}
    assert write_archives(pages.limit(0)).count() == 0


def test_files_are_gzip_members(spark):
    index = write_archives(spark.createDataFrame([(k, "u", LONG + str(k)) for k in range(5)], "page_id long, url string, html string").coalesce(1))
    rows = sorted(index.collect(), key=lambda r: r.offset)
    path = rows[0].folder.removeprefix("file://") + "/" + rows[0].file
    data = open(path, "rb").read()
    assert sum(r.length for r in rows) == len(data) and gzip.decompress(data).count(b"WARC/1.1") == 5
    fields, size, body = decode_record(data[rows[2].offset : rows[2].offset + rows[2].length])
    assert fields["WARC-Type"] == "response" and size == len(body)


def test_byte_runs():
    ranges = [(0, 10), (10, 5), (100, 5), (106, 4), (1000, 50)]
    assert list(byte_runs(ranges, 20, 1000)) == [(0, 2, 0, 15), (2, 4, 100, 110), (4, 5, 1000, 1050)]
    assert list(byte_runs(ranges, 200, 50)) == [(0, 2, 0, 15), (2, 4, 100, 110), (4, 5, 1000, 1050)]
    assert list(byte_runs([], 1, 1)) == []
