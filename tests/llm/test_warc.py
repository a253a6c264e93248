import io

import pytest

from inkwell.llm import warc
from inkwell.session import scratch_path


def test_reader_frames_members_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    bodies = [b"", b"a\r\n\r\nb", bytes(range(256)) * 300]
    data = b"".join(warc.gzip_member(warc.record("response", f"urn:{i}", "http://x/ y", b, None, "d")) for i, b in enumerate(bodies))
    got = [block.partition(b"\r\n\r\n")[2] for _, block in warc.read_records(io.BytesIO(data))]
    assert got == bodies
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20])))


def test_reader_verifies():
    good = warc.record("response", "urn:1", "u", b"payload", None, "d")
    for bad in (good.replace(b"payload", b"PAYLOAD"), good[:-2], good.replace(b"Content-Length: 7", b"Content-Length: 6", 1)[:-1]):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(warc.gzip_member(bad))))


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big, "k"), (2, None, big, "k"), (3, "u", "short", "k"), (4, "u", "short", "k"), (5, "u", None, "k"), (2, "again", big, "k"), (None, "n", big, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, head string")
    got = warc.warc_round_trip(df, scratch_path(spark, "t")).collect()
    told = sorted((r["record_id"].rpartition("#")[2], r["record_type"], (r["refers_to"] or "").rpartition("#")[2], r["payload_bytes"]) for r in got)
    assert told == [("1", "revisit", "2", 1200), ("2", "response", "", 1200), ("2", "response", "", 1200), ("3", "response", "", 5), ("4", "response", "", 5), ("5", "response", "", 0), ("None", "revisit", "2", 1200)]
    assert warc.warc_round_trip(df.limit(0), scratch_path(spark, "t")).count() == 0
