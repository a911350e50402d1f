"""Archives against SQL, the format itself, range reads and edge rows."""

import base64
import hashlib
import re
from pathlib import Path

from tidewatch.llm import warc
from tidewatch.llm.common import scratch_path

ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c\r\nX-Evil: 1", None), (4, "http://d", ""), (5, "http://é", "Ünï\r\n\r\nWARC/1.0\r\n\r\n"),
        (5, "http://é", "Ünï\r\n\r\nWARC/1.0\r\n\r\n"), (5, "http://f", "other"), (None, "http://g", "same"), (None, "http://h", "no id"), (None, "http://i", "no id"), (7, "http://j", "x" * 300000)]


def frame(spark):
    return spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string")


def expected(rows):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        top = max((x for x, _, h in rows if (h or "") == (html or "") and x is not None), default=None)
        again = top is not None and i != top
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query(same):
    same("op5_indexed_warc")


def test_edge_rows(spark):
    got = warc.round_trip(frame(spark))
    assert shown(got) == expected(ROWS)
    payloads = {r.page_id: r.payload.decode() for r in got.where("record_type = 'response' AND page_id IN (5, 7)").collect() if r.url != "http://f"}
    assert payloads == {5: ROWS[5][2], 7: ROWS[11][2]}
    assert warc.round_trip(frame(spark).limit(0)).collect() == []


def test_format_and_selection(spark):
    folder = scratch_path(spark, "warc-test")
    warc.write_archives(frame(spark), folder)
    index = warc.index_archives(spark, folder)
    assert index.count() == len(ROWS)
    for r in index.collect():
        data = Path(r.file.removeprefix("file:")).read_bytes()
        record = data[r.offset : r.offset + r.length]
        head, _, body = record.partition(b"\r\n\r\n")
        assert record.startswith(b"WARC/1.0\r\n") and data[r.offset + r.length :][:4] == b"\r\n\r\n"
        assert len(body) == int(re.search(rb"Content-Length: (\d+)", head)[1]) == (0 if r.record_type == "revisit" else r.payload_bytes)
        assert b"X-Evil" not in head.replace(b"%0D%0AX-Evil", b"")
    some = index.where("page_id = 4 OR page_id = 7")
    assert shown(warc.read_records(some)) == [r for r in expected(ROWS) if r[0] in (4, 7)]
    assert shown(warc.read_records(index, whole=True)) == expected(ROWS)


def test_ranges_are_merged():
    rows = [("a", 0, 10), ("a", 14, 10), ("a", 30 + warc.GAP_BYTES, 5), ("b", 0, 5), ("b", 9, warc.READ_BYTES), ("b", 20 + warc.READ_BYTES, 3)]
    assert list(warc._runs(rows)) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert list(warc._runs([])) == []
