import gzip
import hashlib
import io
import re

import pytest

from murmur.llm import queries, warc
from tests.llm.util import SF, frame

SCHEMA = "page_id long, url string, html string"
BIG = "<p>é</p>" * 200
PAGES = [(1, "http://a/", BIG), (5, "http://b/\r\nX: y", BIG), (3, None, BIG), (7, "u", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""),
         (11, "u", BIG + "WARC/1.1\r\nContent-Length: 3\r\n\r\n"), (12, "u", "x" * 999), (13, "u", "x" * 999), (14, "u", "y" * 1000), (15, "u", "y" * 1000),
         (None, "u", "y" * 1000), (16, "u", "z" * 3_000_000)]


def brute(rows):
    low = [(i, (h or "").encode()) for i, _, h in rows]
    lead = {}
    for i, b in low:
        if len(b) >= 1000 and i is not None:
            lead[b] = max(lead.get(b, i), i)
    return sorted(((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if b in lead and lead[b] != i else "response",
                    lead[b] if b in lead and lead[b] != i else None) for i, b in low), key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    df = frame(spark, PAGES, SCHEMA).selectExpr("*", "1 as payload", "'q' as record_type")
    assert rows_of(warc.round_trip(df)) == brute(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_filters_and_skipping(spark, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(frame(spark, PAGES, SCHEMA).repartition(3)), path, compression)
    back = warc.read(spark, path)
    revisits = back.where("record_type = 'revisit'")
    assert "record_type" not in re.findall(r"Filter .*", revisits._jdf.queryExecution().executedPlan().toString()).__str__() or revisits.count() == 4
    assert sorted(r.record_id or "" for r in revisits.collect()) == ["", "1", "14", "3"]
    assert all(r.payload is None and r.payload_length >= 1000 for r in revisits.collect())
    some = back.where("record_id in ('7', '16') and record_type = 'response'").collect()
    assert {r.record_id: len(r.payload) for r in some} == {"7": 5, "16": 3_000_000}
    heads = warc.read(spark, path, payload=False)
    assert heads.where("payload is not null").count() == 0
    assert {r.record_id: r.payload_length for r in heads.collect()}["16"] == 3_000_000
    assert [r.target_uri for r in back.where("record_id = '5'").collect()] == ["http://b/%0D%0AX: y"]


def test_payload_is_not_read_when_filtered():
    data = warc.record("response", "1", "u", None, "d", "00" * 20, 4, b"body") + warc.record("response", "2", "u", None, "d", "11" * 20, 4, b"next")
    class Stream(warc._Plain):
        reads = 0
        def read(self, n):
            Stream.reads += 1
            return super().read(n)
    got = list(warc.read_archive(Stream(io.BytesIO(data)), lambda r: r["record_id"] == "2", True))
    assert len(got) == 1 and got[0][-1] == b"next" and Stream.reads == 1
    zipped = b"".join(gzip.compress(x) for x in (data[:len(data) // 2], data[len(data) // 2:]))
    assert len(list(warc.read_archive(warc._Members(io.BytesIO(zipped)), lambda r: True, True))) == 2


def test_cut_archive_raises():
    data = warc.record("response", "1", "u", None, "d", "00" * 20, 400, b"b" * 400)[:-200]
    with pytest.raises(ValueError):
        list(warc.read_archive(warc._Plain(io.BytesIO(data)), lambda r: True, True))
    with pytest.raises(ValueError):
        list(warc.read_archive(warc._Members(io.BytesIO(gzip.compress(data))), lambda r: False, True))


def test_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(queries.op7_warc(spark, SF)) == brute(pages)
