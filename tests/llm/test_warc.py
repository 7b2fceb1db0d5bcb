from __future__ import annotations

import base64
import hashlib
import io

from tables import same_rows

from quillbin.llm import warc
from quillbin.llm.common import fresh_dir

PAGES = [(1, "u", "x"), (2, "u", "x"), (2, "u", "x"), (None, "u", "x"), (5, None, None), (6, "a\r\nb", ""), (7, "q", "é\r\n\r\n" * 5000), (8, "q", "other"), (None, None, "null id")]


def test_same_rows_as_sql(spark, sf, duck):
    same_rows(warc.op4(spark, sf), duck.sql(warc.OP4_SQL))


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    out = warc.read_archives(warc.write_archives(pages, fresh_dir(spark, "w")), keep_payload=True).collect()
    assert len(out) == len(PAGES)
    by_digest = {}
    for r in out:
        by_digest.setdefault(r["payload_digest"], []).append(r)
    for _, _, html in PAGES:
        payload = (html or "").encode()
        group = by_digest[base64.b32encode(hashlib.sha1(payload).digest()).decode()]
        response = [r for r in group if r["record_type"] == "response"]
        assert len(response) == 1 and response[0]["payload"] == payload
        assert response[0]["page_id"] == max((i for i, _, h in PAGES if (h or "") == (html or "") and i is not None), default=None)
        assert all(r["refers_to"] == response[0]["page_id"] and r["payload"] is None for r in group if r["record_type"] == "revisit")
        assert {r["payload_bytes"] for r in group} == {len(payload)}


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, fresh_dir(spark, "w"))).count() == 0


def test_dictionary_leads_the_file():
    out = io.BytesIO()
    records = [warc.record(warc.Page(i, "u", f"<html><body>page {i} {'text ' * (i % 7)}</body></html>".encode() * 20, None), "0") for i in range(200)]
    warc.write_file(out, records)
    assert int.from_bytes(out.getvalue()[:4], "little") == 0x184D2A5D
    out.seek(0)
    assert [*warc.read_file(out)] == records
    assert len(out.getvalue()) < sum(map(len, records)) / 5
