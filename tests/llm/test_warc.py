"""Legacy archives: header lines of both versions, lengths, compression, revisits, and the round trip."""

from __future__ import annotations

import gzip
import hashlib
import tempfile

from lanternlake.llm import queries_warc, warc


def test_op1_over_awkward_pages(spark):
    long, other = "<html>" + "x" * 200, "é漢" * 60
    rows = [(5, "http://a/1", long), (2, "http://a/2 b", long), (9, None, long), (4, "http://a/4\nx", other), (6, "u", other), (7, "u", None), (8, "u", ""), (10, "u", "short"), (11, "u", "short"), (12, "u", "line\r\n\r\nWARC/1.1\r\nbreak" * 20)]
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, extra int").write.parquet(f"{folder}/pages.parquet")
    out = {r.page_id: r for r in queries_warc.op1_warc(spark, folder).collect()}
    assert sorted(out) == sorted(r[0] for r in rows)
    first = {long: 2, other: 4}
    for i, _, html in rows:
        data = (html or "").encode()
        expected = first.get(html, i)
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (out[i].record_type, out[i].refers_to) == (("response", None) if expected == i else ("revisit", expected))
    empty = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{empty}/pages.parquet")
    assert queries_warc.op1_warc(spark, empty).count() == 0


def test_op1_with_null_and_repeated_ids(spark):
    long, alone, nulls = "<html>" + "x" * 200, "y" * 150, "z" * 150
    rows = [(2, long), (2, long), (None, long), (7, long), (None, alone), (3, "short"), (None, "short"), (2, "short"), (2, "w" * 120), (None, nulls), (None, nulls), (None, None)]
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id bigint, url string, html string").repartition(5).write.parquet(f"{folder}/pages.parquet")
    out = queries_warc.op1_warc(spark, folder).collect()
    expected = [(k, len(h or ""), "revisit", 2) if h == long and k != 2 else (k, len(h or ""), "response", None) for k, h in rows]
    assert sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out], key=repr) == sorted(expected, key=repr)


def test_record_ids_tell_records_apart(spark):
    rows = [(None, "a"), (None, "b"), (1, "a"), (1, "b"), (2, "a")]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id bigint, url string, html string").repartition(3)
    records = warc.convert_arc(warc.pack_arc(pages)).where("warc_type = 'response'").collect()
    assert len({r.record_id for r in records}) == 5 and {r.key for r in records} == {None, "1", "2"}


def archive(version, *records):
    return warc.arc_version_block(version, "x.arc", "20010203040506") + b"".join(records)


def test_both_versions_and_compression(spark):
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>body\nwith lines</p>"
    one = archive(1, warc.arc_record(1, "http://h/a b", "1.2.3.4", "20010203040507", "text/html", http), warc.arc_record(1, "dns:h", "1.2.3.4", "2001", "text/dns", b"20010203 answer"))
    two = archive(2, warc.arc_record(2, "http://h/c", "1.2.3.4", "20019940000000", "text/html", http, "x.arc", 99, 404))
    cut = archive(1, warc.arc_record(1, "http://h/d", "0.0.0.0", "20010203040507", "text/html", http))[:-20]
    df = spark.createDataFrame([("one", one), ("two", gzip.compress(two)), ("cut", cut), ("none", b""), ("null", None)], "name string, content binary")
    out = {(r.target_uri, r.warc_type): r for r in warc.convert_arc(df).where("warc_type <> 'warcinfo'").collect()}
    a, dns, c, d = out["http://h/a b", "response"], out["dns:h", "resource"], out["http://h/c", "response"], out["http://h/d", "response"]
    assert a.payload == b"<p>body\nwith lines</p>" and a.warc_date == "2001-02-03T04:05:07Z" and a.http_header.startswith(b"HTTP/1.0")
    assert dns.payload == b"20010203 answer" and dns.warc_date == "2001-01-01T00:00:00Z" and dns.content_type == "text/dns"
    assert c.warc_date == "2001-02-03T04:05:06Z" and not c.truncated and d.truncated
    assert a.payload_digest == hashlib.sha256(a.payload).hexdigest()
    assert len({r.record_id for r in out.values()}) == 4
    assert sorted(r.record_id for r in warc.convert_arc(df).collect()) == sorted(r.record_id for r in warc.convert_arc(df).collect())


def test_written_records_read_back(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * (i * 50)) for i in range(12)], "page_id bigint, url string, html string")
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    warc.write_warc(warc.convert_arc(warc.pack_arc(pages)), path, records_per_file=3)
    out = warc.read_warc(spark, path, payloads=True).where("warc_type = 'response'").collect()
    assert sorted((int(r.key), bytes(r.payload).decode()) for r in out) == [(i, "p" * (i * 50)) for i in range(12)]
    assert all(r.intact and r.record_id and r.warc_date == "2024-01-01T00:00:00Z" for r in out)


def test_long_payloads_bound_archives_and_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.createDataFrame([(i, "u", "p" * (1000 * i)) for i in range(8)], "page_id bigint, url string, html string").coalesce(1)
    sizes = [len(r.content) for r in warc.pack_arc(pages).collect()]
    assert len(sizes) > 3 and max(sizes) < 3000 + 7000 + 2000
    body = {i: "p" * (warc.LONG_PAYLOAD + i if i % 2 else 10 * i) for i in range(8)}
    pages = spark.createDataFrame(list(body.items()), "page_id bigint, html string").selectExpr("page_id", "'u' AS url", "html")
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    warc.write_warc(warc.convert_arc(warc.pack_arc(pages)), path)
    out = warc.read_warc(spark, path, payloads=True).where("warc_type = 'response'").collect()
    assert {int(r.key): bytes(r.payload).decode() for r in out} == body and len(out) == len(body)


def test_marking_keeps_the_callers_columns(spark):
    records = warc.convert_arc(warc.pack_arc(spark.createDataFrame([(i, "u", "same" * 50) for i in range(4)], "page_id bigint, url string, html string")))
    records = records.where("warc_type <> 'warcinfo'").selectExpr("*", "'a' AS salt", "'b' AS first_key")
    repeated = warc.repeated_payloads(records.selectExpr("cast(key AS bigint) AS page_id", "payload_digest", "payload_bytes"))
    out = warc.mark_revisits(records, repeated).collect()
    assert {(int(r.key), r.warc_type, r.refers_to_key, r.salt, r.first_key) for r in out} == {(i, "revisit" if i else "response", "0" if i else None, "a", "b") for i in range(4)}


def test_dates():
    assert warc.iso_date("20240131235959") == "2024-01-31T23:59:59Z"
    assert warc.iso_date("202402") == "2024-02-01T00:00:00Z"
    assert warc.iso_date("20241301") is None and warc.iso_date("x") is None and warc.iso_date("") is None
