"""Archives: header lines, conversion, reading back; the query against SQL."""

import io

import pytest

from barloom.llm import warc
from barloom.llm.common import shared_files

from .helpers import matches_sql


def test_query_matches_sql(spark):
    matches_sql(spark, "op1_warc_archives")


def test_header_lines_of_both_versions():
    for version, n in ((1, 5), (2, 10)):
        line = warc.header_line(version, "http://x/a b\n", "20200102030405", "text/html", 7)
        fields = warc.parse_header(line, version)
        assert len(fields) == n and fields["URL"] == "http://x/a%20b%0A" and fields["Archive-length"] == "7"
        with pytest.raises(ValueError):
            warc.parse_header(line, 3 - version)
    with pytest.raises(ValueError):
        warc.parse_header(b"u i d t -\n", 1)
    assert warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z" and warc.warc_date("2020") == "2020-01-01T00:00:00Z"
    assert warc.warc_date("") == warc.warc_date("x") == "0001-01-01T00:00:00Z"


def test_payloads_survive_the_way(spark):
    long = "ä<p>\r\n\r\nWARC/1.0\r\n" * 40_000
    rows = [(1, "http://a", "x"), (5, "http://b c", "x"), (3, None, "x"), (4, "", None), (7, "u", ""), (8, "u", long), (None, "n", "y"), (9, "m", "y"), (9, "m", "y"), (10, "z", "HTTP/1.1\r\n\r\nq")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS path")
    archives = warc.write_arc(pages, shared_files(spark, "arc"))
    records = warc.scan_arc(archives).collect()
    assert sorted(r.size for r in records) == sorted(len((h or "").encode()) for _, _, h in rows)
    chosen = warc.choose(warc.scan_arc(archives))
    found = warc.read_warc(warc.convert(chosen, shared_files(spark, "warc")), with_payload=True).collect()
    by = {}
    for r in found:
        by.setdefault(r.key, []).append(r)
        assert r.date == "2024-01-01T00:00:00Z"
    assert by[5][0].type == "response" and by[5][0].payload == b"x" and by[5][0].uri == "http://b%20c"
    assert by[1][0].type == by[3][0].type == "revisit" and by[1][0].refers == by[5][0].id and by[3][0].uri is None
    assert by[7][0].type == "response" and by[4][0].refers == by[7][0].id and by[4][0].payload_bytes == 0
    assert by[8][0].payload == long.encode() and by[10][0].payload == b"HTTP/1.1\r\n\r\nq"
    assert by[None][0].type == "revisit" and sorted(r.type for r in by[9]) == ["response", "revisit"]
    plain = warc.archive_pages(pages, least=10)
    assert {r.record_type for r in plain.filter("payload_bytes < 10").collect()} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_damage_is_noticed():
    record = warc.warc_record("response", [("WARC-Record-ID", "<a>")], b"block")
    assert warc.parse_warc(record)[1] == b"block"
    for bad in (record[:-6], b"x" + record):
        with pytest.raises(ValueError):
            warc.parse_warc(bad)
    import gzip

    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(gzip.compress(warc.version_block(1, "n", "2020"))[:-9])))
