import hashlib

import pytest

from recollect.llm import shared
from recollect.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, original int"
BIG = "<p>é</p>" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.example/x?y#z", BIG), (2, "https://b.example", BIG), (3, "odd\r\nurl", BIG), (3, "odd\r\nurl", BIG), (4, None, "small"), (5, "http://a.example/", "small"),
        (6, "http://a.example/", None), (7, "http://a.example/", ""), (None, "http://a.example/", BIG), (8, "http://c.example", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 60), (9, "u", "z" * 300_000),
    ]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


def test_round_trip(spark, pages):
    folder = shared.own_folder(spark, "warc-test")
    W.write_archives(pages.select("page_id", "url", "html"), folder, file_bytes=4_000)
    rows = W.assemble(W.read_records(spark, folder)).collect()
    assert len(rows) == pages.count()
    by_page = {}
    for r in rows:
        assert r.request.warc_type == "request" and r.metadata.warc_type == "metadata"
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.capture.record_id
        by_page.setdefault(bytes(r.metadata.block).decode().split(":")[1].strip(), []).append(r.capture)
    html = {str(r.page_id if r.page_id is not None else ""): (r.html or "").encode() for r in pages.collect()}
    for page, captures in by_page.items():
        for c in captures:
            if c.warc_type == "response":
                assert bytes(c.block).split(b"\r\n\r\n", 1)[1] == html[page]
                assert c.payload_digest == c.named_digest == hashlib.sha1(html[page]).hexdigest()
    kinds = {p: sorted(c.warc_type for c in cs) for p, cs in by_page.items()}
    assert kinds["1"] == kinds["2"] == ["revisit"] and kinds["3"] == ["response"] * 2
    assert kinds["4"] == kinds["5"] == kinds["6"] == kinds["7"] == kinds[""] == ["response"]
    assert by_page["1"][0].refers_to in {c.record_id for c in by_page["3"]}
    assert len({r.capture.record_id for r in rows}) == len(rows)


def test_concurrent_in_either_direction(spark):
    make = lambda i, kind, c=None: (i, kind, "u", "d", c, None, None, None, None, None)
    records = [make("c1", "response"), make("q1", "request", "c1"), make("m1", "metadata", "q1"), make("c2", "response", "q2"), make("q2", "request"), make("c3", "revisit"), make("q9", "request", "nothing"), make("i", "warcinfo")]
    found = {r.capture.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in W.assemble(spark.createDataFrame(records, W.RECORDS_SQL)).collect()}
    assert found == {"c1": ("q1", "m1"), "c2": ("q2", None), "c3": (None, None)}


def test_empty_table(spark, pages):
    folder = shared.own_folder(spark, "warc-empty")
    W.write_archives(pages.select("page_id", "url", "html").limit(0), folder)
    assert W.assemble(W.read_records(spark, folder)).count() == 0


def test_broken_archive_is_refused():
    with pytest.raises(ValueError):
        list(W.parse(b"not a record", True))


def test_very_large_pages_have_files_of_their_own(spark):
    """A file never holds more than one page of over 16 times the mean size."""
    rows = [(i, f"http://a.example/{i}", "x" * (1_000_000 if i in (5, 6) else 50) + str(i)) for i in range(2_000)]
    folder = shared.own_folder(spark, "warc-large")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    W.write_archives(pages, folder, file_bytes=100_000)
    records = W.read_records(spark, folder).count()
    assert records == 6_000
    sizes = [sum(len(r[9] or b"") for r in W.parse(bytes(x.content), True)) for x in spark.read.format("binaryFile").load(folder).collect()]
    assert sum(s > 1_000_000 for s in sizes) == 2 and max(sizes) < 1_010_000
