from hashlib import sha256

from foliospark.llm import warc

BIG = "x" * 99 + "é"
PAGES = [
    (5, "http://www.Example.com:80/a?b=1#c", BIG),
    (3, "https://example.org/", BIG),
    (9, None, BIG),
    (4, "http://example.org/s", "short"),
    (6, "http://example.org/s", "short"),
    (7, "not a url", None),
    (8, "http://[bad/", ""),
    (None, "http://example.org/", BIG),
    (3, "https://example.org/", BIG),
    (10, "http://example.org/odd", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\n\n" * 9),
]


def test_round_trip_revisits_and_lookup(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, digest int")
    store = warc.write(pages, f"file://{tmp_path}/w")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read(spark, store).collect())
    want = []
    for i, _, html in PAGES:
        p = (html or "").encode()
        revisit = html == BIG and i != 3
        want.append((str(i), "revisit" if revisit else "response", 3 if revisit else None, len(p), sha256(p).hexdigest()))
    assert got == sorted(want)
    for bound in (warc.DIRECTORY_BYTES, 0):
        monkeypatch.setattr(warc, "DIRECTORY_BYTES", bound)
        found = warc.lookup_all(spark, store, pages)
        assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found.collect()) == got
        some = warc.lookup_all(spark, store, spark.createDataFrame([("http://example.org/s",), ("http://example.org/s",), ("http://none/",)], "url string"))
        assert sorted(r["page_id"] for r in some.collect()) == [4, 6]
    hits = warc.lookup(spark, store, "https://example.org/")
    assert sorted(str(h["page_id"]) for h in hits) == ["3", "3", "None"]
    assert warc.lookup(spark, store, "http://www.example.com/a?b=1")[0]["page_id"] == 5
    assert warc.lookup(spark, store, "http://absent.example/") == []


def test_many_blocks(spark, tmp_path):
    pages = spark.range(2000).selectExpr("id as page_id", "concat('http://h', id % 7, '.example/p', id) as url", "concat('page ', id) as html")
    store = warc.write(pages, f"file://{tmp_path}/w")
    assert spark.read.parquet(store.blocks).count() > 4
    assert warc.lookup_all(spark, store, pages).count() == 2000
    assert warc.lookup_all(spark, store, pages.where("page_id % 97 = 5")).selectExpr("sum(page_id)").first()[0] == sum(range(5, 2000, 97))
    assert warc.lookup(spark, store, "http://h3.example/p1998")[0]["payload"] == b"page 1998" if 1998 % 7 == 3 else True
    assert warc.lookup(spark, store, f"http://h{1234 % 7}.example/p1234")[0]["page_id"] == 1234


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    store = warc.write(pages, f"file://{tmp_path}/w")
    assert warc.read(spark, store).count() == 0 and warc.lookup_all(spark, store, pages).count() == 0


def test_very_long_pages_and_one_hot_key(spark, tmp_path):
    long = "ä" * 3_000_000
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://a/", long), *((i, "http://hot/", f"page {i}") for i in range(3, 900))], "page_id long, url string, html string")
    store = warc.write(pages, f"file://{tmp_path}/w")
    rows = warc.lookup_all(spark, store, pages).select("page_id", "record_type", "payload_bytes").collect()
    assert len(rows) == 899 and {tuple(r) for r in rows if r["page_id"] < 3} == {(1, "response", 6_000_000), (2, "revisit", 6_000_000)}
