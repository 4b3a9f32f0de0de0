"""Archives: exact round trips, revisits, and merged histories in order."""

import hashlib
import heapq
import os
import random

import pytest

from cityloom.llm import warc
from cityloom.llm.warc import LoserTree, capture_histories, merge_index, parse, read_index, url_key, write_archives

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "page_id long, url string, html string, size string, sha1 string, keep string, body string, run string"
BIG = "é<p>" * 400
ROWS = [(1, "http://www.A.org:80/x?q=1#f", BIG), (2, "http://a.org/x?q=1", BIG), (3, None, BIG), (4, "http://b.org/", "small"),
        (5, "http://b.org/", "small"), (6, "http://b.org/\r\nEvil: 1", None), (7, "not a url", ""), (None, "http://[bad", BIG),
        (8, "http://c.org/" + "p" * 5000, "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" * 30_000), (9, "http://é.org/ü", BIG + "x"), (9, "http://é.org/ü", BIG + "x")]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(30))) for _ in range(k)]
    assert [x[0] for x in LoserTree(runs)] == [x[0] for x in heapq.merge(*runs)]


def test_url_keys():
    assert url_key("http://www.A.org:80/x?q=1#f") == url_key("https://a.org/x?q=1") == "org,a)/x?q=1"
    assert url_key(None) == "" and url_key("http://a.org:8080") == "org,a:8080)/"


def plain(rows):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        keep = best.get(h) if len(p) >= 1000 else None
        again = keep is not None and keep != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def taken(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    pages = spark.createDataFrame([(*r, *"abcde") for r in ROWS], SCHEMA).repartition(2)
    folder = write_archives(pages)
    runs = read_index(spark, folder)
    assert runs.select("run").distinct().count() >= 5
    merged = merge_index(runs)
    assert taken(merged) == plain(ROWS)
    # An entry leads to its record, and the payload is the page's html.
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()}
    html = {i: (h or "").encode() for i, _, h in ROWS}
    for r in merged.collect():
        (_, length, head, payload), = parse(files[r.run][r.at:r.at + r.length])
        assert length == r.length and head["WARC-Type"] == r.record_type
        assert bytes(payload) == (html[r.page_id] if r.record_type == "response" else b"")
    assert taken(capture_histories(pages)) == plain(ROWS)


def test_history_is_in_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 40)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 17}.org/p", f"page {i}") for i in range(700)]
    got = capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    keys = [(r.url_key, r.stamp, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 700


def test_given_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    assert taken(capture_histories(pages)) == plain([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_damage_is_noticed(spark):
    folder = write_archives(spark.createDataFrame([(1, "http://a.org/", "text")], "page_id long, url string, html string"))
    whole = bytes(spark.read.format("binaryFile").load(folder).head().content)
    assert len(list(parse(whole))) == 1
    with pytest.raises(ValueError, match="payload"):
        list(parse(whole.replace(b"text\r\n", b"tent\r\n")))
    with pytest.raises(ValueError, match="end"):
        list(parse(whole[:-2]))


def test_empty_table(spark):
    assert capture_histories(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_page_id_and_time_zone(spark):
    """Ids of any size have a stamp of four-digit year, the same in every session."""
    ids = [0, 1, 10**13, 3 * 10**11, -5, (1 << 63) - 1, -(1 << 63)]
    pages = spark.createDataFrame([(i, "http://a.org/", "x") for i in ids], "page_id long, url string, html string")
    stamps = {}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            stamps[name] = [(r.page_id, r.stamp) for r in capture_histories(pages).select("page_id", "stamp").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert stamps["UTC"] == stamps["Asia/Tokyo"] and len(stamps["UTC"]) == len(ids)
    assert all(len(s) == 20 and s[4] == "-" and s.endswith("Z") for _, s in stamps["UTC"])
    assert dict(stamps["UTC"])[1] == "2023-11-14T22:13:21Z"
    assert [s for _, s in stamps["UTC"]] == sorted(s for _, s in stamps["UTC"])
