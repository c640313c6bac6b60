import base64
import gzip
import hashlib
import io
import random
from datetime import datetime, timezone

import pytest

from graphloom.llm import warc
from graphloom.llm.common import new_folder
from graphloom.llm.warc import LoserTree, _date, merge_index, ranked, read_archives, url_key, write_archives


def test_loser_tree():
    rng = random.Random(1)
    for k in range(10):
        runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_dates():
    for s in (0, 951_782_400, 1_700_000_000, 4_102_444_799):
        assert _date(s).decode() == datetime.fromtimestamp(s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_url_keys():
    assert url_key("HTTP://www.Example.COM:80/a/B?q=1#top") == "com,example)/a/b?q=1"
    assert url_key(None) == url_key("") == "" and url_key("https://u@x.org") == "org,x)/"


PAGES = [(3, "http://b.org/x", "same"), (1, "http://a.org/", "same"), (2, None, None), (5, "http://a.org/", ""), (4, "http://a.org/ä \r\nInjected: 1", "é" * 50_000), (None, "http://z.org", "same"), (9, "u", "WARC/1.1\r\n\r\nnested"), (9, "u", "WARC/1.1\r\n\r\nnested")]


@pytest.mark.parametrize("limit,least", [(64 << 20, 0), (1, 0), (64 << 20, 3)])
def test_archives(spark, limit, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS record_type", "2 AS archive")
    files = new_folder(spark, "test")
    runs = write_archives(pages, files, archive_bytes=limit, least_payload=least)
    rows = read_archives(runs, files).collect()
    first = {}
    for k, _, html in PAGES:
        if k is not None:
            first[html or ""] = min(k, first.get(html or "", k))
    want = []
    for k, _, html in PAGES:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= least else None
        to = None if to == k else to
        want.append((k or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to else "response", to))
    got = [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    order = ranked(merge_index(runs, files)).orderBy("index_rank").collect()
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in order]
    assert keys == sorted(keys) and [r.index_rank for r in order] == list(range(len(PAGES)))


@pytest.mark.parametrize("archive_bytes,most", [(2000, 12), (64 << 20, 0)])
def test_external_merge(spark, archive_bytes, most):
    """Small or long runs of small blocks, merged in several passes and ranges, give one global order of all captures."""
    rng = random.Random(3)
    pages = [(k, rng.choice([None, "http://hot.org/", f"http://h{rng.randrange(40)}.org/{rng.randrange(9)}", "http://a.org/\0b", "http://a.org/"]), f"page {k}") for k in range(700)]
    files = new_folder(spark, "test")
    runs = write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), files, archive_bytes=archive_bytes, block=8)
    assert runs.select("run").distinct().count() > most and runs.count() >= 700 / 8
    got = [merge_index(runs, files, fan_in=fan_in, part=part, block=8) for fan_in, part in ((3, 50), (1000, 10_000))]
    for index in got:
        rows = ranked(index).orderBy("index_rank").collect()
        want = sorted((url_key(u), warc.EPOCH + k, k) for k, u, _ in pages)
        assert [(r.url_key, r.time, r.page_id) for r in rows] == want
    found = {(r.archive, r.offset): r.page_id for r in read_archives(runs, files).collect()}
    assert all(found[r.archive, r.offset] == r.page_id for r in got[0].collect())


def test_sort_key():
    rng = random.Random(4)
    rows = [(rng.choice(["", "a", "a\0", "a\0b", "ab", "é", "a\uffff"]), rng.choice([-5, 0, 7]), rng.choice([None, 0, 3, 1 << 40]), rng.choice(["x", "y"]), rng.randrange(300)) for _ in range(500)]
    plain = lambda r: (r[0].encode(), r[1], -1 if r[2] is None else r[2], *r[3:])
    assert sorted(rows, key=plain) == sorted(rows, key=lambda r: warc.sort_key(*r)) or [plain(r) for r in sorted(rows, key=lambda r: warc.sort_key(*r))] == sorted(map(plain, rows))


def test_records_are_streamed():
    data = [warc.record("response", k, None, 0, hashlib.sha1(b"x" * k).digest(), b"x" * k, None) for k in (0, 5, 200_000, 3_000_000, 1)]
    archive = b"".join(gzip.compress(d) for d in data)
    found = list(warc.records_of(io.BytesIO(archive)))
    assert [len(b.partition(b"\r\n\r\n")[2]) for *_, b in found] == [0, 5, 200_000, 3_000_000, 1]
    assert [at for at, *_ in found] == [sum(len(gzip.compress(d)) for d in data[:k]) for k in range(5)]
    with pytest.raises(ValueError):
        list(warc.records_of(archive[:-5]))


def test_no_pages(spark):
    files = new_folder(spark, "test")
    runs = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), files)
    assert read_archives(runs, files).count() == 0 and ranked(merge_index(runs, files)).count() == 0
