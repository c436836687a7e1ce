import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from riskweave.llm import warc

PAGES = "page_id long, url string, html string, at string, payload string"


def archive(pages, tmp_path, min_bytes=0, file_bytes=3000):
    found = warc.captures(pages, "page_id", "url", "html", F.col("at"), min_bytes)
    return warc.write_archive(found, str(tmp_path / "warc"), file_bytes)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(300):
        host = rng.choice(["Example.com", "a.example.com", "example.net:80"])
        url = f"http://{host}/{'hot' if i % 3 == 0 else i % 17}?q={'' if i % 3 == 0 else i % 2}"
        out.append((i, url, rng.choice(["", "copy", f"<p>é {i} " + "x" * (i % 50)]), f"20{i % 20:02d}-01-01T00:00:00Z", "clash"))
    out += [(None, None, None, None, None), (None, "no scheme", "alone", None, None), (-5, "http://h/a b\nc", "copy", "2001-01-01T00:00:00Z", ""), (400, "x://", "big " * 5000, "2001-01-01T00:00:00Z", ""), (299, "http://h/again", "twice", "2002-01-01T00:00:00Z", ""), (299, "http://h/again", "twice", "2002-01-01T00:00:00Z", "")]
    return out


def key(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    if "://" not in low:
        return low
    rest = low.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:cut].split("."))) + ")" + rest[cut:]


def told(rows, min_bytes):
    most = {}
    for i, _, html, *_ in rows:
        if i is not None:
            most[html or ""] = max(most.get(html or "", i), i)
    for i, url, html, at, _ in rows:
        body = (html or "").encode()
        last = most.get(html or "") if len(body) >= min_bytes else None
        refers = last if last is not None and (i is None or i < last) else None
        yield i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers, key(url), at or "1970-01-01T00:00:00Z"


@pytest.mark.parametrize("min_bytes, fan, range_rows", [(0, 64, 1_000_000), (5, 2, 40)])
def test_archive_and_merged_index(spark, tmp_path, rows, min_bytes, fan, range_rows):
    runs, folder = archive(spark.createDataFrame(rows, PAGES).repartition(5), tmp_path, min_bytes)
    assert runs.count() > 5
    index = warc.merged_index(runs, folder, fan, range_rows)
    got = warc.read_archive(index, folder, payload=True).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, len(rows) + 1))
    order = [(r.url_key, r.captured, r.id is not None, r.id or 0) for r in got]
    assert order == sorted(order)
    seen = {}
    for r in got:
        seen[r.url_key] = seen.get(r.url_key, 0) + 1
        assert r.capture == seen[r.url_key]
        assert (r.payload is None) == (r.type == "revisit")
        assert r.payload is None or len(r.payload) == r.payload_bytes
    assert sorted(map(str, told(rows, min_bytes))) == sorted(str((r.id, r.payload_bytes, r.digest, r.type, r.refers_to, r.url_key, r.captured)) for r in got)


def test_files_are_gzip_members_of_bounded_size(spark, tmp_path, rows):
    _, folder = archive(spark.createDataFrame(rows, PAGES).repartition(2), tmp_path)
    files = sorted((tmp_path / "warc").glob("*.warc.gz"))
    assert len(files) > 4
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(rows) + len(files)
    assert b"WARC-Target-URI: http://h/a%20b%0Ac\r\n" in whole


def test_empty_table(spark, tmp_path, rows):
    runs, folder = archive(spark.createDataFrame([], PAGES), tmp_path)
    index = warc.merged_index(runs, folder)
    assert warc.read_archive(index, folder).count() == 0


def test_damage_is_found(spark, tmp_path, rows):
    member = warc.capture_record(1, "http://h/", "2001-01-01T00:00:00Z", b"payload", None)
    assert warc.parsed(member)["payload"] == b"payload"
    broken = gzip.compress(gzip.decompress(member).replace(b"payload\r\n", b"payloaX\r\n"))
    with pytest.raises(ValueError):
        warc.parsed(broken)


@pytest.mark.parametrize("k", range(1, 9))
def test_loser_tree(k):
    rng = random.Random(k)
    streams = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(12))) for i in range(k)]
    assert list(warc.LoserTree([iter(s) for s in streams])) == sorted(x for s in streams for x in s)
    assert list(warc.LoserTree([])) == []
