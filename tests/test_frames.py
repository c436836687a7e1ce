import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from riskweave.functions import macs
from riskweave.sources import frame_source, readers
from riskweave.sources.frame_source import FrameSource


def frame(text):
    body = text.encode() if isinstance(text, str) else text
    return len(body).to_bytes(4, "little") + body


@pytest.fixture
def source(spark):
    spark.dataSource.register(FrameSource)
    return lambda path, **options: spark.read.format("frames").options(**options).load(str(path))


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 16])
def test_frames_that_pieces_cut(source, tmp_path, chunk):
    texts = ['{"a":1}', "é" * 40, '{"long":"' + "x" * 300 + '"}', "b"]
    (tmp_path / "one").write_bytes(b"".join(map(frame, texts)))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(frame("no"))
    got = source(tmp_path, chunk=chunk).orderBy("offset").collect()
    assert [(r.json, r["size"], r.error) for r in got] == [(t, len(t.encode()), None) for t in texts]
    assert [r.offset for r in got] == [sum(len(frame(t)) for t in texts[:i]) for i in range(4)]


def test_lengths_that_are_wrong_end_their_file(source, tmp_path):
    (tmp_path / "zero").write_bytes(frame("a") + frame("") + frame("b"))
    (tmp_path / "large").write_bytes(frame("c") + (101).to_bytes(4, "little") + b"x" * 101 + frame("d"))
    (tmp_path / "cut").write_bytes(frame("e") + frame("whole")[:-1])
    (tmp_path / "head").write_bytes(frame("f") + b"\x01\x00")
    (tmp_path / "bytes").write_bytes(frame(b"\xff"))
    got = {(r.file.rsplit("/", 1)[1], r.json, r.error) for r in source(tmp_path, cap=100).collect()}
    assert got == {("zero", "a", None), ("zero", None, "empty frame"), ("large", "c", None), ("large", None, "frame over the cap"), ("cut", "e", None), ("cut", None, "file ends inside a frame"), ("head", "f", None), ("head", None, "file ends inside a frame"), ("bytes", "�", None)}


def test_a_stream_waits_for_the_rest_of_a_frame(spark, source, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    whole = b"".join(frame(f'{{"n":{i}}}') for i in range(30))

    def run():
        spark.readStream.format("frames").option("chunk", 7).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted((r.offset, r.json) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a").write_bytes(whole[:100])
    n = len(run())
    assert 0 < n < 30
    (folder / "a").write_bytes(whole)
    (folder / "b").write_bytes(frame("other"))
    got = run()
    assert [j for _, j in got if j != "other"] == [f'{{"n":{i}}}' for i in range(30)] and len(got) == 31


def test_written_frames_come_back(spark, source, tmp_path):
    rng = random.Random(1)
    texts = ["x" * rng.randrange(1, 500) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "j string").repartition(3)
    assert frame_source.write_frames(rows, "j", str(tmp_path / "f")).agg(F.sum("frames")).head()[0] == 200
    assert sorted(r.json for r in source(tmp_path / "f", chunk=100).collect()) == sorted(texts)


def test_published_codes(spark):
    """Cases of RFC 4231: short and long keys, long data."""
    cases = [(b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"), (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"), (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54")]
    rows = spark.createDataFrame([(bytearray(k), bytearray(m), x) for k, m, x in cases], "k binary, m binary, x string")
    assert all(r[0] == r[1] for r in rows.select(F.lower(F.hex(macs.hmac_sha256(F.col("k"), F.col("m")))), "x").collect())


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 200])
def test_codes_against_the_standard_library(spark, size):
    rng = random.Random(size)
    key, message = rng.randbytes(size), rng.randbytes(3 * size)
    row = spark.createDataFrame([(bytearray(key), bytearray(message))], "k binary, m binary")
    assert bytes(row.select(macs.hmac_sha256(F.col("k"), F.col("m"))).head()[0]) == hmac.new(key, message, hashlib.sha256).digest()


def test_request_and_reply(spark):
    rows = spark.createDataFrame([("tok", "00ff", 7, "scan", "é"), ("tok", "", 7, "scan", "x"), ("tok", "0g", 7, "scan", "x"), ("tok", "00ff", -1, None, None)], "s string, n string, i long, k string, c string")
    le = lambda x: (x & 0xFFFFFFFF).to_bytes(4, "little")
    sized = lambda x: le(len(x.encode())) + x.encode()
    code = lambda m: hmac.new(b"tok", m, hashlib.sha256).hexdigest()
    got = [r[0] for r in rows.select(macs.request_mac(*map(F.col, "snikc"))).collect()]
    assert got == [code(b"\0\xff\1" + le(7) + sized("scan") + sized("é")), None, None, code(b"\0\xff\1" + le(-1) + sized("") + sized(""))]
    reply = rows.limit(1).select(*[macs.reply_mac(F.col("s"), F.col("n"), F.col("i"), F.col("k"), F.lit(b).cast("boolean"), F.lit(None), F.lit("e")) for b in (True, False, None)]).head()
    assert list(reply) == [code(b"\0\xff\2" + le(7) + sized("scan") + v + sized("") + sized("e")) for v in (b"\1", b"\0", b"\xff")]


def test_form_texts_in_linear_time():
    import time

    begun = time.time()
    assert readers.form_texts("<textarea>" * 50_000) == ["<textarea>" * 49_999]
    assert readers.form_texts("<input " + "a='b' " * 100_000 + "value=v>") == ["v"]
    for hostile in ("<input " * 50_000, '<input "' * 50_001, "<input a=" * 50_000, "<input '>" * 50_000, "<textarea " + " " * 100_000, "</textarea>" * 50_000):
        readers.form_texts(hostile)
    assert time.time() - begun < 10


def test_forms_that_are_not_closed():
    assert readers.form_texts("<textarea>a<input value=b>") == ["a<input value=b>"]
    assert readers.form_texts("<input value=a><input value='b") == ["a"]
    assert readers.form_texts("<TextArea>\r\nx &amp;amp; y</TEXTAREA><input value=z type='TEXT'>") == ["x &amp; y", "z"]
