import base64
import hashlib

import pytest
import zstandard

from convolens.llm import warc
from convolens.scale import shared_path

BIG = "ä" * 60


def pages(spark):
    rows = [(5, "http://a/x", BIG), (3, None, BIG), (9, "http://a/\r\ny", BIG), (1, "u", None), (2, "u", ""), (4, "u", "short"),
            (6, "u", "short"), (7, "u", "z" * 3_000_000), (None, "u", BIG), (8, "u", "only"), (8, "u", "only"), (10, "é", "q" * 100)]
    return rows, spark.createDataFrame([(*r, "e", 1) for r in rows], "page_id long, url string, html string, payload string, n int")


def expected(rows):
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= 100 and page != first
        out.append((page, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), len(data),
                    hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("file_bytes", [1 << 25, 1000])
def test_round_trip(spark, file_bytes):
    rows, frame = pages(spark)
    path = shared_path(spark, "test-warc")
    warc.write_archives(frame, path, file_bytes=file_bytes)
    got = warc.read_archives(spark, path)
    assert sorted((tuple(r) for r in got.drop("payload").collect()), key=str) == expected(rows)
    payloads = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert payloads[7] == b"z" * 3_000_000 and payloads[3] == BIG.encode() and payloads[1] == b""


def test_empty(spark):
    _, frame = pages(spark)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_files_are_plain_zstandard(spark):
    _, frame = pages(spark)
    path = shared_path(spark, "test-warc")
    warc.write_archives(frame, path)
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        content = bytes(content)
        assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(content[4:8], "little")
        whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8:8 + size])).stream_reader(
            content, read_across_frames=True).read()
        assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") == len(list(warc.frames(content)))


def test_broken_records():
    good = warc.record_bytes(1, "u", b"data", hashlib.sha256(b"data").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"data"
    for bad in (b"", good[:-1], good.replace(b"data", b"dAta"), good.replace(b"WARC/1.1", b"WARC/9"), good + b"x",
                good.replace(b"WARC-Date", b"Date"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises((ValueError, KeyError)):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    for bad in (frame[:-3], frame + b"xx"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(bad))


def foreign(kind, block, version="WARC/1.0", **fields):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1f>", "WARC-Date": "2020-01-01T00:00:00Z"} | {
        n.replace("_", "-"): v for n, v in fields.items()} | {"Content-Length": str(len(block))}
    return "\r\n".join([version, *(f"{n}: {v}" for n, v in fields.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_records():
    def sha1(data):
        return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()

    http = {"Content_Type": "application/http; msgtype=response"}
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nno field\r\nX: \xff\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b"4;x=1\r\nabcd\r\n2\r\nef\r\n0\r\n\r\n"
    info = warc.parse_record(foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"))
    assert (info["record_type"], info["page_id"], info["payload"]) == ("warcinfo", None, b"software: x\r\n")
    for kind in ("resource", "metadata", "conversion", "continuation"):
        assert warc.parse_record(foreign(kind, b"data", "WARC/1.1", WARC_Block_Digest=sha1(b"data")))["payload_bytes"] == 4
    got = warc.parse_record(foreign("response", head + b"data", WARC_Payload_Digest=sha1(b"data"), **http))
    assert (got["payload"], got["payload_digest"]) == (b"data", hashlib.sha256(b"data").hexdigest())
    assert got["headers"]["warc-record-id"] == "<urn:uuid:1f>"
    for digest in (sha1(body), sha1(b"abcdef"), "md5:" + hashlib.md5(b"abcdef").hexdigest(), "xxh:12"):
        got = warc.parse_record(foreign("response", chunked + body, WARC_Payload_Digest=digest, **http))
        assert got["payload"] == b"abcdef" and got["payload_bytes"] == 6
    got = warc.parse_record(foreign("request", b"GET / HTTP/1.0\r\nHost: x\r\n\r\n", Content_Type="application/http; msgtype=request"))
    assert got["payload"] == b""
    for block in (b"", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"):
        got = warc.parse_record(foreign("revisit", block, WARC_Profile="p", WARC_Payload_Digest=sha1(b"data"), **http))
        assert (got["payload_bytes"], got["payload_digest"], got["refers_to"]) == (9 if block else None, None, None)
    cut = head.replace(b"no field", b"Content-Length: 9")
    assert warc.parse_record(foreign("response", cut + b"data", WARC_Truncated="length", **http))["payload"] == b"data"
    folded = foreign("resource", b"x", WARC_Target_URI="http://a/\r\n\tb")
    assert warc.parse_record(folded)["url"] == "http://a/ b"
    for bad in (foreign("response", cut + b"data", **http), foreign("other", b""), foreign("revisit", b""), foreign("response", b"x", **http),
                foreign("resource", b"x", WARC_Payload_Digest=sha1(b"y")), foreign("resource", b"x", WARC_Block_Digest=sha1(b"y")),
                foreign("resource", b"x", WARC_Block_Digest="sha1:zz!"), foreign("resource", b"x", WARC_Block_Digest="sha1:ABCD"),
                foreign("resource", b"x", WARC_Payload_Digest="sha1"), foreign("resource", b"x", WARC_Record_ID="1f")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_compressed_dictionary(spark):
    records = [foreign("resource", f"some text number {i} of the archive".encode() * 9, WARC_Target_URI=f"http://a/{i}") for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, records)
    compressor = zstandard.ZstdCompressor(dict_data=dictionary)
    frames = b"".join(map(compressor.compress, records))
    for kept in (dictionary.as_bytes(), zstandard.ZstdCompressor().compress(dictionary.as_bytes())):
        assert list(warc.frames(warc.dictionary_frame(kept) + frames)) == records
    path = shared_path(spark, "test-warc")
    data = warc.dictionary_frame(zstandard.ZstdCompressor().compress(dictionary.as_bytes())) + frames
    spark.createDataFrame([(data,)], "value binary").selectExpr("cast(value as string) AS value").write.option(
        "lineSep", warc.EMPTY_FRAME).text(path)
    rows = warc.read_archives(spark, path, with_headers=True).collect()
    assert len(rows) == 300 and all(r.error is None and r.headers["warc-type"] == "resource" for r in rows)
    assert {r.url for r in rows} == {f"http://a/{i}" for i in range(300)}


def test_files_are_even_for_repeated_pages(spark):
    rows = [(None if i % 2 else 7, None, str(i) * 200) for i in range(4000)]
    path = shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path, file_bytes=300_000)
    sizes = [len(list(warc.frames(bytes(r.content)))) for r in spark.read.format("binaryFile").load(path).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / len(sizes)


def test_broken_file_is_reported(spark):
    path = shared_path(spark, "test-warc")
    spark.createDataFrame([("this is no archive",)], "value string").write.text(path)
    assert [r.error is not None for r in warc.read_archives(spark, path).collect()] == [True]
