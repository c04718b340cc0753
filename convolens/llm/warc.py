"""WARC archives compressed by Zstandard with a shared dictionary, one frame a record.

An archive file starts with a skippable frame that holds the dictionary, trained on a bounded sample of
payloads. Each record is a frame of its own. Spark's text writer writes the files, so they can lie in any
store that Spark reaches; the line separator it sets after a row is an empty skippable frame, which
every Zstandard reader passes over. Reading takes whole files (Spark's limit is 2 GB each), loads the dictionary
from the leading frame, whether it lies there plain or compressed, decodes frame by frame, and checks headers,
lengths and digests of each record.

Archives of other writers are read as well: versions 1.0 and 1.1, all record types, digests of the payload or block
by SHA-256, SHA-1 or MD5, in hex or base32. Records that are no pages of this writer have a null page_id and their
headers in ``headers``. The payload of records other than http messages is their block; ``payload_digest`` is the
SHA-256 of the payload, for revisits as far as their header tells it.

Of records with equal payloads of at least ``min_bytes``, that of the smallest page is a response and
the others are revisits that name it; their own payload is left out, its length and digest are kept.

Defined cases: a null html counts as empty; rows that agree in page and payload are each a response; a
null page comes after all others and is nobody's smallest unless alone; a null url has no target line.
Extra columns are ignored, an empty table gives an empty result. A record that fails a check is reported
in ``error`` and does not stop the reading of those after it.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolens.llm.text import bounded_batches, hashed_sample, whole
from convolens.scale import keep, shared_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = "WARC/1.1"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
RECORD_TYPES = "warcinfo response resource request metadata revisit conversion continuation".split()
# By number of bytes.
DIGESTS = {"sha256": 32, "sha1": 20, "md5": 16}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

MIN_BYTES = 100
SAMPLE_RECORDS = 1024
SAMPLE_BYTES = 4096
DICTIONARY_BYTES = 16 * 1024
FILE_BYTES = 32 * 1024 * 1024
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
STEP = 1 << 16


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the beginnings of at most ``records`` payloads, chosen by a hash of the page."""
    chosen = hashed_sample(pages, "page_id", records)
    # At most ``records`` ids, and one payload of each.
    sample = (
        pages.select("page_id", F.substring(whole("html"), 1, SAMPLE_BYTES).cast("binary").alias("head"))
        .where(F.octet_length("head") >= 8).join(F.broadcast(chosen), "page_id")
        .groupBy("page_id").agg(F.min("head").alias("head")).orderBy("page_id"))
    heads = [bytes(row["head"]) for row in sample.collect()]
    try:
        return zstandard.train_dictionary(size, heads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # Too little to train on: the sample itself serves as raw content.
        return b"".join(heads)[:size]


def with_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, response (the page that a revisit refers to, else null), row."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole("html").cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only digests that repeat travel; the payloads do not.
    groups = keep(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "payload", F.lower(F.hex("digest")).alias("digest"),
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("response"), "row")


def record_bytes(page_id, url, payload: bytes, digest: str, response) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if response is not None:
        lines += [f"WARC-Refers-To: <urn:page:{response}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Write one record a page to .warc.zst files of about ``file_bytes`` of payload each."""
    dictionary = train_dictionary(pages)
    total = pages.agg(F.sum(F.octet_length(whole("html")))).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))

    def run(batches):
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        started = False
        for batch in batches:
            frames = [compressor.compress(record_bytes(*row)) for row in zip(*(c.to_pylist() for c in batch.columns))]
            if frames and not started:
                frames.insert(0, dictionary_frame(dictionary))
                started = True
            yield pa.RecordBatch.from_pydict({"frame": pa.array(frames, pa.binary())})

    bounded_batches(pages.sparkSession)
    # By row number, so that pages of one id and address, or of none, spread over the files like any other.
    rows = with_records(pages, min_bytes).repartition(files, "row")
    rows.drop("row").mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option(
        "lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def plain_dictionary(content: bytes) -> bytes:
    """A dictionary as it is, out of a frame that may be compressed itself."""
    if not content.startswith(FRAME_MAGIC):
        return content
    return zstandard.ZstdDecompressor().decompressobj().decompress(content)


def frames(data):
    """The dictionary of the leading skippable frame, then the content of each frame."""
    data, at, known = memoryview(data), 0, None
    while at + 8 <= len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and at == 0 and size:
                known = zstandard.ZstdCompressionDict(plain_dictionary(bytes(data[8:8 + size])))
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        out = []
        while not decoder.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = data[at:at + STEP]
            out.append(decoder.decompress(piece))
            at += len(piece) - len(decoder.unused_data)
        yield b"".join(out)
    if at != len(data):
        raise ValueError("bytes after the last frame")


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header fields of a record by name in lower case; a line that begins with white space goes on with the one before."""
    out, last = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.decode("utf-8").strip()
            continue
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line without a name: {line[:60]!r}")
        last = name.lower()
        out[last] = value.strip()
    return out


def _http_headers(lines: list[bytes]) -> dict[str, str]:
    """Header fields of a message, which comes from any server: what is no field is passed over."""
    fields = (line.decode("latin-1").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in fields if colon}


def _page(value: str):
    """The page of a record id of this writer; null for other ids."""
    if not re.fullmatch(r"<[^<>\s]+>", value):
        raise ValueError(f"record id {value!r}")
    found = re.fullmatch(r"<urn:page:(-?\d+|None)>", value)
    return None if not found or found[1] == "None" else int(found[1])


def _digest(value: str):
    """(algorithm, digest) of a header field, or None where the algorithm is not known."""
    name, colon, text = value.partition(":")
    size = DIGESTS.get(name.lower().replace("-", ""))
    if not colon or not text:
        raise ValueError(f"digest {value!r}")
    if size is None:
        return None
    try:
        digest = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        raise ValueError(f"digest {value!r}") from None
    if len(digest) != size:
        raise ValueError(f"digest {value!r}")
    return name.lower().replace("-", ""), digest


def _joined_chunks(body: bytes) -> bytes | None:
    """The content of a body sent in chunks; None if it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        found = re.match(rb"\s*([0-9A-Fa-f]+)", body[at:end]) if end >= 0 else None
        if not found:
            return None
        size, at = int(found[1], 16), end + 2
        if not size:
            return b"".join(out)
        out.append(body[at:at + size])
        at += size + 2
        if at > len(body):
            return None


def _agrees(told, *contents: bytes | None) -> bool:
    return told is None or any(c is not None and hashlib.new(told[0], c).digest() == told[1] for c in contents)


def parse_record(record: bytes) -> dict:
    """The fields of a record; ValueError if a header, a length or a digest is wrong."""
    head, end, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not end or version not in VERSIONS:
        raise ValueError("no header of a known version")
    headers = _headers(lines)
    if missing := [name for name in REQUIRED if name not in headers]:
        raise ValueError(f"missing {', '.join(missing)}")
    if int(headers["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block is not as long as its header says")
    kind, block = headers["warc-type"].lower(), rest[:-4]
    if kind not in RECORD_TYPES:
        raise ValueError(f"record type {kind!r}")
    if "warc-block-digest" in headers and not _agrees(_digest(headers["warc-block-digest"]), block):
        raise ValueError("the block does not fit its digest")
    payload, size, sent = block, None, None
    if headers.get("content-type", "").lower().startswith("application/http") and (block or kind != "revisit"):
        http, end, payload = block.partition(b"\r\n\r\n")
        status, *lines = http.split(b"\r\n")
        if not end or b"HTTP/" not in status:
            raise ValueError("no header of a message")
        told = _http_headers(lines)
        if told.get("transfer-encoding", "").lower() == "chunked":
            sent = _joined_chunks(payload)
        elif re.fullmatch(r"\d+", told.get("content-length", "")):
            size = int(told["content-length"])
    told = _digest(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None
    fields = {"page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind,
              "headers": headers, "error": None}
    if kind == "revisit":
        if payload or "warc-profile" not in headers:
            raise ValueError("a revisit with a payload or without a profile")
        return fields | {
            "payload_bytes": size, "payload_digest": told[1].hex() if told and told[0] == "sha256" else None, "payload": None,
            "refers_to": _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None}
    if "warc-truncated" not in headers:
        # Further segments of a record hold the rest of its payload.
        whole_here = "warc-segment-number" not in headers
        if kind == "response" and size not in (None, len(payload)) and whole_here:
            raise ValueError("the payload is not as long as its header says")
        if whole_here and not _agrees(told, payload, sent):
            raise ValueError("the payload does not fit its digest")
    payload = payload if sent is None else sent
    return fields | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "refers_to": None,
                     "payload": payload}


FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
          "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "error": pa.string(),
          "headers": pa.map_(pa.string(), pa.string())}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, with_headers: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, error, headers."""
    left_out = ["payload"] * (not with_payload) + ["headers"] * (not with_headers)
    fields = {n: t for n, t in FIELDS.items() if n not in left_out}
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, " + "payload binary, " * with_payload + "error string"
              + ", headers map<string, string>" * with_headers)

    def batch_of(rows):
        return pa.RecordBatch.from_pydict({n: pa.array(
            [list(r[n].items()) if n == "headers" and r.get(n) else r.get(n) for r in rows], t) for n, t in fields.items()})

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                try:
                    for record in frames(data):
                        try:
                            rows.append(parse_record(record))
                        except (ValueError, KeyError) as problem:
                            rows.append({"error": str(problem)})
                        size += len(record)
                        if size > FILE_BYTES // 4:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as problem:
                    rows.append({"error": str(problem)})
                yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages as archives and read the records back."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, with_payload=False)
