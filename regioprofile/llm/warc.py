"""WARC archives of zstandard frames: one frame for each record, the dictionary in a leading skippable frame.

Archives are written by Spark's own text writer, so that they go to any store with its commit protocol, and a lost task
leaves nothing behind. That writer ends each row in a line break; each frame is therefore followed by the head of a
skippable frame of one byte, whose byte the line break is. Every reader of zstandard streams skips it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share

#: Magic numbers of frames (RFC 8878; 0x184D2A5D holds a dictionary in WARC files).
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_FILLER = struct.pack("<II", SKIPPABLE, 1)  # its one byte is the line break that Spark writes
#: Pages sampled for the dictionary, the largest page that takes part, and the dictionary's size.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 300, 32_768, 32_768
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
RECORD = "urn:page:"
SCHEMA = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """A response record, or a revisit record without payload if it refers to another."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for x in lines:
        if x[:1] in (" ", "\t") and name:
            out[name] += " " + x.strip()
            continue
        name, colon, value = x.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"no header field: {x[:40]!r}")
        out.setdefault(name, value.strip())
    return out


def _digest_holds(stated: str, payload: bytes) -> bool:
    """Whether a labelled digest (base32 or hexadecimal) is the payload's; an algorithm that isn't known here passes."""
    kind, _, value = stated.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(kind, payload)
    return value.upper().rstrip("=") in (base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper())


def parsed(data: bytes) -> tuple[dict[str, str | None], bytes]:
    """Header fields by lower-case name and payload of a record, after validation of its version, fields and lengths.

    Of responses and revisits come, too, `payload_bytes` and `payload_digest` (bare SHA-1 in base32): of a response those
    of its payload, which must be as long as its HTTP head says, if that says it, and have the stated digest, if there
    is one; of a revisit what its heads state, else None. A block without an HTTP head is a payload as a whole; a payload
    under a transfer encoding is kept as sent and not held against length and digest, as writers differ there.
    """
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0].strip() not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers: dict[str, str | None] = {**_fields(lines[1:])}
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ValueError(f"record without {needed}")
    if not headers["content-length"].isdigit():
        raise ValueError(f"Content-Length {headers['content-length']!r} is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} of {headers['warc-record-id']} doesn't hold")
    kind, block = headers["warc-type"], rest[:length]
    if kind not in ("response", "revisit"):
        return headers, block
    inner: dict[str, str] = {}
    payload = block if kind == "response" else b""
    if block.startswith(b"HTTP/"):
        http, found, after = block.partition(b"\r\n\r\n")
        inner = _fields(http.decode("latin-1").rstrip("\r\n").split("\r\n")[1:])
        payload = after
    stated, said = headers.get("warc-payload-digest"), inner.get("content-length", "")
    if kind == "revisit":
        headers["payload_bytes"] = said if said.isdigit() else None
        headers["payload_digest"] = stated[5:] if stated and stated.lower().startswith("sha1:") else None
        return headers, payload
    if "transfer-encoding" not in inner:
        if said.isdigit() and len(payload) != int(said) or stated and not _digest_holds(stated, payload):
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't match its length and digest")
    headers["payload_bytes"], headers["payload_digest"] = str(len(payload)), digest(payload)
    return headers, payload


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame at `at` ends, by its header and the headers of its blocks (RFC 8878)."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        p = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            block = data[p] | data[p + 1] << 8 | data[p + 2] << 16
            p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                return p + 4 * (flags >> 2 & 1)
    except IndexError:
        raise ValueError("the archive ends within a frame") from None


def frames(data: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive, whether they state their size or not; its dictionary is taken from the
    leading skippable frame."""
    view, at, held = memoryview(data), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("the archive ends within a frame's head")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == SKIPPABLE >> 4:
            if magic == DICTIONARY and at == 0:
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                held = zstandard.ZstdCompressionDict(content)
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(view, at)
            if end > len(data):
                raise ValueError("the archive ends within a frame")
            one = (zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()).decompressobj()
            out = one.decompress(view[at:end])
            if not one.eof:
                raise ValueError(f"the frame at byte {at} doesn't end")
            yield out
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")
    if at != len(data):
        raise ValueError("the archive ends within a skippable frame")


def train_dictionary(pages: DataFrame, html: str, n: int) -> bytes:
    """A dictionary from a bounded sample of the n pages; empty if they are too few or too alike to train one."""
    small = pages.filter(F.octet_length(html).between(1, SAMPLE_BYTES))
    drawn = small.select(html, hash_share(F.col(html), 3).alias("_share")).filter(F.col("_share") < 2 * SAMPLE_PAGES / max(1, n))
    sample = [r[0].encode("utf-8", "surrogatepass") for r in drawn.orderBy("_share", html).limit(SAMPLE_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> None:
    """Writes a record for every row of pages to archives under path.

    Of the pages with equal payloads of at least least_bytes, those with the smallest id are responses and those of other
    ids, null ones too, revisit it; without any id all are responses. Rows that repeat an id are each written, as what
    their own payload makes them. A null html is an empty payload, payloads may be of any length, and an empty table gives
    archives without records. Other columns are left out, whatever their names.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # only ids and digests take part in the search for equal payloads; the payloads are shuffled once, by both
    sums = base.filter(F.octet_length("html") >= least_bytes).select("page_id", "sha1")
    first = sums.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("m")).filter("m > 1 and first is not null").select("sha1", "first")
    again = sums.join(first, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again_id"), F.col("sha1").alias("again_sha1"), F.col("first").alias("refers_to")).distinct()
    sent = pages.sparkSession.sparkContext.broadcast(train_dictionary(base, "html", base.count()))
    # an archive for each partition of the join; its adaptive partitions have an even size
    together = base.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha1") == F.col("again_sha1")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = sent.value
        held = zstandard.ZstdCompressionDict(content) if content else None
        if held:
            held.precompute_compress(level=LEVEL)
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY, len(content)) + content + _FILLER], pa.binary())], ["value"])
        with_dict = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True)
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % DATE.encode()
        yield pa.RecordBatch.from_arrays([pa.array([with_dict.compress(info) + _FILLER], pa.binary())], ["value"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*(batch.column(c).slice(at, 256).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
                out = [with_dict.compress(record(i, u, h.encode("utf-8", "surrogatepass"), to)) + _FILLER for i, u, h, to in rows]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    together.mapInArrow(pack, "value binary").select(F.col("value").cast("string")).write.text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each response or revisit record of the archives under path; malformed archives raise an error.

    Records of other types are validated and left out. page_id and refers_to are the record ids, without this writer's
    prefix. Size and digest of a revisit are those that it states, null if it doesn't. Archives are read whole by tasks, one at a time; they are as large as their writer made them.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")] + ["payload"] * with_payload
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload
        strip = lambda x: x.strip("<>").removeprefix(RECORD) or None if x else None
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

                for data in frames(batch.column(0)[k].as_py()):
                    h, payload = parsed(data)
                    if h["warc-type"] not in ("response", "revisit"):
                        continue
                    size = None if h["payload_bytes"] is None else int(h["payload_bytes"])
                    rows.append((strip(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], strip(h.get("warc-refers-to")), size, h["payload_digest"], *([payload] * with_payload)))
                    held += len(payload)
                    if len(rows) >= 2000 or with_payload and held > 8_000_000:
                        yield out()
                        rows, held = [], 0
                if rows:
                    yield out()

    content = spark.read.format("binaryFile").load(path).select("content")
    return content.mapInArrow(unpack, SCHEMA + ", payload binary" * with_payload)

