"""WARC archives with a dictionary, one Zstandard frame per record.

`write` deals the pages to tasks and writes archives of about `ROLL` bytes of records into the shared folder.  For every
archive a Zstandard dictionary is built from its own records; it leads the file in a skippable frame (magic 184D2A5D),
and every record is a frame of its own, so that a reader can begin at any record.  A record whose payload of `REVISIT`
bytes or more equals that of a record with a larger page_id is a revisit without payload.  `read` returns the records.

Scale: equality is by SHA-256, aggregated to the largest page_id before the join; the pages move once, to their digest,
and adaptive execution may split a digest that a third of all pages share.  Writers hold one archive at a time.  An
attempt of a task writes files of its own names; only the names that Spark's commit of the index keeps are read, so a
lost executor or a second attempt leaves nothing that counts.

Defined cases: a null html is an empty payload; equal rows with the largest page_id are all responses; a null page_id is
smaller than any, and alone among equals it is a response; a null url gives the record's own id as target; line breaks
in a url are percent-encoded; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from paperlens.llm.common import stored
from paperlens.sources.sinks import new_folder

MAGIC = 0x184D2A5D
ROLL = 24 << 20
REVISIT = 1000
DICTIONARY = 32 << 10
#: Records that a dictionary is built from, evenly spaced over the archive, and the bytes of each that are looked at.
TAUGHT, TAUGHT_BYTES = 256, 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def squeezed(pages: DataFrame) -> DataFrame:
    """page_id, url, same (SHA-256 of the payload), digest (its SHA-1) and the payload, compressed for its way to a writer."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            payloads = batch.column(2).to_pylist()
            columns = [[hashlib.sha256(p).digest() for p in payloads], [hashlib.sha1(p).hexdigest() for p in payloads], [packer.compress(p) for p in payloads]]
            kinds = pa.binary(), pa.string(), pa.binary()
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["page_id", "url", "same", "digest", "packed"])

    rows = pages.select("page_id", F.col("url").cast("string"), payload().alias("payload"))
    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, same binary, digest string, packed binary")


def payload():
    return F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))


def classified(pages: DataFrame) -> DataFrame:
    """The squeezed pages with refers_to (null for responses)."""
    large = pages.select("page_id", payload().alias("payload")).filter(F.octet_length("payload") >= REVISIT)
    first = large.groupBy(F.unhex(F.sha2("payload", 256)).alias("same")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    # always a merge join: the payloads are dealt to the writers here, and a large digest can be split
    p = squeezed(pages).join(first.filter("n > 1").drop("n").hint("merge"), "same", "left")
    earlier = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return p.select("page_id", "url", "packed", "digest", F.when(earlier, F.col("first")).alias("refers_to"))


def name(page) -> str:
    return f"urn:page:{page}"


def record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record."""
    target = (url or name(page)).replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name(page)}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    block = http + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>"]
        block = http  # its Content-Length still tells the payload's
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the archive's records; from too few of them, their plain text."""
    some = [r[:TAUGHT_BYTES] for r in records[:: max(1, len(records) // TAUGHT)]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, some)) // 8)), some, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive of some records, and each one's offset and length in it."""
    known = dictionary(records)
    out = bytearray(struct.pack("<II", MAGIC, len(known.as_bytes())) + known.as_bytes())
    packer, spans = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True), []
    for r in records:
        frame = packer.compress(r)
        spans.append((len(out), len(frame)))
        out += frame
    return bytes(out), spans


def opened(folder: str):
    """The file system of a folder, and the folder's path on it."""
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of `pages`; returns their index: archive, at, length (of the frame), page_id."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        fs, base = opened(folder)
        rows, records, held, attempt, unpacker = [], [], 0, uuid.uuid4().hex, zstandard.ZstdDecompressor()

        def flush(number):
            data, spans = archive(records)
            file = f"{attempt}-{number:05d}.warc.zst"
            with fs.open_output_stream(f"{base}/{file}", compression=None) as out:
                out.write(data)
            columns = [pa.array([file] * len(rows)), pa.array([s[0] for s in spans], pa.int64()), pa.array([s[1] for s in spans], pa.int64()), pa.array(rows, page_type)]
            return pa.RecordBatch.from_arrays(columns, names=["archive", "at", "length", "page_id"])

        number, page_type = 0, None
        for batch in batches:
            fs.create_dir(base, recursive=True)
            page_type = batch.column(0).type
            for page, url, packed, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(page)
                records.append(record(page, url, unpacker.decompress(packed), digest, refers_to))
                held += len(records[-1])
                if held >= ROLL:
                    yield flush(number)
                    rows, records, held, number = [], [], 0, number + 1
        if records:
            yield flush(number)

    return stored(classified(pages).mapInArrow(run, f"archive string, at bigint, length bigint, page_id {kind}"), "archive-index")


def parse(data: bytes):
    """Headers (a dict) and block of every record of an archive."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("a record does not begin with its version")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key] = value
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block


def read(folder: str, index: DataFrame, kind: str = "bigint") -> DataFrame:
    """Records of the archives that the index names: page_id, url, payload (null for revisits), payload_bytes, digest, type, refers_to."""

    def page(value):
        text = value[len(f"<{name('')}") : -1]
        return None if text == "None" else text

    def run(batches):
        fs, base = opened(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    data = stream.read()
                out = []
                for h, block in parse(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = h["WARC-Type"] == "response"
                    if whole and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
                    refers_to = h.get("WARC-Refers-To")
                    out.append((page(h["WARC-Record-ID"]), h["WARC-Target-URI"], payload if whole else None, length, digest, h["WARC-Type"], refers_to and page(refers_to)))
                types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["page", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    files = index.select("archive").distinct()
    files = files.repartition(max(1, files.count()), "archive")  # names move, archives do not
    schema = "page string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers string"
    rows = files.mapInArrow(run, schema)
    return rows.select(F.col("page").cast(kind).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


def archived(pages: DataFrame) -> DataFrame:
    """All pages written to a new folder of archives and read back."""
    folder = new_folder(pages.sparkSession, "archives")
    return read(folder, write(pages, folder), dict(pages.dtypes)["page_id"])
