"""WARC archives in Zstandard with a dictionary, written and read as Spark tables.

An archive is a skippable frame with the dictionary, then one frame for each record, compressed with it.
Between records stands an empty skippable frame: it is the line separator of Spark's text writer, which so
commits the archives on any store, a task at a time. Readers of Zstandard pass over it. The writer's lines
are runs of frames of about `LINE_BYTES` bytes, and a longer frame is followed by empty lines, so that a new
archive begins after about LINES * LINE_BYTES bytes, and after `records` records at most: an archive stays
readable in one piece however much a task is given.

Of records with equal payloads of at least `least` bytes, the one with the largest page id is a response,
and the others are revisits that refer to it; smaller payloads are always responses. Groups are counted by
digest before records meet them, so a payload that many pages share is one row of that side; it is met under
`SALTS` salts, in as many tasks. Payloads too small for a group are dealt out at random.

The reader takes the dictionary from the leading frame, follows the frames' block headers to each record's
end, and checks the version line, the header lines, the content length, the end of the record and the
digest. A record that fails has its fault in `problem`, and the others are still read.

Null payloads count as empty, null addresses give no target header. Rows with equal page ids are each
written; those that carry a group's largest page id are all responses. Rows without a page id are never a
group's response unless no row has one. An empty table gives archives without records, or none. Other columns are
not stored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1000
DICTIONARY_BYTES = 1 << 16
SAMPLE_ROWS, SAMPLE_BYTES = 512, 8192
ARCHIVE_RECORDS = 4096
LINES, LINE_BYTES = 64, 1 << 20
SALTS = 16
#: Magic numbers of the dictionary's frame, of dictionaries and of frames; the separator is a skippable frame of no bytes.
DICTIONARY_MAGIC, RAW_MAGIC, FRAME_MAGIC = b"\x5d\x2a\x4d\x18", b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def fit_dictionary(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """A dictionary trained on the beginnings of a bounded sample; of plain header text if it is too small.
    Ids are drawn first, so that only the drawn pages' beginnings come to the driver."""
    order = F.xxhash64("id")
    drawn = pages.select(F.col(id_col).alias("id")).where("id is not null").distinct().orderBy(order, "id").limit(SAMPLE_ROWS)
    head = F.substring(F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary"), 1, SAMPLE_BYTES)
    rows = pages.select(F.col(id_col).alias("id"), head.alias("head")).join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("head").alias("head"))
    heads = [bytes(r["head"]) for r in rows.orderBy(order, "id").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in heads if x]).as_bytes()
    except zstandard.ZstdError:
        return record(None, "response", None, None, b"", "0" * 40, 0) + b"".join(heads)[:SAMPLE_BYTES]


def record(page: int | None, kind: str, url: str | None, refers_to: int | None, payload: bytes, digest: str, size: int) -> bytes:
    block = _HTTP % size + (payload if kind == "response" else b"")
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {size}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def classify(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST) -> DataFrame:
    """page, url, payload (binary), digest (hexadecimal SHA-1), size, kind and refers_to of each row."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page").alias("latest"), F.count("*").alias("n")).where("n > 1 and latest is not null").select("digest", "latest")
    revisit = F.coalesce((F.col("size") >= least) & F.col("latest").isNotNull() & ~F.col("page").eqNullSafe(F.col("latest")), F.lit(False))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))  # no digest
    rows = rows.withColumn("key", F.when(F.col("size") >= least, F.concat_ws("-", "digest", salt)).otherwise(alone))
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.concat_ws("-", "digest", "salt").alias("key"), "latest")
    joined = rows.join(every, "key", "left")
    return joined.select(
        "page", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("latest")).alias("refers_to")
    )


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST, records: int = ARCHIVE_RECORDS) -> None:
    """Archives of pages under path, each of at most `records` records of one partition."""
    dictionary = fit_dictionary(pages, id_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        lead = DICTIONARY_MAGIC + struct.pack("<I", len(dictionary)) + dictionary
        row, out, line, held, size = 0, [], [], 0, 0

        def end_line(fill: int = 0) -> None:
            nonlocal row, held, size
            for content in [between.join(line), *[b""] * fill]:
                # the writer begins a file at just these rows
                out.append(content if row % lines else lead + content)
                row += 1
            size += held
            line.clear()
            held = 0

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            made, size = pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"]), 0
            out.clear()
            return made

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for r in b.slice(at, 256).to_pylist():
                    frame = made.compress(record(r["page"], r["kind"], r["url"], r["refers_to"], r["payload"], r["digest"], r["size"]))
                    if line and (len(line) >= per_line or held + len(frame) > LINE_BYTES):
                        end_line()
                    line.append(frame)
                    held += len(frame)
                    if held > LINE_BYTES:
                        end_line(held // LINE_BYTES)
                    if size > 4 * LINE_BYTES:
                        yield batch_of()
        if line:
            end_line()
        if out:
            yield batch_of()

    lines = min(LINES, records)
    per_line, between = max(1, records // lines), SEPARATOR.encode()
    frames = classify(pages, id_col, payload_col, url_col, least).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", lines).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its headers."""
    checksum = 4 if data[at + 4] & 4 else 0
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data) or head >> 1 & 3 == 3:
            raise ValueError("a frame is cut off or has a block of unknown kind")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + checksum


def frames(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(dictionary, frame) of each record of one archive."""
    view, at, dictionary = memoryview(data), 0, b""
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in _SKIPPABLE:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at == 0:
                if view[:4] != DICTIONARY_MAGIC or size + 8 > len(view):
                    raise ValueError("the leading frame holds no dictionary")
                dictionary = bytes(view[8 : 8 + size])
                if dictionary[:4] == FRAME_MAGIC:
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
            at += 8 + size
        elif view[at : at + 4] == FRAME_MAGIC and at:
            end = frame_end(view, at)
            if end > len(view):
                raise ValueError("the last frame is cut off")
            yield dictionary, bytes(view[at:end])
            at = end
        else:
            raise ValueError("an archive begins with a dictionary, and holds only frames")


def parse(raw: bytes) -> dict:
    """Fields of one record; raises ValueError at a fault."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no version line or no end of the header")
    if any(": " not in x for x in lines):
        raise ValueError("a header line without a name")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    size = int(fields.get("content-length", -1))
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the content length doesn't fit the record")
    page = lambda key: int(x) if (x := fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields.get("warc-type")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not found or not http.startswith(b"HTTP/"):
        raise ValueError("unknown kind of record or no HTTP header")
    algorithm, _, coded = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(coded).hex()
    length = int(fields["warc-payload-length"])
    if algorithm != "sha1" or kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't fit its digest and length")
    return {"page_id": page("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": page("warc-refers-to"), "payload_digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None, "problem": None}


FIELDS = "page_id bigint, record_type string, url string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, problem string"


def read_archives(spark, path: str) -> DataFrame:
    """The records of the archives under path. A revisit's payload is null, its length and digest are those
    of the full payload."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0):
                rows, reader, own, held = [], None, None, 0
                try:
                    for dictionary, frame in frames(file.as_py()):
                        if reader is None or own is not dictionary:
                            own, reader = dictionary, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
                        try:
                            rows.append(parse(reader.decompress(frame)))
                        except (ValueError, KeyError, zstandard.ZstdError) as e:
                            rows.append({"problem": str(e)})
                        held += len(rows[-1].get("payload") or b"")
                        if len(rows) >= 1000 or held > 1 << 22:
                            yield batch_of(rows)
                            rows, held = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append({"problem": f"archive: {e}"})
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, FIELDS)
