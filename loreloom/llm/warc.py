"""WARC archives, each compressed with a Zstandard dictionary of its own.

An archive is a table row: its bytes are a skippable frame that holds the dictionary, then one
Zstandard frame per record, so that any record can be read alone with the dictionary. Archives are
bounded in size; tasks write and read them independently.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import keyed
from loreloom.session import materialise

ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_FRAME = 0x184D2A5D
LEVEL = 3
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SPACE = uuid.UUID("8d9c2f1a-5b7e-5c43-9f60-2f0c8a6f7e11")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324


def record_id(page_id: int | None, key: dict) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page_id}/{key['f']}/{key['r']}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """The record of one page: its payload, or a revisit of the page that holds the same one."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    revisit = row["response_key"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["page_id"], row["row_key"])),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["url"] is not None:
        url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"])
        headers.insert(3, ("WARC-Target-URI", url))
    if row["page_id"] is not None:
        headers.append(("X-Page-Id", str(row["page_id"])))
    if revisit:
        headers.append(("WARC-Profile", SAME_PAYLOAD))
        headers.append(("WARC-Refers-To", record_id(row["refers_to"], row["response_key"])))
        if row["refers_to"] is not None:
            headers.append(("X-Refers-To-Page", str(row["refers_to"])))
    return _record(headers, http.encode() + (b"" if revisit else payload))


def compressed(records: list[bytes]) -> tuple[bytes, list[int]]:
    """An archive of the records, and where the frame of each begins."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::step]]
    try:
        if len(samples) < 16:
            raise zstandard.ZstdError("too few samples to train on")
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too uniform to learn from: the records themselves serve
        content = b"".join(samples)[:DICTIONARY_BYTES]
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    out, offsets = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw], []
    at = 8 + len(raw)
    for record in records:
        frame = packer.compress(record)
        offsets.append(at)
        out.append(frame)
        at += len(frame)
    return b"".join(out), offsets


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(name, n_records, offsets, content): one row per archive, for rows of `decided`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0

        def archive(records: list[bytes]) -> pa.RecordBatch:
            name = f"part-{part:06d}-{count:05d}.warc.zst"
            about = f"software: loreloom\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n"
            head = _record(
                [
                    ("WARC-Type", "warcinfo"), ("WARC-Date", date),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, name)}>"),
                    ("Content-Type", "application/warc-fields"),
                ],
                about.encode(),
            )
            content, offsets = compressed([head, *records])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), pa.array([len(records)], pa.int64()),
                    pa.array([offsets], pa.list_(pa.int64())), pa.array([content], pa.binary()),
                ],
                ["name", "n_records", "offsets", "content"],
            )

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                record = page_record(batch.slice(i, 1).to_pylist()[0], date)
                if held and size + len(record) > ARCHIVE_BYTES:
                    yield archive(held)
                    held, size, count = [], 0, count + 1
                held.append(record)
                size += len(record)
        if held:
            yield archive(held)

    return pages.select(
        "row_key", "page_id", "url", "html", "refers_to", "response_key"
    ).mapInArrow(run, "name string, n_records long, offsets array<long>, content binary")


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, in order."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    raw = content[8 : 8 + size]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    with opener.stream_reader(memoryview(content)[8 + size :], read_across_frames=True) as stream:
        text = stream.read()
    at = 0
    while at < len(text):
        end = text.index(b"\r\n\r\n", at)
        version, *lines = text[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a record: {version[:20]}")
        headers = dict(line.split(": ", 1) for line in lines)
        block = text[end + 4 : end + 4 + int(headers["Content-Length"])]
        at = end + 4 + len(block)
        if text[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4
        yield headers, block


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a response is checked against its digest and length; a revisit has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [
            "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload",
        ]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for headers, block in parsed(content):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    payload = None
                    length = int(headers["X-Payload-Length"])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if len(payload) != length or payload_digest(payload) != digest:
                            raise ValueError(f"a payload differs from its digest {digest}")
                    rows.append(
                        (
                            number(headers, "X-Page-Id"), headers.get("WARC-Target-URI"), length,
                            digest, kind, number(headers, "X-Refers-To-Page"), payload,
                        )
                    )
                for low in range(0, len(rows), 500):
                    columns = zip(*rows[low : low + 500], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                    )

    return archives.select("content").mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary",
    )


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with row_key, refers_to and response_key, null for responses.

    Of rows whose payloads are equal and have at least `least_bytes` bytes, the one with the largest
    page_id (of equal ids the last in the files; null ids before all others) is the response.
    """
    rows = keyed(pages.select("page_id", "url", "html"))
    body = F.coalesce("html", F.lit(""))
    keys = materialise(
        rows.select("row_key", "page_id", F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("n"))
    )
    rank = F.struct(F.col("page_id").isNotNull().alias("x"), "page_id", "row_key")
    groups = materialise(
        keys.filter(F.col("n") >= least_bytes).groupBy("sha", "n")
        .agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    )
    revisits = keys.join(groups, ["sha", "n"]).filter("row_key != top.row_key").select(
        "row_key", F.col("top.page_id").alias("refers_to"), F.col("top.row_key").alias("response_key")
    )
    return rows.join(revisits, "row_key", "left")


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives and read all records back, one row per page.

    A null html counts as empty, a null url leaves its header out, a null page_id stays null. Repeated
    rows are records of their own, all but one of them revisits. An empty table has no archives.
    """
    return read_archives(materialise(write_archives(decided(pages, least_bytes))))


def export_archives(archives: DataFrame, folder: str) -> None:
    """Save each archive as a file of its name below `folder`, which every executor must reach."""

    def save(rows: Iterator) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for row in rows:
            with store.open_output_stream(f"{root}/{row.name}", compression=None) as out:
                out.write(row.content)

    archives.select("name", "content").foreachPartition(save)
