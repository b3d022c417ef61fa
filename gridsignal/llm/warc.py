"""WARC archives with an index: records are located first and then read by byte range.

Writing puts each page into a record of its own gzip member and returns one index row per record: file, offset, length,
URL and digest. Reading sorts the chosen index rows by file and offset and joins neighbouring ranges into one read, so
that a selection costs few requests and untouched parts of the archives are never opened.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.llm.blobs import bounded_records
from gridsignal.session import settle, shared_path

FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
TASK_BYTES = 16 << 20  # of archives, compressed, for one reading task
TASK_RECORDS = 1000  # no more tasks than this gives, where archives are small
REVISIT_BYTES = 1000

INDEX = (
    "page_id long, path string, offset long, length long, url string, payload_digest string, payload_bytes long, "
    "record_type string, refers_to long"
)
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_roles(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` of every page; ``refers_to`` is set for repeats of a long payload.

    Only digests are grouped and joined by payload; the payloads meet their role by page and digest, so a payload that
    a third of the pages share loads no single task.
    """
    digests = pages.withColumn("digest", F.sha1("payload"))
    small = digests.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= revisit_bytes)
    keepers = small.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1")
    again = (
        small.join(keepers, "digest").where(F.col("page_id") != F.col("keeper"))
        .select("page_id", "digest", F.col("keeper").alias("refers_to")).distinct()
    )
    return digests.join(again, ["page_id", "digest"], "left")


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    return ("\r\n".join(["WARC/1.1", *lines]) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. Revisits carry the HTTP header only, and the digest and length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    place = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = header([
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", place),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ])
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(head + block + b"\r\n\r\n") + press.flush()


def write_archives(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
    revisit_bytes: int = REVISIT_BYTES, date: str = "2020-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row of ``pages`` under ``folder`` (default: the session's shared folder); returns the index.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest id is a response and
    the others revisit it. A null payload is an empty one; a null URL is left out of the record; a row without an id is
    always a response. Rows repeated with the same id and payload are records of the same type. Other columns are
    ignored; no rows give an empty index. Files of a repeated task get another name and only one attempt is in the index.
    """
    target = folder or shared_path(pages.sparkSession, "warc")
    given = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, place = pafs.FileSystem.from_uri(target)
        fs.create_dir(place, recursive=True)
        out, path, offset, number = None, "", 0, 0
        try:
            for rows in batches:
                made = []
                for r in rows.to_pylist():
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, path, offset, number = fs.open_output_stream(f"{place}/{name}", compression=None), f"{target}/{name}", 0, number + 1
                    data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)
                    out.write(data)
                    made.append({
                        "page_id": r["page_id"], "path": path, "offset": offset, "length": len(data), "url": r["url"],
                        "payload_digest": r["digest"], "payload_bytes": len(r["payload"]),
                        "record_type": "response" if r["refers_to"] is None else "revisit", "refers_to": r["refers_to"],
                    })
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(made, INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return settle(payload_roles(bounded_records(given), revisit_bytes).mapInArrow(write, INDEX))


INDEX_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def page_of(field: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", field or "<urn:page:>")[1]
    return int(number) if number else None


def parse(data: bytes, keep_payload: bool) -> dict:
    """The fields of one record, all from the archive itself; a response's digest and length are those of its bytes."""
    text, _, block = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    response = fields["WARC-Type"] == "response"
    declared = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    digest = hashlib.sha1(payload).hexdigest() if response else declared
    if digest != declared:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload_bytes": len(payload) if response else int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest, "payload": payload if response and keep_payload else None,
    }


def ranges(rows: list[dict], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[dict]]]:
    """Join records that lie close together in a file into reads: path, begin, end, records. Rows come in file order."""
    held: list[dict] = []
    for r in rows:
        if held and (r["path"] != held[0]["path"] or r["offset"] - end > gap or r["offset"] + r["length"] - held[0]["offset"] > most):
            yield held[0]["path"], held[0]["offset"], end, held
            held = []
        end = max(end, r["offset"] + r["length"]) if held else r["offset"] + r["length"]
        held.append(r)
    if held:
        yield held[0]["path"], held[0]["offset"], end, held


def read_records(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Read the records that the rows of ``index`` locate; any selection of index rows will do.

    Payloads of revisits are null: they are those of the record that ``refers_to`` names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for rows in batches:
            for path, begin, end, records in ranges(rows.to_pylist()):
                if path != name:
                    fs, place = pafs.FileSystem.from_uri(path)
                    name, source = path, fs.open_input_file(place)
                data = source.read_at(end - begin, begin)
                found = [parse(data[r["offset"] - begin : r["offset"] - begin + r["length"]], keep_payload) for r in records]
                yield pa.RecordBatch.from_pylist(found, RECORD_SCHEMA)

    chosen = index.select("path", "offset", "length")
    facts = chosen.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("records")).first()
    # an index is small beside its archives: they, not its own size, say how many tasks read
    least = min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts.records // TASK_RECORDS))
    tasks = max(1, least, -(-facts.bytes // TASK_BYTES))
    return chosen.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(read, RECORD)
