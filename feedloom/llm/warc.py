"""WARC archives, index first.

Writing yields an index row per record (file, offset, length, URL, digest). Reading starts from index rows: selected
records are dealt by file and block, sorted by offset, and near ranges are read in one go.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Workspace, chunks, small, store_of, text_of

#: Payloads below this size are stored again instead of being referred to.
REVISIT_BYTES = 1000
#: Ranges of one file with at most GAP bytes between them are read together, up to RUN bytes; blocks deal the reads.
GAP, RUN, BLOCK = 64 << 10, 8 << 20, 32 << 20
#: Repeated payloads (about 60 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
_INDEX = "page_id string, file string, offset bigint, length bigint, url string, payload_digest string, record_type string"
_RECORD = "page_id string, record_type string, refers_to string, payload_digest string, url string, payload binary"
_CONTROL = {i: f"%{i:02X}" for i in [*range(33), 127]}


def record_bytes(page: str, url: str, html: bytes, sha1: str, refers_to: str | None, repeated: bool) -> bytes:
    """One gzip member. Revisit records have the HTTP header alone; their payload is in the record they refer to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if repeated else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if repeated else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {url.translate(_CONTROL)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if repeated:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record read from its gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _write(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"  # each attempt has its own file
        out, at = None, 0
        for batch in chunks(batches, "html"):
            rows = batch.to_pylist()
            offsets, lengths = [], []
            for r in rows:
                repeated = r["record_type"] == "revisit"
                raw = record_bytes(r["page_id"], r["url"], r["html"].encode(), r["sha1"], r["refers_to"], repeated)
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(raw)
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_pydict({"page_id": [r["page_id"] for r in rows], "file": [name] * len(rows), "offset": offsets, "length": lengths, "url": [r["url"] for r in rows], "payload_digest": [r["sha1"] for r in rows], "record_type": [r["record_type"] for r in rows]}, schema=_arrow(_INDEX))
        if out:
            out.close()

    return write


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, space: Workspace, name: str = "warc", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Writes a record per row and returns the written index; ids are strings there.

    Of payloads of at least REVISIT_BYTES that are equal (SHA-1 and length), the row with the largest id is the
    response and the others revisit it; rows that repeat that id are responses too. Null payloads and URLs are empty.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"), text_of(html_column).alias("html")).withColumns({"sha1": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html")})
    same = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("sha1", "n").agg(F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    same = space.write(same, f"{name}-same")
    plan = rows.join(small(same, BROADCAST_ROWS), ["sha1", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    plan = plan.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("page_id"), "url", "html", "sha1", F.when(again, F.col("first").cast("string")).alias("refers_to"), F.when(again, "revisit").otherwise("response").alias("record_type"))
    return space.write(plan.mapInArrow(_write(space.folder(name)), _INDEX), f"{name}-index")


def _read(folder: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)

        def runs() -> Iterator[list[tuple[str, int, int]]]:
            run: list[tuple[str, int, int]] = []
            for batch in batches:
                for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if run and (x[0] != run[0][0] or x[1] > run[-1][1] + run[-1][2] + GAP or x[1] + x[2] - run[0][1] > RUN):
                        yield run
                        run = []
                    run.append(x)
            if run:
                yield run

        source, opened = None, None
        for run in runs():
            if opened != run[0][0]:
                if source:
                    source.close()
                source, opened = store.open_input_file(f"{path}/{run[0][0]}"), run[0][0]
            low = run[0][1]
            raw = source.read_at(run[-1][1] + run[-1][2] - low, low)
            rows, size = [], 0
            for _, offset, length in run:
                fields, payload = parse_record(raw[offset - low : offset - low + length])
                refers = fields.get("WARC-Refers-To")
                page = fields["WARC-Record-ID"][10:-1]
                rows.append((None if page == "null" else page, fields["WARC-Type"], refers and refers[10:-1], base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), fields["WARC-Target-URI"], payload))
                size += len(payload)
                if size > RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(_RECORD), strict=True)], schema=_arrow(_RECORD))
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(_RECORD), strict=True)], schema=_arrow(_RECORD))
        if source:
            source.close()

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name. Revisit records have an empty payload."""
    block = (F.col("offset") / BLOCK).cast("bigint")
    dealt = index.select("file", "offset", "length").repartition("file", block).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(folder), _RECORD)
