"""WARC archives with an index: write, look up, and read records by byte range.

Method: index first. Writing yields, for each record, its file, offset, length, URL
and payload digest; the index is a Parquet table beside the archives. Reading takes a
selection of index rows, sorts them by file and offset, coalesces neighbouring byte
ranges into one read, and cuts the records out of it.

Each record is a gzip member of its own, so a byte range can be decompressed alone.
Of records with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with the
smallest id is a response and the others revisit it (no payload of their own); shorter
ones are all responses. Rows are told apart by their id; if an id repeats, each row
gets a record, and rows that carry the smallest id of their payload are all responses.

Defined results: a null payload is empty; a null URL leaves out WARC-Target-URI and
stays null in the index; a null id can be no response for others and is written as a
response. Extra columns aren't archived. An empty table gives an empty index.

Recovery: archive files are named after partition and a random suffix, and the index
holds the names, so a file left by a lost or repeated task is never read. Only the
shared folder is written to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import bounded_batches, local_path, new_dir, tidy

MIN_REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
GAP_BYTES = 64 << 10
RANGE_BYTES = 4 << 20
CHUNK_BYTES = 8 << 20
TASK_BYTES = 16 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, file string, offset bigint, length bigint, url string, digest string, record_type string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def header(kind: str, page_id, url, digest: str, size: int, refers_to, block: int) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member; a revisit holds the HTTP head only."""
    head = http_head(len(payload))
    block = head if refers_to is not None else head + payload
    kind = "response" if refers_to is None else "revisit"
    raw = header(kind, page_id, url, digest, len(payload), refers_to, len(block)) + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parsed(member: bytes) -> tuple:
    """The fields of ``RECORD`` of one gzip member; checks lengths and the payload's digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    _, _, payload = block.partition(b"\r\n\r\n")
    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda uri: int(x) if (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None
    return (
        number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        size, digest, payload if kind == "response" else None,
    )


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload with digest and refers_to (the smallest id with that payload, or null)."""
    digests = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    repeated = (
        digests.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # a payload that a third of the pages share is dealt to SALTS partitions
    keyed = pages.withColumns({"digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    joined = keyed.join(repeated, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; returns the stored index."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    )
    records = f"{folder}/records"

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = local_path(records)
        files.create_dir(root, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in batches:
                found = []
                for row in batch.to_pylist():
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                    out.write(data)
                    found.append((row["page_id"], name, at, len(data), row["url"], row["digest"], "response" if row["refers_to"] is None else "revisit"))
                    at += len(data)
                if found:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    names = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
        finally:
            if out is not None:
                out.close()

    with_revisits(rows).mapInArrow(tidy(written), INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(rows: list[tuple], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[list[tuple]]:
    """Groups of (file, offset, length, ...) rows, sorted, that one read covers."""
    run: list[tuple] = []
    end = 0
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] > end + gap or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        end = max(end, row[1] + row[2]) if run else row[1] + row[2]
        run.append(row)
    if run:
        yield run


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows in ``selected``, as ``RECORD``."""
    records = f"{folder}/records"
    total = selected.agg(F.sum("length")).first()[0] or 0
    # ranges of one stretch of a file are read by one task, in order
    dealt = (
        selected.withColumn("chunk", F.expr(f"offset div {CHUNK_BYTES}")).repartition(-(-total // TASK_BYTES) or 1, "file", "chunk")
        .sortWithinPartitions("file", "offset").select("file", "offset", "length")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = local_path(records)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        name = source = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for run in coalesced(rows):
                if run[0][0] != name:
                    if source is not None:
                        source.close()
                    name = run[0][0]
                    source = files.open_input_file(f"{root}/{name}")
                first = run[0][1]
                data = source.read_at(max(o + n for _, o, n in run) - first, first)
                found = [parsed(data[o - first : o - first + n]) for _, o, n in run]
                if not payloads:
                    found = [(*x[:-1], None) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
        if source is not None:
            source.close()

    return dealt.mapInArrow(tidy(read), RECORD)


def archive_folder(spark: SparkSession) -> str:
    return new_dir(spark, "warc")
