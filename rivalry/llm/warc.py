"""WARC archives as a chunked record table.

A payload never has to fit in a Python task: it travels as rows ``(record id,
chunk number, bytes)`` of bounded size in both directions. The writer streams
chunk rows into one gzip member per record; the reader streams members back
into chunk rows, each with the digest of the payload up to its end, so the
last chunk's digest is that of the whole payload.

Each writing task makes one file of its own in the shared folder and returns
its name; only files named by finished tasks enter the manifest. Revisits are
decided before writing, from digests alone: equal payloads of at least
``least_bytes`` refer to the one with the smallest id. Of the payloads only
their digests are shuffled as long as the repeated digests are few enough to
broadcast (``broadcast_rows``, checked by a count); beyond that the
join goes by digest, and AQE splits a hot one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import file_system
from rivalry.session import cut_lineage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = ("record_id string, page_id long, url string, record_type string, refers_to long, header_digest string, "
          "chunk_no long, offset long, data binary, digest string, is_last boolean")


def record_head(page_id, url, size, digest, first_id, date: str) -> bytes:
    """WARC and HTTP header of a record. ``first_id`` makes it a revisit."""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    block = ("\r\n".join(http) + "\r\n\r\n").encode()
    clean = "".join(ch if ch > " " else f"%{ord(ch):02X}" for ch in url or "")
    name = "none" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}:{digest[:16]}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if first_id is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first_id}:{digest[:16]}>"]
    head.append(f"Content-Length: {len(block) + (size if first_id is None else 0)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block


def marked(df: DataFrame, *, id_col: str, url_col: str, payload_col: str, least_bytes: int, broadcast_rows: int) -> DataFrame:
    """``page_id, url, payload, size, digest, first_id``: the record that a
    revisit refers to, NULL for a response."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn(
        "size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    repeated = cut_lineage(src.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1 and low is not null").drop("n"))
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    return src.join(repeated, "digest", "left").withColumn(
        "first_id", F.when(F.coalesce(F.col("page_id") > F.col("low"), F.col("low").isNotNull()), F.col("low"))).drop("low")


def write_warc(
    df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100,
    chunk: int = 1 << 18, level: int = 1, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 100_000,
) -> DataFrame:
    """Write a record per row of ``df`` under ``path`` and return the manifest
    ``(file, records, bytes)``.

    The payload is the column's UTF-8 text or bytes; NULL is empty. Of equal
    payloads of at least ``least_bytes`` bytes the one with the smallest id is
    a response and those with larger ids (or none) revisit it; rows that
    repeat the smallest id are responses too, as are all payloads if none has
    an id, and all smaller payloads. A NULL url is empty; control characters
    and spaces in it are percent-encoded. An empty table writes nothing.
    Other columns are ignored.
    """
    src = marked(df, id_col=id_col, url_col=url_col, payload_col=payload_col, least_bytes=least_bytes, broadcast_rows=broadcast_rows)
    own = F.col("first_id").isNull()
    last = F.when(own & (F.col("size") > 0), F.floor((F.col("size") - 1) / chunk)).otherwise(0).cast("int")
    # chunk numbers are exploded, and each row cuts its own chunk: no row holds a payload's chunks beside it.
    # Rows of a record stay together and in order: exploding moves nothing
    rows = src.select("page_id", "url", "size", "digest", "first_id", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")).select(
        "page_id", "url", "size", "digest", "first_id", "chunk_no",
        F.when(own, F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("data"))

    def write(batches):
        fs, folder = file_system(path)
        sink = name = packer = running = expected = None
        records = written = 0

        def put(raw: bytes) -> None:
            nonlocal written
            sink.write(raw)
            written += len(raw)

        def close() -> None:
            if expected is not None and running.hexdigest() != expected:
                raise ValueError(f"the chunks written are not the payload of digest {expected}")
            put(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for k in range(batch.num_rows):
                page_id, url, size, digest, first_id, chunk_no, data = (c[k].as_py() for c in columns)
                if sink is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(f"{folder}/{name}", compression=None)
                if chunk_no == 0:
                    if packer is not None:
                        close()
                    running, expected = hashlib.sha256(), digest if first_id is None else None
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    put(packer.compress(record_head(page_id, url, size, digest, first_id, date)))
                    records += 1
                running.update(data)
                put(packer.compress(data))
        if sink is not None:
            close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": records, "bytes": written}])

    return cut_lineage(rows.mapInArrow(write, "file string, records long, bytes long"))


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode().rstrip("\r\n").partition(": ")
        out[key.lower()] = value
    return out


def _page(urn: str):
    name = urn.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def stream_records(source, chunk: int) -> Iterator[tuple]:
    """Chunk rows (as ``CHUNKS``) of an archive opened for reading; holds one
    chunk. A response whose payload does not have its header's digest raises."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 16)
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        before = b""
        while not before.endswith(b"\r\n\r\n"):  # the HTTP header
            line = stream.readline()
            before += line
            if not line:
                raise ValueError("record ends in its header")
        left -= len(before)
        refers = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
        fixed = (head["warc-record-id"].strip("<>"), _page(head["warc-record-id"]), head.get("warc-target-uri", ""), head["warc-type"],
                 refers, head["warc-payload-digest"].removeprefix("sha256:"))
        running, number, offset = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            left -= len(data)
            running.update(data)
            yield (*fixed, number, offset, data, running.copy().hexdigest(), left == 0)
            number, offset = number + 1, offset + len(data)
            if left == 0:
                break
            if not data:
                raise ValueError("record ends in its payload")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record has no end")
        if refers is None and running.hexdigest() != fixed[-1]:
            raise ValueError(f"record {fixed[0]}: its payload has another digest than its header")


def read_warc(manifest: DataFrame, path: str, *, chunk: int = 1 << 18) -> DataFrame:
    """The chunk table of the archives named by ``manifest``: one row per
    ``chunk`` bytes of a record's payload (one empty row for a revisit or an
    empty payload), with ``digest``, the SHA-256 of the payload up to and
    including the row, and ``is_last``."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    # one file a task: the names are so few bytes that any other dealing would meet in one task
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 10_000)))

    def read(batches):
        fs, folder = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in stream_records(source, chunk):
                        rows.append(row)
                        held += len(row[8]) + 200
                        if held > 4 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names)

    return files.mapInArrow(read, CHUNKS)


def _batch(rows, names) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to``. A revisit has the size and
    digest of the payload it refers to."""
    last = cut_lineage(chunks.filter("is_last").select(
        "page_id", "record_type", "refers_to", "header_digest", "digest", (F.col("offset") + F.octet_length("data")).alias("size")))
    own = last.filter("record_type = 'response'").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    there = own.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    back = last.filter("record_type <> 'response'").select("page_id", "record_type", "refers_to", "header_digest").join(
        there, ["refers_to", "header_digest"], "left").select(
        "page_id", "payload_bytes", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to")
    return own.unionByName(back)
