import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rivalry.llm import queries, warc
from rivalry.llm.common import file_system, scratch_path


def brute(rows):
    low = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            low[b] = min(low.get(b, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        back = len(b) >= 100 and b in low and (i is None or i > low[b])
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if back else "response", low[b] if back else None))
    return sorted(out, key=str)


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cols = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {cols} FROM ({queries.OP4_SQL})").fetchall()
    got = queries.QUERIES["op4_warc_round_trip"](spark, sf_dir).selectExpr(*cols.split(", ")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_edges_chunks_and_bytes(spark):
    rnd = random.Random(1)
    big = "".join(rnd.choices("abcé漢 \r\n", k=20_000))
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\nc", "x" * 99), (4, "v", "x" * 99), (7, "w", "y" * 100), (5, "w", "y" * 100), (6, "w", "y" * 100),
            (5, "w", "y" * 100), (None, "w", "y" * 100), (None, "z", "z" * 200), (None, "z", "z" * 200), (8, "big", big), (9, "big", big),
            (10, "t", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "2 AS digest", "'x' AS payload")
    path = scratch_path(spark, "test")
    manifest = warc.write_warc(df, path, chunk=1000)
    chunks = warc.read_warc(manifest, path, chunk=777).cache()
    got = sorted(map(tuple, warc.records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute([(i, t) for i, _, t in rows])
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 777
    whole, at = b"", 0
    for r in chunks.filter("page_id = 8").orderBy("chunk_no").collect():
        assert r.offset == at and r.chunk_no == at // 777
        whole += r.data
        at += len(r.data)
        assert r.digest == hashlib.sha256(whole).hexdigest()
    assert whole.decode() == big
    # the files are ordinary archives: one gzip member after another
    fs, folder = file_system(path)
    raw = b"".join(gzip.decompress(fs.open_input_stream(f"{folder}/{r.file}", compression=None).read()) for r in manifest.collect())
    assert raw.count(b"WARC-Record-ID: ") == len(rows) == manifest.agg(F.sum("records")).first()[0]


def test_empty_table_and_join_without_broadcast(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "test")
    assert warc.records(warc.read_warc(warc.write_warc(df, path), path)).collect() == []
    rows = [(k, "u", "t" * 150 if k % 3 else f"only {k} " * 30) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "test")
    got = warc.records(warc.read_warc(warc.write_warc(df, path, broadcast_rows=0), path))
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute([(i, t) for i, _, t in rows])


def test_an_altered_payload_raises(spark):
    import io

    payload = b"some payload of a page " * 50
    digest = hashlib.sha256(payload).hexdigest()
    def archive(body):
        return io.BytesIO(gzip.compress(warc.record_head(1, "u", len(payload), digest, None, "2024-01-01T00:00:00Z") + body + b"\r\n\r\n"))
    rows = list(warc.stream_records(archive(payload), 100))
    assert b"".join(r[8] for r in rows) == payload and rows[-1][9] == digest
    with pytest.raises(ValueError, match="digest"):
        list(warc.stream_records(archive(payload[:-1] + b"?"), 100))
    with pytest.raises(ValueError):
        list(warc.stream_records(archive(payload[:-1]), 100))
