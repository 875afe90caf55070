import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivalry.llm import queries, token_files
from rivalry.llm.common import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows, end_id=2):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table_against_one_text_at_a_time(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op7_token_files"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_edge_texts_and_ties(spark, plane):
    odd = ["", None, " ", "  two  spaces ", " lead", "trail ", "a\n b", "a \n b", "tab\t x", "x  y", "x  y", "\x1c a", "a\x00 \x00b \x00", "it's we'll  'S",
           "<|endoftext|> a<|endoftext|>b", "é 漢字 \U0001f600 x", "1234 56,7", "word " * 3000 + "x" * 20_000, "  a", "\x85 a", "a\x0b\x0c b", "one\ntwo three\nfour", "\nx", "x\n", "x\n\ny", "x\ny \nz", "a.\nB's\n\tc", "l\u2028m\nn"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "tie"), (3, "tie"), (None, "no id"), (None, None), (-5, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS ids")
    path = scratch_path(spark, "test")
    manifest = token_files.write_token_files(df, path, tokenizer=PATH, block=100, plane=plane)
    got = token_files.read_token_files(manifest, path).selectExpr("doc_id", "start", "length(ids) div 4", "crc32(ids)").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_path(spark, "test")
    manifest = token_files.write_token_files(df, path, tokenizer=PATH)
    assert token_files.read_token_files(manifest, path).collect() == []


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip_and_blocks(plane):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n).astype("<u4")
        assert (token_files.from_planes(token_files.to_planes(ids, plane), n, plane) == ids).all()
    sink = io.BytesIO()
    w = token_files.PlaneWriter(sink, block=16, plane=plane, level=3)
    docs = [(k if k % 5 else None, rng.integers(0, 60_000, int(rng.integers(0, 50))).astype(np.int32)) for k in range(40)]
    for k, ids in docs:
        w.add(ids)
        w.document(k, len(ids))
    size = w.close()
    assert size == len(sink.getvalue())
    got = list(token_files.read_file(sink, size))
    assert [(k, np.frombuffer(b, "<u4").tolist()) for k, _, b in got] == [(k, ids.tolist()) for k, ids in docs]


def test_a_full_store_still_encodes():
    from rivalry.llm.units import UnitStore

    store = UnitStore(lambda us: (np.array([len(u) for u in us], np.int64), np.concatenate([[ord(c) for c in u] for u in us]).astype(np.int32)), bound=3)
    for words in (["ab", "c"], ["ab", "d", "ef", "d"], ["ghi", "ab", "ef"], ["c", "d"]):
        n, flat = store.ids(words)
        assert n.tolist() == [len(w) for w in words] and "".join(map(chr, flat)) == "".join(words)


def test_column_cut_against_whole_texts():
    import pyarrow as pa

    texts = ["", None, "\n", "\n\n", "a\n\nb", "\n\nx y\n\n\nz w\n\n", "a\n", "\na", "x\n\n\n", "a b\n\n\n\nc", "a  b", "a\n\n b", "\tq", "a b", "\n\n\n\nlong", "y\n\nz\n"] * 3
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("ab .\n\n  \t'1é<"), int(rng.integers(0, 40)))) for _ in range(600)]
    texts += [t.replace("  ", " ").replace(" \n", "\n").replace("\n ", "\n") for t in texts if t]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        n, flat = token_files.batch_encoder(PATH, bound=50)(column)
        assert n.tolist() == [len(w) for w in want]
        assert flat.tolist() == [x for w in want for x in w]


def test_rows_without_id_spread_over_files(spark):
    rows = [(None, f"text {i} " + "word " * 200) for i in range(3000)] + [(i, f"t{i}") for i in range(1000)]
    path = scratch_path(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
        manifest = token_files.write_token_files(df, path, tokenizer=PATH)
        assert sorted(r.docs for r in manifest.collect())[-1] < 1500 and manifest.count() == 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(manifest, path).selectExpr("doc_id", "start", "length(ids) div 4", "crc32(ids)").collect()
    assert sorted((r[2], r[3]) for r in got) == sorted(r[2:] for r in brute(rows))
