import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivalry.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


def window_cost(size, length):
    return 0 if size & (size - 1) == 0 else length - size


def brute_cost(places, costs, length):
    """Least (cost, windows) by comparing every pair of places."""
    best = {0: (0, 0)}
    for j in range(1, len(places)):
        best[j] = min((best[i][0] + window_cost(places[j] - places[i], length) + costs[j], best[i][1] + 1)
                      for i in range(j) if places[j] - places[i] <= length)
    return best[len(places) - 1]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([8, 16, 32]))
    docs = np.cumsum(rng.integers(1, 3 * length, int(rng.integers(1, 30))))
    sentences = np.setdiff1d(rng.integers(1, docs[-1], int(rng.integers(0, 60))) if docs[-1] > 1 else [], [])
    places, costs = packing.cut_places(docs, sentences.astype(np.int64), length=length, sentence_cost=3, token_cost=10)
    assert (np.diff(places) <= length).all() and set(docs) | set(sentences) <= set(places.tolist())
    at = [0, *packing.best_cuts(places, costs, length)]
    assert at[-1] == len(places) - 1
    got = sum(window_cost(int(places[b] - places[a]), length) + int(costs[b]) for a, b in zip(at, at[1:]))
    assert (got, len(at) - 1) == brute_cost(places.tolist(), costs.tolist(), length)


def check_pieces(rows, pieces, length=2048):
    """Each id lies in one piece, sequences are gapless, hashes are those of the library's ids."""
    want = sorted((i, t or "") for i, t in rows if i is not None)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, text in want:
        ids = np.array(TOK.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at: at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
        sizes.append(at)
    return sizes


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sizes = check_pieces(rows, queries.QUERIES["op13_packing"](spark, sf_dir).collect())
    padding = sum(window_cost(s, 2048) for s in sizes)
    assert padding <= 0.01 * sum(sizes)


@pytest.mark.parametrize("length,block", [(16, 50), (64, 1), (2048, 1 << 22)])
def test_edges(spark, length, block):
    odd = ["", None, " ", "One. Two! Three?\nFour", "x" * 5000, "word " * 3000, "  a", "a\n\nb", "3.14 is pi. Yes", "é 漢字 \U0001f600 x", "<|endoftext|>", "tie"]
    rows = [(i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows + [(None, "no id"), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS start", "'x' AS sequence_id")
    out = packing.pack(df, tokenizer=PATH, length=length, block=block, with_ids=True)
    pieces = out.collect()
    check_pieces(rows, pieces, length)
    assert sum(p.length for p in pieces if p.doc_id is None) == len(TOK.encode("no id").ids) + 2
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(7, "same text")] * 5, "doc_id long, text string")
    pieces = packing.pack(df, tokenizer=PATH).collect()
    assert sum(p.length for p in pieces) == 5 * (len(TOK.encode("same text").ids) + 1)
    assert packing.pack(df.limit(0), tokenizer=PATH).collect() == []
