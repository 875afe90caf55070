import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rivalry.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)
ALPHABET = token_alignment.byte_alphabet()


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text):
    if not text:
        return [], []
    e = TOK.encode(" " + text, add_special_tokens=False)
    a = [(k, bytes(ALPHABET[c] for c in t)) for k, t in zip(e.ids, e.tokens)]
    b = [(k, bytes([k - 3]) if SP.is_byte(k) else SP.id_to_piece(k).replace("▁", " ").encode()) for k in SP.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(t for _, t in a) == raw == b"".join(t for _, t in b) else ([], [])


def brute(rows):
    """All pairs of token occurrences whose byte ranges overlap, one document at a time."""
    found, total = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text)
        sa, sb = spans([t for _, t in a]), spans([t for _, t in b])
        links, first = [], 0
        for j, (x, y) in enumerate(sb):
            while first < len(sa) and sa[first][1] <= x:
                first += 1
            i = first
            while i < len(sa) and sa[i][0] < y:
                links.append((a[i][0], b[j][0]))
                i += 1
        total.update(links)
        both = sorted({y for _, y in sa} & {y for _, y in sb})
        at = lambda s: sum(e < s[1] for e in both) if len(both) < 200 else int(np.searchsorted(both, s[1]))
        groups = defaultdict(lambda: ([], []))
        for (k, _), s in zip(a, sa):
            groups[at(s)][0].append(str(k))
        for (k, _), s in zip(b, sb):
            groups[at(s)][1].append(str(k))
        text = ";".join(",".join(x) + "|" + ",".join(y) for _, (x, y) in sorted(groups.items()))
        found.append((doc_id, len(a), len(b), len(both), links, hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    high = defaultdict(int)
    for (_, kb), n in total.items():
        high[kb] = max(high[kb], n)
    docs = [(d, na, nb, ng, len(ls), sum(total[x] == high[x[1]] for x in ls), sum(total[x] for x in ls), h) for d, na, nb, ng, ls, h, _ in found]
    return docs, {(kb, ka): (n, n == high[kb]) for (ka, kb), n in total.items()}, [f[-1] for f in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op11_token_alignment"](spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows)[0])


ODD = ["", None, " ", "  two  spaces ", " lead", "trail ", "a\n b", "a \n b", "tab\t x", "\x1c a", "a\x00 \x00b", "it's we'll 'S", "<|endoftext|> a<|endoftext|>b",
       "<s> </s> <unk> <0x41>", "é 漢字 \U0001f600 x", "1234 56,7", "word " * 300 + "x" * 2000, "a marker ▁ in it", "▁", "one\ntwo three\nfour", "\nx", "x\n", "x\n\ny",
       "a\n\n\nb\n\n", "l m\nn", "ﬁ ½ ①", " nbsp", "é combining", "tie", "tie"]


@pytest.mark.parametrize("records,fan_in,digits", [(1, 2, 3), (500, 3, 1), (2_000_000, 128, 256)])
def test_edges_and_spilling(spark, records, fan_in, digits):
    rng = np.random.default_rng(2)
    texts = ODD + ["".join(rng.choice(list("ab .\n\n  é1<"), int(rng.integers(0, 30)))) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS run", "2 AS ordinal", "'q' AS groups", "3 AS digit")
    found = token_alignment.align(df, a_path=A, b_path=B, run_records=records, fan_in=fan_in, digits=digits, with_groups=True)
    docs, pairs, groups = brute(rows)
    key = lambda r: (r[0] is None, r)
    got = found.documents.select(*COLUMNS, "groups").collect()
    assert sorted((tuple(r)[:-1] for r in got), key=key) == sorted(docs, key=key)
    assert sorted(r.groups for r in got) == sorted(groups)
    assert {(r.b_id, r.a_id): (r["count"], r.best) for r in found.pairs.collect()} == pairs


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    found = token_alignment.align(df, a_path=A, b_path=B)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def test_heap_merge_and_cells():
    rng = np.random.default_rng(4)
    cells, want = [], Counter()
    for _ in range(9):
        p = np.unique(rng.integers(0, 200, 50))
        c = rng.integers(1, 9, len(p))
        cells.append((p, c))
        want.update(dict(zip(p.tolist(), c.tolist())))
    pairs, counts = token_alignment.merge_counts(cells)
    assert dict(zip(pairs.tolist(), counts.tolist())) == want and (np.diff(pairs) > 0).all()
    for back, x in zip(token_alignment._unpack(token_alignment._pack(pairs, counts, pairs[:0])), (pairs, counts, pairs[:0])):
        assert (back == x).all() and len(back) == len(x)
