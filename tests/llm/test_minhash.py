import random
import re

import numpy as np

import corpus_pipeline
from rivalry.llm import minhash, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i: i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    """(id, text) rows -> set of (id, set size, component) by an inverted index
    over all shingles."""
    sets = [shingles(t, width) for _, t in rows]
    at = {}
    for k, s in enumerate(sets):
        for g in s:
            at.setdefault(g, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        for j in {j for g in s for j in at[g] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for k, r in enumerate(rows):
        low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return {(r[0], len(sets[k]), low[find(k)]) for k, r in enumerate(rows)}


def rows_of(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_against_an_inverted_index(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op6_minhash_near_dedup"](spark, sf_dir)
    assert rows_of(got) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_groups_whose_pivot_is_far_from_some_members(spark):
    """Variants of an original lie within 0.8 of it but not of each other, and
    a chain links its ends only through the middle."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    rows, k = [], 100
    for _ in range(4):
        base = rnd.choices(words, k=120)
        rows.append((k + 50, " ".join(base)))
        for v in range(30):
            w = list(base)
            for p in rnd.sample(range(120), 3):
                w[p] = rnd.choice(words)
            rows.append((k + v, " ".join(w)))
        chain = list(rnd.choices(words, k=100))
        for v in range(20):
            rows.append((k + 60 + v, " ".join(chain[v * 2: v * 2 + 60])))
        k += 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(minhash.near_duplicates(df, width=4))
    assert got == brute(rows, 4)
    assert len({c for _, _, c in got}) < len(rows)


def test_nulls_blanks_short_texts_copies_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "One two"), (5, "one\ttwo "), (6, "one"), (7, "two one"), (8, "é a b"),
            (9, "é a b"), (10, long), (11, long.upper()), (11, long), (12, long + " tail"), (13, "a b c d a b c d"), (14, "a b c d a b c d a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS component_id", "0 AS n", "'x' AS id")
    got = rows_of(minhash.near_duplicates(df, width=4))
    assert got == brute(rows, 4)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (None, "z y x w v")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, False)], key=str)


def test_word_hashes_do_not_depend_on_position():
    texts = ["alpha beta", "beta", "x alpha  beta", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    with np.errstate(over="ignore"):
        h, row = minhash.word_hashes(data, offsets)
    assert row.tolist() == [0, 0, 1, 2, 2, 2]
    assert h[1] == h[2] == h[5] and h[0] == h[4] and len(set(h.tolist())) == 3


def test_texts_that_share_an_id_are_compared_each(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    rows = [(7, x), (7, y), (8, y + " more"), (9, x + " more"), (3, z), (7, z + " end"), (5, x), (5, x), (11, "q r s t u"), (11, "Q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=5).collect())
    assert got == sorted([(7, 96, 5, False), (7, 96, 7, True), (8, 97, 7, False), (9, 97, 5, False), (3, 96, 3, True), (7, 97, 3, False),
                          (5, 96, 5, True), (5, 96, 5, True), (11, 1, 11, True), (11, 1, 11, True)])
    left = sorted((r.doc_id, r.text.lower()) for r in corpus_pipeline.unique(spark, df, "").collect())
    assert left == sorted([(7, y), (3, z), (5, x), (11, "q r s t u")])


def variants(seed, groups, members, changed, length=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(groups):
        base = rnd.choices(words, k=length)
        for _ in range(members):
            w = list(base)
            for p in rnd.sample(range(length), changed):
                w[p] = rnd.choice(words)
            rows.append((k, " ".join(w)))
            k += 1
    rnd.shuffle(rows)
    return rows


def test_tiles_of_groups_in_which_few_pairs_are_linked(spark, monkeypatch):
    """Variants that mostly lie just below the similarity stay in many
    components: whole tiles of them, in several blocks, one by one or as matrices."""
    rows = variants(3, 3, 60, 4) + [(1000 + i, t) for i, t in variants(4, 2, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert len({c for _, _, c in want}) > 20
    for block, few in ((256, 0), (16, 0), (16, 10**6)):
        monkeypatch.setattr(minhash, "_BLOCK", block)
        monkeypatch.setattr(minhash, "_FEW", few)
        assert rows_of(minhash.near_duplicates(df, width=4)) == want


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, int(rng.integers(0, 80)))).astype(np.uint64) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = minhash.intersections(sets, columns=32)
    off = ~np.eye(len(sets), dtype=bool)
    assert (got[off] == np.array(want)[off]).all()
