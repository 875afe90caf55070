import numpy as np
import pytest
from pyspark.sql import functions as F

from rivalry.llm import ann_forest, queries


def brute(rows, asks, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in ok:
        if asks(i):
            best = {}
            for j, x in ok:
                if j != i and len(x) == len(q):
                    best[j] = max(best.get(j, -np.inf), float(q @ x))
            out[i] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def gathered(df):
    got = {}
    for r in sorted(df.collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    hit = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_recall_of_the_registered_query(spark, table):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{table}/embeddings.parquet").collect()]
    got = gathered(queries.QUERIES["op8_ann_forest"](spark, table))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want) and all(len(found) == 20 for found in got.values())
    # the forest is searched, not the table
    assert 0.9 <= recall(got, want) < 1
    vec = dict(rows)
    for i, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - np.dot(np.array(vec[i], float), np.array(vec[j], float))) < 1e-12 for j, s in found)


def test_blocks_do_not_change_the_answer(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    one, many = (gathered(ann_forest.nearest(df, F.col("vec_id") % 20 == 0, **sizes)) for sizes in ({}, {"block": 30, "query_block": 7}))
    assert {i: [j for j, _ in w] for i, w in one.items()} == {i: [j for j, _ in w] for i, w in many.items()}


def test_whole_forest_is_exact(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 20 == 0, 20)
    got = gathered(ann_forest.nearest(df, F.col("vec_id") % 20 == 0, share=1.0))
    assert {i: [j for j, _ in w] for i, w in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}


def test_norms_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.normal(size=4) * (1 + i % 9)]) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300, 420)]  # equal vectors, many to a leaf
    rows += [(420, None), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan")] * 4), (500, [1.0, 2.0]), (None, [9.0] * 4),
             (520, [float("inf"), 0.0, 0.0, 0.0]), (40, rows[40][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS query_id", "3 AS leaf")
    rows = [r for r in rows if r[0] != 500]
    got = gathered(ann_forest.nearest(df, F.col("vec_id") % 20 == 0, k=5, block=16, share=1.0))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    assert {i: [j for j, _ in w] for i, w in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert gathered(ann_forest.nearest(df, F.col("vec_id") == 0)) == {0: [(1, 0.5), (2, -1.0)]}
    # fewer candidates than k: all of them
    some = spark.range(15).selectExpr("id AS vec_id", "array(sin(id), cos(id), 1D) AS embedding")
    assert all(len(found) == 14 for found in gathered(ann_forest.nearest(some, F.lit(True))).values())
    assert ann_forest.nearest(df.limit(0), F.lit(True)).collect() == []
    assert ann_forest.nearest(df.limit(1), F.lit(True)).collect() == []
