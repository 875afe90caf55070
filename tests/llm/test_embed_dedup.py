import math
from datetime import date

import numpy as np
import pytest

from rivalry.llm import embed_dedup, queries


def brute(rows, threshold=0.98):
    """rows of (id, vector, label) -> {id: (n_links, component)} by all pairs."""
    ok = []
    for i, v, g in rows:
        good = v is not None and g is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
        ok.append(good)
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(rows)):
        for q in range(p):
            if ok[p] and ok[q] and rows[p][2] == rows[q][2] and len(rows[p][1]) == len(rows[q][1]):
                x, y = np.array(rows[p][1], float), np.array(rows[q][1], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    n[p] += 1
                    n[q] += 1
                    a, b = find(p), find(q)
                    root[max(a, b)] = min(a, b)
    low = {}
    for p, r in enumerate(rows):
        low[find(p)] = min(low.get(find(p), r[0]), r[0])
    return {(r[0], n[p], low[find(p)]) for p, r in enumerate(rows)}


def rows_of(df):
    return {(r.vec_id, r.n_links, r.component_id) for r in df.collect()}


def test_whole_table_against_all_pairs(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    got = queries.QUERIES["op1_embedding_near_dedup"](spark, sf_dir)
    assert rows_of(got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_chains_copies_and_unusable_vectors_over_small_tiles(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):  # a chain: neighbours are linked, the ends are not
        rows.append((i, [float(math.cos(0.15 * i)), float(math.sin(0.15 * i)), 0.0], 1))
    for i in range(40, 60):
        rows.append((i, [0.0, 0.0, 2.0], 1))  # copies
    for i in range(60, 80):
        rows.append((i, [float(c) for c in rng.normal(size=3)], 2))
    rows += [(80, None, 1), (81, [0.0, 0.0, 0.0], 1), (82, [1.0, None, 0.0], 1), (83, [1.0, float("nan"), 0.0], 1),
             (84, [float("inf"), 0.0, 0.0], 1), (85, [1.0, 0.0, 0.0], None), (86, [1.0, 0.0], 1), (87, [], 1), (88, [0.0, 0.0, 7.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "label")
    df = df.selectExpr("*", "1 AS component_id", "2 AS n_links")  # clashing names
    got = embed_dedup.near_duplicates(df, tile=8)
    assert rows_of(got) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (None, 1, 2, False), (None, 0, None, False)], key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_bound_covers_the_quantisation_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, err = embed_dedup.quantise(x)
    est = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale[None]
    bound = err[:, None] * (1 + err[None]) + err[None]
    assert (np.abs(est - x @ x.T) <= bound + 1e-9).all()


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        embed_dedup.near_duplicates(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int"), threshold=0)


def test_labels_of_other_types(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    for kind, labels in (("string", ["a", "a", "b", "1,2", None]), ("double", [1.2, 1.2, 1.4, 1.0, None]), ("date", None)):
        labels = labels or [date(2020, 1, 1), date(2020, 1, 1), date(2020, 1, 2), date(2021, 1, 1), None]
        rows = [(i, lab, v if i % 2 else w) for i, lab in enumerate(labels)]
        df = spark.createDataFrame(rows, f"vec_id long, label {kind}, embedding array<double>")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
        assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (0, 4)}
