"""The forest by histograms against Spark's own."""

import base64
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from rivalry.operators import forest as R
from rivalry.operators import ml as M

CATS, NUMS = ["c", "few", "many"], ["x", "z", "some", "flat"]


def rows_of(n, classes=3, seed=3):
    rnd = random.Random(seed)
    for i in range(n):
        x, z, c = rnd.random(), rnd.gauss(0, 1), rnd.choice("abcde")
        many = f"m{rnd.randrange(25)}"
        y = 3 * x + z * z / 2 + (c in "ab") + (int(many[1:]) % 4 == 1) + rnd.gauss(0, 0.4)
        yield (i, x, z, float(rnd.randrange(3)), 1.0, c, "u" if i % 9 else None, many, sum(y > cut for cut in (2.0, 3.0)[: classes - 1]))


def table(spark, n=3000, classes=3):
    return spark.createDataFrame(list(rows_of(n, classes)), "id long, x double, z double, some double, flat double, c string, few string, many string, k int").repartition(3, "id")


def ready(df):
    return M._prepared(df, "k", CATS, NUMS, 42)


def probabilities(model, data):
    return np.array([r[0].toArray() for r in model.transform(data).select("probability").collect()])


@pytest.mark.parametrize("classes", [2, 3])
def test_a_tree_is_sparks_tree(spark, classes):
    data = ready(table(spark, classes=classes))
    blocks = R.blocks_of(data, bins=32)
    for depth in (0, 3, 7):
        want = DecisionTreeClassifier(maxDepth=depth, maxBins=32, seed=42).fit(data)
        got = R.fit_forest(RandomForestClassifier(maxDepth=depth, maxBins=32, numTrees=1, seed=42), blocks, bootstrap=False)
        assert got.trees[0].toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]
        assert np.allclose(probabilities(got, data), probabilities(want, data), rtol=1e-12, atol=0)


def test_counts_of_several_passes_and_blocks(spark, monkeypatch):
    data = ready(table(spark))
    whole = R.grow(R.blocks_of(data, bins=32), trees=5, depth=4, bootstrap=False)
    monkeypatch.setattr(R, "BLOCK_ROWS", 100)
    monkeypatch.setattr(R, "COUNTS_MB", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        blocks = R.blocks_of(data, bins=32)
        assert blocks.df.count() > 20 and blocks.df.agg(F.sum("n")).first()[0] == 3000
        parts = R.grow(blocks, trees=5, depth=4, bootstrap=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for a, b in zip(whole, parts, strict=True):
        assert all((getattr(a, x) == getattr(b, x)).all() for x in ("feature", "right", "gain", "counts"))
    assert len({tuple(level.feature[t]) for level in whole[:1] for t in range(5)}) > 1


def test_bootstrap_draws():
    drawn = R.bag(42, 7, 3, 400_000)
    assert (drawn == R.bag(42, 7, 3, 400_000)).all() and (drawn != R.bag(42, 7, 4, 400_000)).any()
    share = np.bincount(drawn, minlength=6) / len(drawn)
    assert share[:5] == pytest.approx(np.exp(-1.0) / np.array([1, 1, 2, 6, 24]), abs=0.004)
    assert drawn.max() < 13


def test_large_tables_are_fitted_by_histograms_as_well(spark, monkeypatch):
    df = table(spark, 6000)
    spark_model = M.train_result(df, target="k", categorical=CATS, numeric=NUMS, max_depth=6, num_trees=30)
    found = M.search_result(df, target="k", categorical=CATS, numeric=NUMS, depths=[2, 6], trees=[5, 20])
    fits, fit = [], R.fit_forest
    monkeypatch.setattr(M, "SPARK_FOREST_ROWS", 0)
    monkeypatch.setattr(M, "fit_forest", lambda c, b: fits.append(c.getNumTrees()) or fit(c, b))
    model = M.train_result(df, target="k", categorical=CATS, numeric=NUMS, max_depth=6, num_trees=30)
    again = M.search_result(df, target="k", categorical=CATS, numeric=NUMS, depths=[2, 6], trees=[5, 20])
    assert sorted(fits) == [5, 20, 30]
    assert model.stages[-1].getNumTrees == 30 and {t.depth for t in model.stages[-1].trees} == {6}
    held = table(spark, 2000)
    assert set(spark_model.transform(held).columns) == set(model.transform(held).columns)
    close = [M.result_accuracy(m.transform(held), target="k") for m in (spark_model, model)]
    assert close[1] == pytest.approx(close[0], abs=0.03)
    f1 = lambda s: {(t["max_depth"], t["num_trees"]): t["f1"] for t in s.trials}
    assert f1(again) == pytest.approx(f1(found), abs=0.06)


def test_null_classes_raise(spark):
    df = table(spark, 50).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("k")))
    with pytest.raises(ValueError, match="NULL"):
        R.blocks_of(ready(df), bins=32)


def test_functions_travel_without_the_package():
    sent = base64.b64encode(cloudpickle.dumps(R.bag)).decode()
    code = f"import base64, pickle; print(pickle.loads(base64.b64decode('{sent}'))(42, 7, 3, 20).tolist())"
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env={"PYTHONSAFEPATH": "1"}, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == str(R.bag(42, 7, 3, 20).tolist())
