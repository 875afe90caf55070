import numpy as np
import pandas as pd

from rivalry.operators.scan import ordered_scan


def _brute(pdf):
    pdf = pdf.sort_values(["k", "o"]).reset_index(drop=True)
    g = pdf.groupby("k", sort=False)
    pdf["rn"] = g.cumcount() + 1
    pdf["cs"] = g["v"].cumsum()
    for k in range(1, 4):
        pdf[f"s_lag{k}"] = g["s"].shift(k)
    pdf["ff"] = g["m"].ffill()
    return pdf


def test_scan_matches_bruteforce_with_hot_key(spark):
    rng = np.random.default_rng(7)
    n = 4000
    # one key holds most rows so it spans many range partitions
    k = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", "d"], n))
    pdf = pd.DataFrame(
        {
            "k": k,
            "o": rng.permutation(n).astype("int64"),
            "v": rng.integers(0, 5, n).astype("int64"),
            "s": rng.choice(["W", "D", "L"], n),
            "m": np.where(rng.random(n) < 0.97, np.nan, rng.integers(1, 9, n)),
        }
    )
    df = spark.createDataFrame(pdf, "k string, o long, v long, s string, m double")
    got = ordered_scan(
        df, ["k"], ["o"], row_number="rn", sums={"cs": "v"}, lags={"s": 3}, ffill={"ff": "m"},
        num_partitions=16,
    ).toPandas()
    want = _brute(pdf)
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    assert (got["rn"].to_numpy() == want["rn"].to_numpy()).all()
    assert (got["cs"].to_numpy() == want["cs"].to_numpy()).all()
    for j in range(1, 4):
        a = got[f"s_lag{j}"].fillna("-").to_numpy()
        b = want[f"s_lag{j}"].fillna("-").to_numpy()
        assert (a == b).all(), j
    a = got["ff"].fillna(-1).to_numpy()
    b = want["ff"].fillna(-1).to_numpy()
    assert (a == b).all()


def test_scan_across_arrow_batches(spark):
    """Tiny Arrow batches force the cross-batch halo and carry paths."""
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c"], n)),
            "o": rng.permutation(n).astype("int64"),
            "v": rng.integers(0, 5, n).astype("int64"),
            "s": rng.choice(["W", "D", "L"], n),
            "m": np.where(rng.random(n) < 0.98, np.nan, rng.integers(1, 9, n)),
        }
    )
    df = spark.createDataFrame(pdf, "k string, o long, v long, s string, m double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = ordered_scan(
            df, ["k"], ["o"], row_number="rn", sums={"cs": "v"}, lags={"s": 5}, ffill={"ff": "m"},
            num_partitions=7,
        ).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = _brute(pdf)
    g = want.groupby("k", sort=False)
    for k in (4, 5):
        want[f"s_lag{k}"] = g["s"].shift(k)
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    assert (got["rn"].to_numpy() == want["rn"].to_numpy()).all()
    assert (got["cs"].to_numpy() == want["cs"].to_numpy()).all()
    for j in range(1, 6):
        assert (got[f"s_lag{j}"].fillna("-").to_numpy() == want[f"s_lag{j}"].fillna("-").to_numpy()).all(), j
    assert (got["ff"].fillna(-1).to_numpy() == want["ff"].fillna(-1).to_numpy()).all()


def test_scan_without_keys(spark):
    """A global order (no key) is still split over partitions."""
    pdf = pd.DataFrame({"o": np.arange(500, 0, -1, dtype="int64"), "v": np.ones(500, dtype="int64")})
    got = ordered_scan(spark.createDataFrame(pdf), [], ["o"], row_number="rn", sums={"cs": "v"},
                       num_partitions=5).toPandas().sort_values("o")
    assert got["rn"].tolist() == list(range(1, 501))
    assert got["cs"].tolist() == list(range(1, 501))


def test_scan_with_coalesced_ranges(spark):
    """Default partitioning: AQE merges adjacent range partitions; the
    merged ranges must still chain correctly."""
    rng = np.random.default_rng(5)
    n = 6000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n)),
            "o": rng.permutation(n).astype("int64"),
            "v": rng.integers(0, 5, n).astype("int64"),
            "s": rng.choice(["W", "D", "L"], n),
            "m": np.where(rng.random(n) < 0.97, np.nan, rng.integers(1, 9, n)),
        }
    )
    df = spark.createDataFrame(pdf, "k string, o long, v long, s string, m double")
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    old = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        out = ordered_scan(df, ["k"], ["o"], row_number="rn", sums={"cs": "v"}, lags={"s": 3}, ffill={"ff": "m"})
        parts = out.select("_pid").distinct().count() if "_pid" in out.columns else None
        got = out.toPandas()
    finally:
        for k, v in old.items():
            if v is not None:
                spark.conf.set(k, v)
    del parts
    want = _brute(pdf)
    got = got.sort_values(["k", "o"]).reset_index(drop=True)
    assert (got["rn"].to_numpy() == want["rn"].to_numpy()).all()
    assert (got["cs"].to_numpy() == want["cs"].to_numpy()).all()
    for j in range(1, 4):
        assert (got[f"s_lag{j}"].fillna("-").to_numpy() == want[f"s_lag{j}"].fillna("-").to_numpy()).all(), j
    assert (got["ff"].fillna(-1).to_numpy() == want["ff"].fillna(-1).to_numpy()).all()


def test_scan_keeps_values_as_they_are(spark):
    """LONGs above 2^53 beside NULLs, NaNs and decimals come through unchanged."""
    from decimal import Decimal

    big = 9007199254740993
    rows = [("a", i, big + i if i % 3 else None, float("nan") if i % 4 == 0 else float(i), Decimal("0.10"), None if i % 5 else big) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v long, x double, d decimal(10,2), f long")
    got = ordered_scan(df, ["k"], ["o"], sums={"cs": "v", "cd": "d"}, lags={"v": 2, "x": 1}, ffill={"ff": "f", "fx": "x"}, num_partitions=7)
    assert dict(got.dtypes)["cs"] == "bigint" and dict(got.dtypes)["cd"].startswith("decimal")
    total, lastf = 0, None
    for i, r in enumerate(sorted(got.collect(), key=lambda r: r.o)):
        total += rows[i][2] or 0
        lastf = rows[i][5] if rows[i][5] is not None else lastf
        assert r.rn == i + 1 and r.v == rows[i][2] and r.cs == total and r.cd == Decimal("0.10") * (i + 1) and r.ff == lastf
        assert r.v_lag1 == (rows[i - 1][2] if i else None) and r.v_lag2 == (rows[i - 2][2] if i > 1 else None)
        want = rows[i][3]
        assert (np.isnan(r.x) and np.isnan(r.fx)) if np.isnan(want) else r.x == r.fx == want


def test_scan_refuses_null_keys(spark):
    import pytest

    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, o long")
    with pytest.raises(Exception, match="NULL in key column k"):
        ordered_scan(df, ["k"], ["o"]).collect()
