"""Near-duplicate vectors by int8 tile products with exact error bounds.

Every unit vector ``x`` is stored as ``x = s * q + e`` with ``q`` of int8
components, ``s`` the largest component / 127 and ``|e|`` its measured
quantisation error. For two vectors

    x . y = s_x s_y (q_x . q_y) + d,   |d| <= |e_x| * (1 + |e_y|) + |e_y|

because ``|x| = 1`` and ``|s q| <= 1 + |e|``. A tile product gives all
``q_x . q_y`` at once (integers below 2**24 up to 1040 components, so a
single-precision matrix product is exact); only pairs whose interval
``estimate +- bound`` reaches the threshold are computed again in double
precision from the original components.

Spark deals the work: the vectors of one label are cut into tiles of at most
``tile`` vectors, and every pair of tiles is one row group, so a label that
holds a third of all rows becomes many tasks of equal size. A task returns
counts per vector and a spanning set of the links it found, never the pairs
themselves. The arithmetic stays quadratic in the vectors of one label, which
is what an exact answer by tile products costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.common import components
from rivalry.session import cut_lineage

_ROWS = 512  # rows of a tile compared at a time: bounds the product's memory


def usable(vector: str) -> F.Column:
    """Not NULL, no NULL or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale and error norm of unit rows (doubles). The error
    is rounded up by a few ulps so that it stays a bound."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    err = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q.astype(np.int8), scale, err


def _matrix(blob: bytes, dim: int, dtype) -> np.ndarray:
    return np.frombuffer(blob, dtype=dtype).reshape(-1, dim)


def tile_links(a: dict, b: dict, threshold: float, same: bool):
    """Links between two tiles (or inside one): weighted link counts of both
    sides, a spanning set of the links as index pairs into ``ids_a + ids_b``,
    and how many pairs were computed again."""
    na, nb = len(a["id"]), len(b["id"])
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    root = np.arange(na) if same else np.arange(na + nb)
    shift = 0 if same else na
    real = np.float32 if a["q"].shape[1] * 127 * 127 < 1 << 24 else np.float64
    qb = b["q"].astype(real).T
    rechecked = 0
    for lo in range(0, na, _ROWS):
        hi = min(na, lo + _ROWS)
        dot = (a["q"][lo:hi].astype(real) @ qb).astype(np.float64)
        est = dot * a["scale"][lo:hi, None] * b["scale"][None, :]
        ea, eb = a["err"][lo:hi, None], b["err"][None, :]
        bound = ea * (1 + eb) + eb + 1e-9
        maybe = est + bound >= threshold
        if same:
            maybe &= np.arange(lo, hi)[:, None] < np.arange(nb)[None, :]
        i, j = np.nonzero(maybe)
        rechecked += len(i)
        for at in range(0, len(i), 1 << 16):
            ii, jj = i[at: at + (1 << 16)] + lo, j[at: at + (1 << 16)]
            x, y = a["x"][ii].astype(np.float64), b["x"][jj].astype(np.float64)
            cos = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            hit = cos >= threshold
            ii, jj = ii[hit], jj[hit]
            np.add.at(count_a, ii, b["mult"][jj])
            if same:
                np.add.at(count_a, jj, a["mult"][ii])
            else:
                np.add.at(count_b, jj, a["mult"][ii])
            _union(root, ii, jj + shift)
    return count_a, count_b, root, rechecked


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the sets of u and v in ``root`` (index of the smallest member)."""
    while len(u):
        ru, rv = root[u], root[v]
        differ = ru != rv
        if not differ.any():
            return
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


_TILE = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("tile", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("mult", T.ArrayType(T.LongType())),
    T.StructField("x", T.BinaryType()), T.StructField("q", T.BinaryType()),
    T.StructField("scale", T.ArrayType(T.DoubleType())), T.StructField("err", T.ArrayType(T.DoubleType())),
])
_OUT = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def _pack(pdf: pd.DataFrame, real) -> pd.DataFrame:
    """One tile row from the vectors of a tile."""
    pdf = pdf.sort_values("id", kind="stable")
    x = np.array(pdf["v"].tolist(), dtype=np.float64)
    q, scale, err = quantise(x / np.sqrt((x * x).sum(axis=1))[:, None])
    return pd.DataFrame([{
        "label": pdf["label"].iloc[0], "dim": x.shape[1], "tile": pdf["tile"].iloc[0],
        "ids": pdf["id"].to_numpy(np.int64), "mult": pdf["mult"].to_numpy(np.int64),
        "x": x.astype(real).tobytes(), "q": q.tobytes(), "scale": scale, "err": err,
    }])


def near_duplicates(
    df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label",
    threshold: float = 0.98, tile: int = 4096,
) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept,
    n_copies``.

    Two rows are linked if their labels are equal and not NULL (``label=None``
    compares all rows) and the cosine of their vectors, in double precision,
    is at least ``threshold`` (which must be positive). ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable,
    ``kept`` marks it and ``n_copies`` counts rows with the same vector and
    label.

    Rows whose vector is NULL, zero, or has NULL or non-finite components, and
    rows with a NULL label, link with nothing. Vectors of different lengths
    are never compared. Rows that repeat an id stay separate rows with the
    same component. A row with a NULL id counts only as a copy of a named row
    with the same vector; without one it links with nothing. Exact copies are
    compared once and counted with their multiplicity. An empty input gives no
    rows. Columns of ``df`` other than the three named are ignored.
    """
    if not threshold > 0:
        raise ValueError("threshold must be positive")
    # labels of any type are told apart by their text
    lab = F.col(label).cast("string") if label is not None else F.lit("")
    # components as they were stored: singles stay singles
    real = np.float32 if df.schema[vector].dataType.elementType == T.FloatType() else np.float64
    takes_part = usable("v") & F.col("label").isNotNull()
    text = F.concat_ws(",", F.length("label").cast("string"), "label", F.transform("v", lambda x: x.cast("string")))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), lab.alias("label"))
    # rows that take no part get keys of their own, which spreads them
    src = src.withColumn("good", takes_part).withColumn(
        "key", F.when(F.col("good"), F.sha2(text, 256)).otherwise(F.concat(F.lit("no "), F.coalesce(F.col("id"), F.rand() * 1e9).cast("string"))))
    # one row for each distinct vector of a label, named by its smallest id
    classes = cut_lineage(src.filter("good").groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"), F.first("label").alias("label"),
    ).filter(F.col("id").isNotNull()).withColumn("dim", F.size("v")))
    # tiles: per (label, length) as many as keep each at the tile size on average
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("long"))
    tiles = cut_lineage(dealt.select("label", "dim", "tile", "id", "mult", "v").groupBy("label", "dim", "tile").applyInPandas(
        lambda pdf: _pack(pdf, real), _TILE))
    other = tiles.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("tile", "ids", "mult", "x", "q", "scale", "err")])
    at = tiles.select("label", "dim", "tile")
    pairs = at.join(at.withColumnRenamed("tile", "tile_b"), ["label", "dim"]).filter("tile <= tile_b")
    work = pairs.join(tiles, ["label", "dim", "tile"]).join(other, ["label", "dim", "tile_b"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        side = []
        for s in ("", "_b"):
            side.append({
                "id": np.asarray(r["ids" + s], np.int64), "mult": np.asarray(r["mult" + s], np.int64),
                "x": _matrix(r["x" + s], r["dim"], real), "q": _matrix(r["q" + s], r["dim"], np.int8),
                "scale": np.asarray(r["scale" + s], np.float64), "err": np.asarray(r["err" + s], np.float64),
            })
        same = bool(r["tile"] == r["tile_b"])
        ca, cb, root, _ = tile_links(side[0], side[1], threshold, same)
        ids = side[0]["id"] if same else np.concatenate([side[0]["id"], side[1]["id"]])
        n = ca if same else np.concatenate([ca, cb])
        linked = n > 0
        return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]], "n": n[linked]})

    # each pair of tiles is a group of one row, so one task never holds more than it compares
    found = cut_lineage(work.groupBy("label", "dim", "tile", "tile_b").applyInPandas(compare, _OUT))
    comp = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    per_class = (
        classes.select("key", "id", "mult").join(counts, "id", "left").join(comp, "id", "left")
        .select("key", F.col("mult").alias("n_copies"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
    )
    out = src.select("id", "key").join(per_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
