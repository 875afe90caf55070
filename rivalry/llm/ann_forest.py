"""Approximate nearest neighbours: a forest of random-projection trees,
searched through one priority queue, with exact reranking.

Trees are fitted on a bounded sample (``sample`` vectors, about): a node
splits its sample at the median of its projection on the difference of two of
its vectors. All rows are then indexed: each gets its leaf in every tree. A
query keeps one queue over all trees, ordered by how far it is on the wrong
side of the splits above a node, and opens leaves until those cover ``share``
of the sample. Inner products are turned into distances by one more
coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that the trees serve
the inner product as well as the cosine.

Leaves are dealt to tasks in blocks of at most ``block`` rows, with their
queries; a leaf with very many equal vectors becomes many blocks. A task
returns, for each of its queries, the nearest of its block by exact double
precision inner product; what is merged per query does not grow with the
size of a block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.embed_dedup import usable
from rivalry.session import cut_lineage


def grow(x: np.ndarray, leaves: int, rng) -> list:
    """A tree over the rows of ``x``: nodes are ``(normal, split, left, right)``
    or ``(None, rows)``; the root is the last."""
    size = max(2, -(-len(x) // leaves))
    nodes: list = []

    def add(rows: np.ndarray) -> int:
        if len(rows) > size:
            for _ in range(3):  # equal vectors give no direction
                a, b = x[rng.choice(rows, 2, replace=False)]
                normal = a - b
                p = x[rows] @ normal
                split = float(np.median(p))
                below = p < split
                if 0 < below.sum() < len(rows):
                    left, right = add(rows[below]), add(rows[~below])
                    nodes.append((normal / np.linalg.norm(normal), split / float(np.linalg.norm(normal)), left, right))
                    return len(nodes) - 1
        nodes.append((None, rows))
        return len(nodes) - 1

    add(np.arange(len(x)))
    return nodes


def leaf_of(nodes: list, x: np.ndarray) -> np.ndarray:
    """The leaf (node number) of every row of ``x``."""
    out = np.empty(len(x), np.int64)
    work = [(len(nodes) - 1, np.arange(len(x)))]
    while work:
        k, rows = work.pop()
        node = nodes[k]
        if node[0] is None:
            out[rows] = k
        elif len(rows):
            below = x[rows] @ node[0] < node[1]
            work += [(node[2], rows[below]), (node[3], rows[~below])]
    return out


def visit(forest: list, covers: list, q: np.ndarray, need: int, n: int) -> list[tuple[int, int]]:
    """The leaves ``(tree, node)`` a query opens, nearest first, until they
    cover ``need`` of the ``n`` sample rows."""
    heap = [(0.0, t, len(nodes) - 1) for t, nodes in enumerate(forest)]
    seen, out = np.zeros(n, bool), []
    while heap:
        far, t, k = heapq.heappop(heap)
        node = forest[t][k]
        if node[0] is None:
            out.append((t, k))
            seen[covers[t][k]] = True
            if int(seen.sum()) >= need:
                break
        else:
            side = float(q @ node[0]) - node[1]
            near, other = (node[2], node[3]) if side < 0 else (node[3], node[2])
            heapq.heappush(heap, (far, t, near))
            heapq.heappush(heap, (max(far, abs(side)), t, other))
    return out


def _doubles(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(
    df: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", trees: int = 12, leaves: int = 32,
    sample: int = 16_384, share: float = 0.7, block: int = 4096, query_block: int = 4096, seed: int = 5,
) -> DataFrame:
    """For every row that fulfils ``queries`` (a condition on ``df``'s
    columns) its ``k`` nearest other rows found: ``query_id, rank, vec_id,
    score``, by largest inner product in double precision, equal scores to the
    smaller id.

    A query opens leaves until they cover ``share`` of the sample, and the
    ``k`` + 1 rows that an answer needs. ``share`` trades work for recall;
    directions without any structure need a large one. A query never finds rows with its own id; ids that repeat
    appear once, with their best score. Vectors that are NULL, zero or hold
    NULL or non-finite components, rows without an id, and vectors of another
    length than the most frequent one take no part. Fewer than ``k``
    candidates are all returned; an empty table gives no rows. Other columns
    of ``df`` are ignored.
    """
    spark = df.sparkSession
    real = np.float32 if df.schema[vector].dataType.elementType == T.FloatType() else np.float64
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(
        usable("v") & F.col("id").isNotNull())
    out_schema = "query_id long, rank int, vec_id long, score double"
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    lengths = src.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    dim, n, most = lengths["dim"], lengths["n"], lengths["most"]
    src = src.filter(F.size("v") == dim)
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    # about ``sample`` vectors reach the driver
    picked = src.filter(draw < min(1.0, sample / n)).select("v").limit(2 * sample).toPandas()["v"].tolist()
    points = np.array(picked if picked else src.select("v").limit(1).toPandas()["v"].tolist(), dtype=np.float64)

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    rng = np.random.default_rng(seed)
    points = lifted(points)
    forest = [grow(points, leaves, rng) for _ in range(trees)]
    # a sample row on a split may be routed to its other side: it counts where rows are looked up
    placed = [leaf_of(nodes, points) for nodes in forest]
    covers = [{i: np.flatnonzero(at == i) for i, node in enumerate(nodes) if node[0] is None} for nodes, at in zip(forest, placed, strict=True)]
    need = min(len(points), max(int(np.ceil(share * len(points))), k + 1))
    shared = spark.sparkContext.broadcast((forest, covers, len(points), need))

    def index(batches):
        forest, _, _, _ = shared.value
        for batch in batches:
            x = _doubles(batch.column(1), dim)
            up = lifted(x)
            at = np.stack([leaf_of(nodes, up) for nodes in forest], axis=1) if len(x) else np.empty((0, len(forest)), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(forest)), pa.array(at.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(real)], pa.binary()), lists], names=["id", "v", "leaf"])

    def route(batches):
        forest, covers, n_points, need = shared.value
        for batch in batches:
            x = _doubles(batch.column(1), dim)
            ids, blobs, tree, leaf = [], [], [], []
            for i, q in zip(batch.column(0).to_pylist(), x):
                blob = q.astype(real).tobytes()
                for t, node in visit(forest, covers, np.append(q, 0.0), need, n_points):
                    ids.append(i)
                    blobs.append(blob)
                    tree.append(t)
                    leaf.append(node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(blobs, pa.binary()), pa.array(tree, pa.int32()), pa.array(leaf, pa.int64())], names=["id", "v", "tree", "leaf"])

    indexed = src.select("id", "v").mapInArrow(index, "id long, v binary, leaf array<long>").select("id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    asked = src.filter("asks").select("id", "v").distinct().mapInArrow(route, "id long, v binary, tree int, leaf long")
    # at most trees * leaves rows, give or take the uneven splits
    cells = cut_lineage(indexed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).join(
        asked.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("q_blocks")), ["tree", "leaf"]))
    key = ["tree", "leaf", "block", "q_block"]
    rows = indexed.join(F.broadcast(cells), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1))).select(*key, "id", "v")
    asks = asked.join(F.broadcast(cells), ["tree", "leaf"]).withColumn("q_block", F.pmod(F.xxhash64("id"), F.col("q_blocks"))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*key, "id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids = left["id"].to_numpy()
            x = np.frombuffer(b"".join(left["v"]), real).reshape(len(left), dim).astype(np.float64)
            qs = np.frombuffer(b"".join(right["v"]), real).reshape(len(right), dim).astype(np.float64)
            for lo in range(0, len(qs), 256):
                q, qid = qs[lo: lo + 256], right["id"].to_numpy()[lo: lo + 256]
                dot = q @ x.T
                dot[qid[:, None] == ids[None, :]] = -np.inf
                for r in range(len(q)):
                    # a little more than the k-th value, as a matrix product may round differently
                    if len(ids) > k:
                        least_dot = np.partition(dot[r], len(ids) - k)[len(ids) - k]
                        near = np.flatnonzero(dot[r] >= least_dot - 1e-9 * (1 + abs(least_dot)))
                    else:
                        near = np.arange(len(ids))
                    near = near[ids[near] != qid[r]]
                    score = np.einsum("ij,j->i", x[near], q[r])
                    best = np.lexsort((ids[near], -score))[:k]
                    found.append(pd.DataFrame({"query_id": qid[r], "vec_id": ids[near[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    hits = rows.groupBy(*key).cogroup(asks.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
