"""Helpers shared by the operators: tables, whole-text byte kernels over
Arrow batches, scratch files in the shared folder, and link components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.session import cut_lineage, ensure_checkpoint_dir

WORD_SPACE = b" \t\n\x0b\x0c\r"  # the bytes x20 and x09-x0D that separate words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name for this run under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


# ------------------------------------------------------------------ files
def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ------------------------------------------------------------ byte kernels
def utf8_slices(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``max_bytes``.

    Yields ``(first_row, last_row, bytes, offsets)`` with the UTF-8 bytes of
    the rows as one uint8 array and ``len(rows) + 1`` offsets into it; a NULL
    row is empty. A row longer than ``max_bytes`` is a run of its own, so the
    memory of a kernel follows the longest text, not the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
        i = j


def release_memory() -> None:
    """Give freed memory back to the system at the end of a pass: the Python
    worker lives on, idle or in another task, beside the executor's JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def with_text(df: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, Callable]:
    """``df`` cut to ``keep`` for an Arrow pass over its texts, and a function
    from a batch to the text column. A text that is kept anyway travels once."""
    if text_col in keep and df.schema[text_col].dataType == T.StringType():
        at = keep.index(text_col)
        return df.select(*keep), lambda batch: batch.column(at)
    return df.select(*keep, F.col(text_col).cast("string").alias("_text_of_row")), lambda batch: batch.column(len(keep))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array (in place on a copy)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# ------------------------------------------------------------- components
def _size_mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


_FEW_EDGES = 50_000


def _union_find(batches):
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    ids = list(root)
    for lo in range(0, len(ids), 10_000):
        part = ids[lo: lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], names=["id", "component_id"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(id, component_id)``
    per linked id, the component named by its smallest id.

    Alternates large-star and small-star steps: every id passes its smallest
    neighbour on, so the links of a component turn into a star around its
    smallest id after a logarithmic number of rounds. Every step is a
    ``min`` with map-side combine and an equi-join; no component is ever
    gathered in one task, and hot ids are split by AQE's skew join. Each
    round is written to the shared folder. At most ``_FEW_EDGES`` links are
    joined in one task instead. Self links and repeated links are ignored; an
    empty input gives an empty result."""
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    mark = _size_mark(edges)
    if mark[0] <= _FEW_EDGES:  # less than a megabyte: one task is done before another round could be planned
        return edges.coalesce(1).mapInArrow(_union_find, "id long, component_id long")
    while mark[0]:
        # large star: the larger neighbours of u meet u's smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours meet the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        edges = cut_lineage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = _size_mark(edges)
        if now == mark:
            break
        mark = now
    star = edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return star.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
