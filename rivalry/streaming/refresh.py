"""ST1: streaming refresh of a season-partitioned results table.

Results are delivered as folders: all files of a landing folder are one
delivery, finished when its marker file (``_SUCCESS``, as Spark's writers leave
it) is there. A delivery is the whole content of the seasons it holds, in one
file or many; of several deliveries for a season the newest wins, by the
latest modification time in the folder, then by its name.

A file-source stream tells which seasons the landed files hold, in whichever
batches they arrive. A log beside the results keeps (season, delivery); of
every season that a batch names, the newest finished delivery is read whole
from its folder, unless the table already has it. So a delivery whose files
come in several batches is never half applied, and a late file of an older
delivery changes nothing. The sink writes with dynamic partition overwrite:
only touched seasons are rewritten, and replaying a batch gives the same
table. Deliveries without a marker wait in the log and are looked at again
with each batch and at the end of a run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.operators.sets import distinct_rows
from rivalry.session import cut_lineage


def _read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """A log of the refresh; None before its first entry."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _path(spark: SparkSession, folder: str):
    """Hadoop path of a folder as ``_metadata`` writes it, a URI."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))


def _deliveries(spark: SparkSession, folders: list[str], marker: str) -> list[tuple]:
    """(folder, latest modification time in it) of the finished deliveries."""
    out = []
    for folder in folders:
        path = _path(spark, folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, marker)):
            files = [f for f in fs.listStatus(path) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            out.append((folder, max((f.getModificationTime() for f in files), default=0)))
    return out


def apply_deliveries(spark: SparkSession, table_path: str, read: Callable[[str], DataFrame], seasons: DataFrame | None = None, *,
                     season_col: str = "season", marker: str = "_SUCCESS") -> None:
    """Bring the table to the newest finished delivery of every season in
    ``seasons`` (``season_key``; all logged ones if None). ``read`` gives the
    rows of a folder. Rows with NULLs and repeated rows are dropped."""
    base = table_path.rstrip("/")
    log = _read_log(spark, f"{base}.deliveries")
    if log is None:
        return
    log = log.distinct()
    wanted = log if seasons is None else log.join(seasons.select("season_key"), "season_key", "left_semi")
    # folder names reach the driver, never rows: one for each delivery of the seasons at hand
    folders = sorted(r["delivery"] for r in wanted.select("delivery").distinct().collect())
    finished = _deliveries(spark, folders, marker)
    if not finished:
        return
    known = spark.createDataFrame(finished, "delivery string, time long")
    newest = wanted.join(F.broadcast(known), "delivery").groupBy("season_key").agg(F.max(F.struct("time", "delivery")).alias("stamp"))
    applied = _read_log(spark, f"{base}.stamps")
    if applied is not None:
        # the entry of the last application; a delivery that has grown since is applied again
        last = applied.groupBy("season_key").agg(F.max_by("stamp", "at").alias("applied"))
        newest = newest.join(last, "season_key", "left").filter(~F.col("stamp").eqNullSafe(F.col("applied"))).drop("applied")
    newest = cut_lineage(newest)
    used = [r["delivery"] for r in newest.select(F.col("stamp.delivery").alias("delivery")).distinct().collect()]
    if not used:
        return
    parts = [read(_path(spark, f).toString()).withColumn("_delivery", F.lit(f)) for f in sorted(used)]
    rows = reduce(DataFrame.unionByName, parts)
    taken = rows.join(newest.select("season_key", F.col("stamp.delivery").alias("_delivery")).withColumnRenamed("season_key", season_col),
                      [season_col, "_delivery"], "left_semi").drop("_delivery")
    (
        distinct_rows(taken.na.drop("any")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(season_col)
        .parquet(table_path)
    )
    newest.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{base}.stamps")


def refresh_batch(batch: DataFrame, table_path: str, read: Callable[[str], DataFrame], *, season_col: str = "season",
                  delivery_col: str = "_delivery", marker: str = "_SUCCESS") -> None:
    """Log the seasons and deliveries that ``batch`` names and apply the
    newest finished delivery of each of these seasons."""
    spark = batch.sparkSession
    found = cut_lineage(batch.select(F.col(season_col).alias("season_key"), F.col(delivery_col).alias("delivery")).filter("season_key is not null").distinct())
    found.write.mode("append").parquet(f"{table_path.rstrip('/')}.deliveries")
    apply_deliveries(spark, table_path, read, found.select("season_key").distinct(), season_col=season_col, marker=marker)


def stream_refresh(
    spark: SparkSession,
    source_dir: str,
    table_path: str,
    *,
    schema: str,
    checkpoint: str,
    season_col: str = "season",
    fmt: str = "csv",
    max_files: int | None = None,
    marker: str = "_SUCCESS",
) -> None:
    """Run the refresh stream over every file currently in ``source_dir``
    (``availableNow`` trigger, at most ``max_files`` a batch) and wait for it
    to finish."""
    def shaped(reader, *where):
        return reader.option("header", True).csv(*where) if fmt == "csv" else reader.format(fmt).load(*where)

    def read(folder: str) -> DataFrame:
        return shaped(spark.read.schema(schema), folder)

    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = shaped(reader, source_dir)
    stream = stream.select(season_col, F.regexp_replace(F.col("_metadata")["file_path"], "/[^/]*$", "").alias("_delivery"))

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh_batch(batch, table_path, read, season_col=season_col, marker=marker)

    q = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    # deliveries whose marker came after their files
    apply_deliveries(spark, table_path, read, season_col=season_col, marker=marker)


def read_refreshed(spark: SparkSession, table_path: str, columns) -> DataFrame:
    return spark.read.parquet(table_path).select(*columns).withColumn("season", F.col("season").cast("string"))
