"""Scans and sinks (SRC1-SRC9).

Files with different header layouts are read by name: one pass over their
lines finds each file's header, whether it decodes and whether a record of it
can span lines; Spark's CSV source then reads the files of each layout.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.session import ensure_checkpoint_dir

# split on commas outside double quotes
_CSV_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/rivalry-data/{name}-{uuid.uuid4().hex[:12]}"


def _unquote(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), '""', '"')


def season_from_path(path: Column, pattern: str = r"/(\d{4})/[^/]*$") -> Column:
    """Season from a 4-digit code in a path (default: the parent folder, as
    in '.../9596/E0.csv'): '9596' -> '1995-96', '0001' -> '2000-01' (a
    leading 9 means the 1900s)."""
    code = F.regexp_extract(path, pattern, 1)
    century = F.when(F.substring(code, 1, 1) == "9", "19").otherwise("20")
    return F.when(code == "", F.lit(None)).otherwise(
        F.concat(century, F.substring(code, 1, 2), F.lit("-"), F.substring(code, 3, 2))
    )


def _lines(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """Non-empty lines with their file; the text source gives the bytes as
    they are, so other encodings than UTF-8 are decoded here."""
    meta = F.col("_metadata")
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    value = F.col("value") if _is_utf8(encoding) else F.decode(F.col("value").cast("binary"), encoding)
    lines = lines.select(value.alias("value"), meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"))
    return lines.filter(F.length(F.trim("value")) > 0)


def _is_utf8(encoding: str) -> bool:
    return encoding.upper() in ("UTF-8", "UTF8")


class Layout(NamedTuple):
    """Files with the same header and encoding. ``open_quotes``: one of their
    lines has an odd number of quotes, so a record may go on in the next line."""

    first_line: str
    header: tuple[str, ...]
    encoding: str
    open_quotes: bool
    files: tuple[str, ...]


class HeaderedFiles:
    """Delimited files whose headers may differ, grouped by layout.

    One pass over the lines finds each file's header (its first line that is
    not blank; it must not span lines), whether the file decodes as
    ``encoding``, and whether a record of it can span lines: only a line with
    an odd number of quotes can begin such a record. Every layout is then read
    by Spark's CSV source. Files without such a line are split as any other;
    the rest are read one file to a task, so that quoted line breaks are kept.
    The driver holds one path per file, as it does for any file source.

    Files in which a line is not valid UTF-8 are decoded as ``fallback``
    (None: never). Of equal header names the first counts.
    """

    def __init__(self, spark: SparkSession, paths, *, encoding: str = "UTF-8", fallback: str | None = "ISO-8859-1"):
        self.spark = spark
        at = F.when(F.col("_block") == 0, F.monotonically_increasing_id())
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
        # the first block of a file is read in order by one task, so the smallest running number there is the first line
        per_file = _lines(spark, paths, encoding).select("_file", "value", at.alias("_at")).groupBy("_file").agg(
            F.min_by("value", "_at").alias("first"), F.max(~F.is_valid_utf8("value")).alias("broken"),
            F.max(quotes % 2 == 1).alias("open_quotes"))
        first = F.when(F.col("broken"), F.decode(F.col("first").cast("binary"), fallback)).otherwise(F.col("first")) if fallback else F.col("first")
        first = F.regexp_replace(first, "^\ufeff", "")
        header = F.transform(F.split(first, _CSV_SPLIT), _unquote)
        layouts = per_file.select(first.alias("first"), header.alias("header"), "broken", "open_quotes", "_file").groupBy(
            "first", "header", "broken", "open_quotes").agg(F.sort_array(F.collect_list("_file")).alias("files"))
        self.layouts = sorted(
            Layout(r.first, tuple(r.header), fallback if fallback and r.broken else encoding, r.open_quotes, tuple(r.files)) for r in layouts.collect())

    def _read(self, layout: Layout, *, bad: bool = False) -> DataFrame:
        """The layout's records, cells named c0, c1, ...; with ``bad`` also
        ``_bad``, the text of a record with another number of cells."""
        schema = ", ".join([*(f"c{i} string" for i in range(len(layout.header))), *(["_bad string"] if bad else [])])
        # cells that a pruned scan leaves out cannot be counted
        return self.spark.read.schema(schema).option("columnPruning", not bad).csv(
            # file_path is a URI
            [urllib.parse.unquote(f) for f in layout.files], header=True, escape='"', encoding=layout.encoding, multiLine=layout.open_quotes,
            mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")

    def rows(self, columns: Sequence[str], *, marker: str | None = None) -> DataFrame:
        """``_file`` and ``columns``, taken by name as text (empty: NULL; NULL
        where a file has no such column), of all records of the files whose
        header has the ``marker`` column (None: all files). Cells beyond the
        header are left out, missing ones are NULL: :meth:`bad_records` lists
        both. Records that repeat the header in all of ``columns`` are dropped."""
        parts = []
        for layout in self.layouts:
            if marker is None or marker in layout.header:
                place = {c: F.col(f"c{layout.header.index(c)}") for c in columns if c in layout.header}
                data = self._read(layout)
                if place:
                    data = data.filter(~F.coalesce(reduce(and_, [v == c for c, v in place.items()]), F.lit(False)))
                parts.append(data.select(F.col("_metadata.file_path").alias("_file"), *[
                    F.nullif(place[c], F.lit("")).alias(c) if c in place else F.lit(None).cast("string").alias(c) for c in columns]))
        if not parts:
            return self.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ["_file", *columns]))
        return reduce(DataFrame.union, parts)

    def skipped(self, marker: str) -> DataFrame:
        """``file, first_line`` of the files whose header lacks ``marker``."""
        rows = [(f, x.first_line) for x in self.layouts if marker not in x.header for f in x.files]
        return self.spark.createDataFrame(rows, "file string, first_line string")

    def bad_records(self, *, marker: str | None = None) -> DataFrame:
        """``file, problem, record`` of the records with more cells than their
        header (``surplus cells``) or fewer (``missing cells``), of the files
        :meth:`rows` reads with this ``marker``."""
        parts = []
        for layout in self.layouts:
            if marker is None or marker in layout.header:
                # a record with a last cell has no cell missing; that cell may be empty
                surplus = F.col(f"c{len(layout.header) - 1}").isNotNull() | (F.size(F.split(F.col("_bad"), _CSV_SPLIT)) > len(layout.header))
                parts.append(self._read(layout, bad=True).filter(F.length(F.trim("_bad")) > 0).select(
                    F.col("_metadata.file_path").alias("file"), F.when(surplus, "surplus cells").otherwise("missing cells").alias("problem"),
                    F.col("_bad").alias("record")))
        if not parts:
            return self.spark.createDataFrame([], "file string, problem string, record string")
        return reduce(DataFrame.union, parts)


def _opened(spark: SparkSession, paths, **options) -> HeaderedFiles:
    return paths if isinstance(paths, HeaderedFiles) else HeaderedFiles(spark, paths, **options)


def skipped_files(spark: SparkSession, paths, *, marker: str, encoding: str = "UTF-8") -> DataFrame:
    """SRC1's error table: files whose header lacks the ``marker`` column,
    with their first line. ``paths`` may be the :class:`HeaderedFiles` that
    the scan uses; the files are then looked through once."""
    return _opened(spark, paths, encoding=encoding).skipped(marker)


def scan_seasons(
    spark: SparkSession,
    paths: HeaderedFiles | Sequence[str] | str,
    *,
    required: Sequence[str],
    marker: str | None = None,
    encoding: str = "UTF-8",
    fallback: str | None = "ISO-8859-1",
    season_col: str = "season",
    season_pattern: str = r"/(\d{4})/[^/]*$",
) -> DataFrame:
    """SRC1: read result files whose header layouts may differ (each decoded
    as ``encoding`` or else ``fallback``), tag each row with the season coded
    in its path, keep ``required`` columns (by name) and drop rows with any
    NULL. Files without the ``marker`` column in their header contribute no
    rows; :func:`skipped_files` lists them, and
    :meth:`HeaderedFiles.bad_records` the records that do not fit their header.

    ``required`` may include ``season_col``; it is taken from the path. A
    quoted cell may hold line breaks.
    """
    cells = [c for c in required if c != season_col]
    data = _opened(spark, paths, encoding=encoding, fallback=fallback).rows(cells, marker=marker or cells[0])
    return data.select(*[
        season_from_path(F.col("_file"), season_pattern).alias(c) if c == season_col else F.col(c) for c in required
    ]).na.drop("any")


def season_calendar(start: Column, end: Column) -> Column:
    """SRC2: season codes for start..end-1 ('9900', '0001'); empty when
    start >= end. Returns an array column."""
    years = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        years,
        lambda y: F.concat(F.lpad((y % 100).cast("string"), 2, "0"), F.lpad(((y + 1) % 100).cast("string"), 2, "0")),
    )


def scan_encoded(spark: SparkSession, paths, *, columns: Sequence[str], fallback: str = "ISO-8859-1",
                 schema: str | None = None) -> DataFrame:
    """SRC3: read CSV files as UTF-8, those that do not decode with
    ``fallback``; keep ``columns`` by name, whatever each file's order.
    ``schema`` ('name type, ...') casts them (else text)."""
    types = dict(f.strip().split(None, 1) for f in schema.split(",")) if schema else {}
    data = _opened(spark, paths, fallback=fallback).rows(columns)
    return data.select(*[F.col(c).cast(types.get(c, "string")).alias(c) for c in columns])


FIXTURE_COLUMNS = (
    "match_number", "round_number", "date_text", "location", "home_team", "away_team", "result", "season",
)


def scan_fixtures(
    spark: SparkSession, path: str, *, next_path: str | None = None, schema: str | None = None,
    aliases: Mapping[str, str] | None = None, season_pattern: str | None = None,
) -> DataFrame:
    """SRC4: unplayed fixtures (``result`` NULL) of a fixture file; when
    there are none, the next season's file; when that is empty too, raise.

    Columns are taken by name (``schema``: 'name type, ...'; else all of the
    first file's header, as text). ``aliases`` renames teams in home_team and
    away_team. ``season_pattern`` adds ``season`` from the file's path (its
    first group). The emptiness probe stops at the first matching row."""
    def unplayed(p: str) -> DataFrame:
        files = HeaderedFiles(spark, p)
        if schema:
            names = dict(f.strip().split(None, 1) for f in schema.split(","))
        else:
            names = dict.fromkeys(min(files.layouts, key=lambda x: x.files).header if files.layouts else ["result"], "string")
        data = files.rows(list(names))
        cells = {c: F.col(c).cast(t) for c, t in names.items()}
        for c in ("home_team", "away_team"):
            if aliases and c in cells:
                cells[c] = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[cells[c]], cells[c])
        if season_pattern:
            cells["season"] = F.regexp_extract("_file", season_pattern, 1)
        return data.select(*[v.alias(c) for c, v in cells.items()]).filter(F.col("result").isNull())

    for p in (path, next_path):
        if p is not None:
            fix = unplayed(p)
            if not fix.isEmpty():
                return fix
    raise ValueError("no unplayed fixtures in the given files")


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> str:
    """SRC5 sink: csv or parquet, optionally partitioned; other formats raise."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format {fmt!r}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_table(spark: SparkSession, path: str, *, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """SRC5 source: csv (header) or parquet; other formats raise."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    raise ValueError(f"unsupported format {fmt!r}")


def latest_versioned(paths: DataFrame, *, path_col: str = "path") -> DataFrame:
    """SRC6: per artifact prefix, the path whose name ends with the newest
    ``_YYYYMMDD.ext``; names without a valid date are skipped. Prefixes with
    no dated name keep a NULL path. One aggregation (partial per task)."""
    m = F.regexp_extract(F.col(path_col), r"^(.*)_([0-9]{8})\.[^./]+$", 2)
    prefix = F.regexp_extract(F.col(path_col), r"^(.*)_[^_/]*$", 1)
    stamped = paths.select(
        F.col(path_col), prefix.alias("prefix"),
        F.when(m == "", None).otherwise(F.try_to_date(m, "yyyyMMdd")).alias("stamp"),
    )
    # newest date wins, equal dates -> greatest path; undated names skipped
    rank_key = F.when(F.col("stamp").isNotNull(), F.struct("stamp", path_col))
    return stamped.groupBy("prefix").agg(
        F.max_by(F.col(path_col), rank_key).alias("latest_path"),
        F.max("stamp").alias("latest_date"),
    )


def list_artifacts(spark: SparkSession, root: str, *, folders: bool = False) -> DataFrame:
    """SRC6's listing: ``path, modified, size`` of the files under ``root``, at
    any depth, without reading them. With ``folders`` an artifact is a folder
    of files, as Spark's writers leave them: one row per folder that holds a
    file, its newest time and total size. Names that begin with '_' or '.'
    are not listed, as in any Spark source."""
    # no content column: the files are not opened
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    if not folders:
        return files
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"))


def dated_path(prefix: Column, run_date: Column, ext: str) -> Column:
    """SRC7: '<prefix>_<YYYYMMDD>.<ext>' of a run date."""
    return F.concat(prefix, F.lit("_"), F.date_format(run_date, "yyyyMMdd"), F.lit(f".{ext}"))


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """SRC8: rows as JSON lines (nested columns kept as objects)."""
    df.write.mode(mode).json(path)
    return path


RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("rule_type", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("mostly", T.DoubleType()),
        T.StructField("min_value", T.DoubleType()),
        T.StructField("max_value", T.DoubleType()),
        T.StructField("value_set", T.ArrayType(T.StringType())),
    ]
)
RULE_FIELDS = [f.name for f in RULE_SCHEMA.fields]


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: a stored rule suite (JSON lines of rule rows) back to a rules
    table."""
    return spark.read.schema(RULE_SCHEMA).json(path)


def rules_document(rules: DataFrame, suite_name: str) -> DataFrame:
    """SRC8/SRC9 document form: one row {suite, expectations: [...]}."""
    ordered = F.array_sort(F.collect_list(F.struct(*RULE_FIELDS)))
    return rules.agg(ordered.alias("expectations")).select(F.lit(suite_name).alias("suite"), "expectations")


def explode_rules_document(doc: DataFrame) -> DataFrame:
    """SRC9 full listing: rules document -> one row per rule."""
    return doc.select(F.explode("expectations").alias("e")).select(
        *[F.col(f"e.{f.name}").cast(f.dataType).alias(f.name) for f in RULE_SCHEMA.fields]
    )


# fixed values: the stored form of each rule type, and of the column types
SUITE_TYPES = {
    "columns_match_set": "expect_table_columns_to_match_set",
    "column_type": "expect_column_values_to_be_of_type",
    "null_fraction": "expect_column_values_to_be_null",
    "null_fraction_max": "expect_column_values_to_not_be_null",
    "between": "expect_column_values_to_be_between",
    "in_set": "expect_column_values_to_be_in_set",
}
SUITE_COLUMN_TYPES = {"int64": "bigint", "int32": "int", "float64": "double", "str": "string", "bool": "boolean", "datetime64[ns]": "timestamp"}
_SUITE = ("data_asset_type string, expectation_suite_name string, "
          "expectations array<struct<expectation_type string, kwargs variant, meta variant>>, ge_cloud_id variant, meta variant")


def _mapped(c: Column, pairs: Mapping[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c], c)


def read_suite(spark: SparkSession, path: str, *, column_types: Mapping[str, str] = SUITE_COLUMN_TYPES) -> DataFrame:
    """SRC9: stored rule suites (one JSON document per file, ``kwargs`` differing by
    expectation type) as a rules table for :func:`rivalry.operators.quality.validate`.

    Besides the rule columns each row has ``suite`` (the document without its
    expectations), ``kwargs`` and ``meta`` (VARIANT, as stored), from which
    :func:`write_suite` makes the same document again. ``rule_id`` is the place
    in the document, from 1. An expectation of another type keeps its name as
    ``rule_type`` (``validate`` raises on it). Text that is no such document raises."""
    text = spark.read.text(path, wholetext=True)
    doc = text.select(F.from_json("value", _SUITE, {"mode": "FAILFAST"}).alias("d"))
    rows = doc.select(
        F.struct("d.data_asset_type", "d.expectation_suite_name", "d.ge_cloud_id", "d.meta").alias("suite"),
        F.posexplode("d.expectations").alias("pos", "e"))

    def arg(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("e.kwargs"), f"$.{name}", kind)

    kind = _mapped(F.col("e.expectation_type"), {v: k for k, v in SUITE_TYPES.items()})
    mostly = F.coalesce(arg("mostly", "double"), F.lit(1.0))
    fields = {
        "rule_id": F.col("pos") + 1, "rule_type": kind, "column": arg("column", "string"),
        "type_name": _mapped(arg("type_", "string"), column_types),
        # at least this share is not NULL: at most the rest is
        "mostly": F.when(kind == "null_fraction", mostly).when(kind == "null_fraction_max", 1 - mostly),
        "min_value": arg("min_value", "double"), "max_value": arg("max_value", "double"),
        "value_set": F.coalesce(arg("value_set", "array<string>"), arg("column_set", "array<string>")),
    }
    return rows.select(*[fields[f.name].cast(f.dataType).alias(f.name) for f in RULE_SCHEMA.fields], "suite", F.col("e.kwargs").alias("kwargs"), F.col("e.meta").alias("meta"))


def write_suite(rules: DataFrame, path: str, *, name: str = "default", column_types: Mapping[str, str] = SUITE_COLUMN_TYPES) -> str:
    """SRC8: a rules table as one stored suite document (a text file of one
    line under ``path``), rules by ``rule_id``. Rows of :func:`read_suite` are
    written as they were stored; others get their ``kwargs`` from the rule's
    columns. Object keys are in alphabetical order."""
    spelled = {v: k for k, v in column_types.items()}
    kind, present = F.col("rule_type"), set(rules.columns)
    made = F.parse_json(F.to_json(F.struct(
        "column",
        F.when(kind == "columns_match_set", F.col("value_set")).alias("column_set"),
        "max_value", "min_value",
        F.when(kind == "null_fraction_max", 1 - F.col("mostly")).otherwise(F.col("mostly")).alias("mostly"),
        _mapped(F.col("type_name"), spelled).alias("type_"),
        F.when(kind == "in_set", F.col("value_set")).alias("value_set"))))
    empty = F.parse_json(F.lit("{}"))
    rows = rules.select(
        "rule_id", _mapped(kind, SUITE_TYPES).alias("expectation_type"),
        (F.coalesce("kwargs", made) if "kwargs" in present else made).alias("kwargs"),
        (F.coalesce("meta", empty) if "meta" in present else empty).alias("meta"),
        F.col("suite") if "suite" in present else F.lit(None).cast(
            "struct<data_asset_type:string,expectation_suite_name:string,ge_cloud_id:variant,meta:variant>").alias("suite"))
    # VARIANT has no order: the rule's place orders, its JSON text travels
    entry = F.struct("rule_id", F.to_json(F.struct("expectation_type", "kwargs", "meta")).alias("text"))
    doc = rows.agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.first("suite", ignorenulls=True).alias("suite"))
    null = F.parse_json(F.lit("null"))
    doc.select(F.to_json(F.struct(
        F.coalesce("suite.data_asset_type", F.lit("Dataset")).alias("data_asset_type"),
        F.coalesce("suite.expectation_suite_name", F.lit(name)).alias("expectation_suite_name"),
        F.transform("entries", lambda e: F.parse_json(e["text"])).alias("expectations"),
        F.coalesce("suite.ge_cloud_id", null).alias("ge_cloud_id"),
        F.coalesce("suite.meta", empty).alias("meta"))).alias("value")).write.mode("overwrite").text(path)
    return path
