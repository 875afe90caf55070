"""The corpus pipeline: documents in, token ids out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``.

Rows with a NULL id pass the stages like others, but only named rows are
compared as near-duplicates. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import langid, minhash, mixing, toxicity
from rivalry.llm.common import table
from rivalry.llm.queries import language_model, piece_table, toxicity_model
from rivalry.session import cut_lineage

_BROADCAST_IDS = 1_000_000  # sixteen bytes each


def _prefix(docs: DataFrame) -> str:
    """A beginning that no column of ``docs`` has, for a stage's own columns."""
    p = "_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    return p


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a NULL text or one without a letter goes."""
    p = _prefix(docs)
    found = langid.identify(docs, language_model(docs), prefix=p)
    return found.filter(F.col(f"{p}lang_pred") != langid.UNDETERMINED).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    p = _prefix(docs)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), prefix=p)
    return scored.filter(F.col(f"{p}predicted") == 0).select(*docs.columns)


def _without(docs: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """``docs`` less the rows whose ``key`` is in ``ids``: without moving texts
    as long as the ids are few enough to broadcast."""
    return docs.join(F.broadcast(ids) if ids.count() <= _BROADCAST_IDS else ids, key, "left_anti")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the
    smallest id; of rows that repeat an id and its text, one. Rows that repeat
    an id with another text are documents of their own."""
    p = _prefix(docs)
    key = ["doc_id", f"{p}hash"]
    seen = cut_lineage(minhash.row_components(docs, width=5, similarity=0.8).filter("doc_id is not null").groupBy(
        "doc_id", F.col("text_hash").alias(f"{p}hash")).agg(F.max("first").alias(f"{p}first"), F.count(F.lit(1)).alias(f"{p}n")))
    marked = docs.withColumn(f"{p}hash", F.xxhash64(F.col("text").cast("string")))
    out = _without(marked, cut_lineage(seen.filter(~F.col(f"{p}first")).select(*key)), key)
    again = cut_lineage(seen.filter(F.col(f"{p}first") & (F.col(f"{p}n") > 1)).select(*key))
    if not again.isEmpty():
        out = _without(out, again, key).unionByName(marked.join(again, key, "left_semi").dropDuplicates(key))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    p = _prefix(docs)
    taken = mixing.mix(docs, weights=(1, 2, 3), max_copies=3, prefix=p).filter(F.col(f"{p}copies") > 0)
    return taken.withColumn(f"{p}copies", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies")))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return piece_table(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", unique), ("mixing", mixed), ("sentencepiece", pieces)]

ORACLE_SQL = None  # the fitted models and the mixture inference have no SQL form; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
