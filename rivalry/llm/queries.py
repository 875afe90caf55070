"""The registered queries of this subpackage. Each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalry.llm import ann_forest, conversations, embed_dedup, langid, licenses, minhash, mixing, packing, sentencepiece_viterbi, token_alignment, token_files, toxicity, warc
from rivalry.llm.common import fold, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS id, vec_id AS far FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.far
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, (SELECT min(far) FROM r WHERE r.id = v.vec_id) AS component_id,
  vec_id = (SELECT min(far) FROM r WHERE r.id = v.vec_id) AS kept,
  greatest(1, (SELECT count(*) FROM g WHERE g.label = v.label AND g.e = v.e)) AS n_copies
FROM v
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with equal labels and cosine >= 0.98."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n k ON k.doc_id = y WHERE 100 * c >= 80 * (m.n + k.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS far FROM w UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.far
), c AS (
  SELECT id, min(far) AS low FROM r GROUP BY id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, w.doc_id = c.low AS kept
FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@query("op6_minhash_near_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with 4-word shingle similarity >= 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, similarity=0.8)


def language_model(docs: DataFrame) -> langid.LanguageModel:
    """Learned from the documents outside the held-out fold, text and label only."""
    return langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "languages", "shares")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    return toxicity.fit(docs.filter(fold(F.col("doc_id"), 3) != 1), labels)


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    out = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to files and read back."""
    path = scratch_path(spark, "token-files")
    manifest = token_files.write_token_files(
        table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_copies=3, keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to
FROM m
"""


@query("op4_warc_round_trip", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = scratch_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.records(warc.read_warc(manifest, path))


def piece_table(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``round_trip``: whether decoding
    gives the text back (the marker character counts as a space)."""
    pieces = sentencepiece_viterbi.load(public_tokenizer("piece_bpe_32k.model"), ranks=True)
    back = sentencepiece_viterbi.encode(docs, pieces, decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.translate("text", sentencepiece_viterbi.MARKER, " "))
    return back.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0))).withColumn("round_trip", same)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    return piece_table(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids", "round_trip")


@query("op8_ann_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in the documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizer("byte_bpe_50k.json"), end_id=1, length=2048)


def damaged(rows: DataFrame) -> DataFrame:
    """The damage that the repair is measured on, by the hash of id and turn."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    return conversations.repair(damaged(rows), every=rows)


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, its faults counted, and repaired."""
    return repaired_conversations(table(spark, sf_dir, "conversations"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, linked pairs counted over all."""
    return token_alignment.align(
        table(spark, sf_dir, "documents"), a_path=public_tokenizer("byte_bpe_50k.json"), b_path=public_tokenizer("piece_bpe_32k.model")).documents
