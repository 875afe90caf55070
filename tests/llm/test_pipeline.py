import public_tokenizers
import pytest

import corpus_pipeline
from rivalry.llm import langid, queries, sentencepiece_viterbi, toxicity
from rivalry.session import cut_lineage
from tests_llm_brute import dedup_ids, targets_of, words_of


def test_every_stage_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_dedup", "mixing", "sentencepiece"]
    steps = [cut_lineage(docs)]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(cut_lineage(stage(spark, steps[-1], sf_dir)))
    rows = [s.collect() for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    # language and toxicity: the operator's own decision, row by row
    pred = {r.doc_id: r.lang_pred for r in langid.identify(steps[0], queries.language_model(steps[0])).collect()}
    assert sorted(r.doc_id for r in rows[1]) == sorted(i for i, p in pred.items() if p != "und")
    toxic = {r.doc_id: r.predicted for r in toxicity.score(steps[1], queries.toxicity_model(spark, steps[1], sf_dir)).collect()}
    assert sorted(r.doc_id for r in rows[2]) == sorted(i for i, p in toxic.items() if not p)
    # near-duplicates: an inverted index over all shingles
    assert sorted(r.doc_id for r in rows[3]) == sorted(dedup_ids([(r.doc_id, r.text) for r in rows[2]], 5))
    # mixing: words taken near the targets, no document above three copies
    want = targets_of([(r.source, r.text) for r in rows[3]])
    for source, (_, target) in want.items():
        own = [words_of(r.text) for r in rows[3] if r.source == source]
        assert abs(sum(words_of(r.text) for r in rows[4] if r.source == source) - target) <= max(own) / 2 + 1
    count = {}
    for r in rows[4]:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 3 and set(count) <= {r.doc_id for r in rows[3]}
    # pieces: every row, decoded back to its text
    text = {r.doc_id: r.text for r in rows[4]}
    assert sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    table = sentencepiece_viterbi.load(public_tokenizers.path("piece_bpe_32k.model"), ranks=True)
    for r in rows[5]:
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert b"".join(table.texts[i] for i in r.ids).decode()[1:] == text[r.doc_id]


def test_odd_rows_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame(
        [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "1234 !!", "en", "src0", 7), (None, "plain words without an id here", "en", "src1", 5),
         (9004, "the same row twice with words", "en", None, 3), (9004, "the same row twice with words", "en", None, 3)], docs.schema)
    # extra columns with the names that stages use
    own = {"score": "id-%d", "predicted": "p-%d", "lang_pred": "l-%d", "copies": "c-%d", "size": "s-%d"}
    step = cut_lineage(docs.unionByName(odd).selectExpr("*", *[f"format_string('{t}', coalesce(doc_id, -1)) AS {c}" for c, t in own.items()]))
    for name, stage in corpus_pipeline.STAGES:
        step = cut_lineage(stage(spark, step, sf_dir))
        ids = [r.doc_id for r in step.select("doc_id").collect()]
        if name != "sentencepiece":
            assert all(r[c] == t % (-1 if r.doc_id is None else r.doc_id) for r in step.collect() for c, t in own.items())
        assert not {9001, 9002, 9003} & set(ids)
        if name == "near_dedup":
            assert ids.count(9004) == 1 and None in ids


@pytest.mark.parametrize("stage", range(5))
def test_empty_table(spark, sf_dir, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir).collect() == []
