import zlib

import numpy as np

from rivalry.llm import langid, queries


def test_held_out_accuracy_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    known = {x for x, _ in lang.values()}
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred in known or (r.lang_pred == "und" and r.score == 0))
        assert r.lang_pred == (r.languages[0] if r.languages else "und") and (not r.shares or abs(sum(r.shares) - 1) < 1e-3)
        if r.held_out:
            total += 1
            right += r.lang_pred == lang[r.doc_id][0]
    assert right >= 0.97 * total


def model_of(texts):
    log_p = np.zeros((256, len(texts)))
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        _, g = langid.grams(data, np.array([0, len(data)]), 256)
        n = np.bincount(g, minlength=256) + 0.5
        log_p[:, k] = np.log(n / n.sum())
    return langid.LanguageModel(["aa", "bb"], log_p.astype(np.float32), 256)


A, B = "tamo lira kano tamo sile ", "gruft bleck zwist gruft pflum "


def test_mixture_shares_and_language_sets():
    m = model_of([A * 40, B * 40])
    texts = [A * 30, B * 30, A * 15 + B * 15, A * 27 + B * 3]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, g = langid.grams(np.frombuffer(b"".join(raw), np.uint8), offsets, 256)
    share = langid.mixtures(row, g, 4, m.log_p)
    assert share[0].tolist() == [1, 0] and share[1].tolist() == [0, 1]
    assert 0.3 < share[2][0] < 0.7 and abs(share[2].sum() - 1) < 1e-4
    assert share[3][0] > 0.8 and (share[3] > 0).sum() == 2


def test_edges_ties_and_clashes(spark):
    m = model_of([A * 40, A * 40])  # equal models: ties go to the first
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "\U0001f600\U0001f600"), (5, A), (5, A), (6, "漢字" * 50), (7, A * 40_000), (8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'old' AS score", "'z' AS shares", "1 AS lang_pred")
    got = {r.doc_id: (r.lang_pred, len(r.languages)) for r in langid.identify(df, m).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert [got[i][0] for i in (5, 6, 7, 8)] == ["aa"] * 4
    assert langid.identify(df.limit(0), m).collect() == []
    none = langid.fit(df.limit(0).withColumnRenamed("shares", "lang"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_fit_ignores_rows_without_text_or_label(spark):
    df = spark.createDataFrame([(A * 5, "aa"), (None, "aa"), (B * 5, None), (B * 5, "bb"), ("", "cc")], "text string, lang string")
    m = langid.fit(df)
    assert m.languages == ["aa", "bb", "cc"]
    got = langid.identify(spark.createDataFrame([(A,), (B,)], "text string"), m)
    assert [r.lang_pred for r in got.collect()] == ["aa", "bb"]


C, D = "ouhi wexa yoqu hixe wauo ", "mbnd djvk cvgh zzkd bvmg "


def shares_of(m, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    row, g = langid.grams(np.frombuffer(b"".join(raw), np.uint8), offsets, 256)
    return langid.mixtures(row, g, len(texts), m.log_p)


def test_sets_are_bounded_by_the_penalty_alone():
    m = model_of([A * 40, B * 40, C * 40, D * 40])
    share = shares_of(m, [A * 10 + B * 10 + C * 10 + D * 10, A * 3900 + B * 100, D * 100, A * 60 + C * 25 + D * 10 + B * 5])
    assert (share[0] > 0.15).all() and abs(share[0].sum() - 1) < 1e-4
    assert share[1][0] > 0.9 and 0.01 < share[1][1] < 0.05 and share[1][2:].tolist() == [0, 0]  # 2.5 % of a long text
    assert share[2].tolist() == [0, 0, 0, 1]
    assert (share[3] > 0).sum() == 4 and share[3].argmax() == 0


def test_no_nested_set_is_better_than_the_selected_one():
    rng = np.random.default_rng(3)
    log_p = np.log(rng.dirichlet(np.full(64, 0.2), 5).T + 1e-4).astype(np.float32)
    rows = [np.concatenate([rng.choice(64, 60 * w, p=np.exp(log_p[:, k]) / np.exp(log_p[:, k]).sum()) for k, w in enumerate(ws)])
            for ws in rng.integers(0, 9, (40, 5)) + [1, 0, 0, 0, 0]]
    row, g = np.repeat(np.arange(40), [len(r) for r in rows]), np.concatenate(rows)
    share = langid.mixtures(row, g, 40, log_p)
    p = np.exp(log_p.astype(float))
    for r in range(40):
        def fit(pi, rounds=6):
            for _ in range(rounds):
                joint = p[rows[r]] * pi
                pi = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
            return pi

        def value(pi):
            n = len(rows[r])
            return np.log(p[rows[r]] @ pi).sum() - (pi > 0).sum() * (0.01 * n + 0.5 * np.log(n + 1))

        full = fit(np.full(5, 0.2))
        order = np.argsort(-full)
        sets = [np.eye(5)[k] for k in range(5)]
        for k in range(2, 6):
            start = np.where(np.isin(np.arange(5), order[:k]), full, 0)
            sets.append(fit(start / start.sum()))
        assert value(share[r]) > max(map(value, sets)) - 0.1


def test_blocks_of_texts_and_languages_change_nothing():
    rng = np.random.default_rng(5)
    log_p = np.log(rng.dirichlet(np.full(64, 0.2), 9).T + 1e-4).astype(np.float32)
    row, g = np.sort(rng.integers(0, 30, 5000)), rng.integers(0, 64, 5000)
    whole = langid.mixtures(row, g, 30, log_p)
    for cells in (1, 100, 2000):
        assert np.allclose(langid.mixtures(row, g, 30, log_p, cells=cells), whole, atol=1e-3)


def word_of(k):
    return " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}{chr(97 + k % 26)}" for x in "aeiou") + " "


def test_every_label_is_learned(spark):
    rows = [(word_of(k) * 20, f"l{k:03d}") for k in range(300) for _ in range(1 if k else 3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    m = langid.fit(df)
    assert m.languages == [f"l{k:03d}" for k in range(300)] and np.isfinite(m.log_p).all()
    assert all(r.lang_pred == r.lang for r in langid.identify(df, m).collect())


def test_copies_of_a_text_count_once(spark):
    texts = [word_of(k) * 3 for k in range(30)]
    rows = [(i, A * 5, "aa") for i in range(3000)] + [(i, t, "aa") for i, t in enumerate(texts)] + [(0, B, "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plain = langid.fit(df.dropDuplicates(["text"]))
    assert np.array_equal(langid.fit(df, docs_per_language=40).log_p, plain.log_p)
