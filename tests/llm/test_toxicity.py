import zlib

import numpy as np

from rivalry.llm import queries, toxicity


def test_held_out_accuracy_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op2_toxicity"](spark, sf).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert sum(p == y for p, y in held) >= 0.93 * len(held)
    assert sum(p > y for p, y in held) <= 0.02 * len(held)


def sample(spark, n=600):
    rng = np.random.default_rng(2)
    calm = "river stone garden letter music window autumn bridge paper silver".split()
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(calm, 30))
        y = int(i % 3 == 0)
        if y:
            for p in rng.choice(30, 3, replace=False):
                w[p] = "zorfix" + rng.choice(["a", "en", "um"]) if i % 2 else "you idiot"
        docs.append((i, " ".join(w)))
        labels.append((i, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_stems_given_words_and_edges(spark):
    docs, labels = sample(spark)
    odd = spark.createDataFrame([(None, 1), (0, None), (0, 1), (0, 1), (99_999, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.union(odd))
    assert "zorfix*" in model.lexicon.strong | model.lexicon.weak
    rows = [(1, None), (2, ""), (3, "river stone music you zorfixen garden zorfixa letter"), (4, "silver autumn you idiot idiot paper"),
            (5, "river stone garden letter"), (5, "river stone garden letter"), (6, "garden music " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS features", "2 AS row", "3 AS probability")
    got = [(r.doc_id, r.predicted, r.score) for r in toxicity.score(df, model).collect()]
    assert [p for _, p, _ in got] == [0, 0, 1, 1, 0, 0, 0]
    assert got[0][2] == got[1][2] and got[4] == got[5]
    assert set(toxicity.score(df, model).columns) == {"doc_id", "text", "features", "row", "probability", "score", "predicted"}
    assert toxicity.score(df.limit(0), model).collect() == []


def test_without_two_classes_every_score_is_zero(spark):
    docs, labels = sample(spark, 30)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit(docs, some)
        assert {(r.score, r.predicted) for r in toxicity.score(docs, model).collect()} == {(0.0, 0)}


def features(text, **lists):
    lex = toxicity.Lexicon(**lists)
    kind = toxicity._KIND[np.frombuffer(text.encode(), np.uint8)]
    return dict(zip(toxicity.NAMES, toxicity.feature_rows([text], [kind], toxicity._Marks(lex.given, lex.second, lex.strong, lex.weak))[0]))


def test_features():
    plain = features("You are an idiot, my friend")
    assert plain["given"] == 1 / 6 and plain["near_you"] == 1 / 6 and plain["disguised"] == 0
    assert features("far far far far far far idiot")["near_you"] == 0
    assert features("what an 1d10t and id!ot")["disguised"] > 0
    assert features("A CALM DAY")["capitals"] > 0.7 and features("a calm day")["capitals"] == 0
    assert features("no!!!")["exclaim"] > 0 and features("a---b")["repeated"] > 0
    assert features("zorfixum here", strong=frozenset(["zorfix*"]))["strong"] == 0.5
    assert not any(features("").values())


def test_every_language_and_a_plain_second_version(spark):
    """Held-out catch rate by language, and every score again by hand: plain
    features, the trees walked one by one, the calibration interpolated."""
    from pyspark.ml.linalg import Vectors

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = queries.toxicity_model(spark, docs, sf)
    rows = toxicity.score(docs.select("doc_id", "lang", "text"), model).collect()
    for lang in ("en", "de", "fr", "es"):
        held = [(r.score, toxic[r.doc_id]) for r in rows if r.lang == lang and r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
        caught = [s >= 0.7 for s, y in held if y]
        assert sum(caught) >= 0.8 * len(caught) and len(caught) >= 10, lang
        assert sum(s >= 0.7 for s, y in held if not y) <= 0.01 * len(held), lang
    assert len({r.score for r in rows}) >= 20

    def walk(node, x):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    trees = [(t._call_java("rootNode"), w) for t, w in zip(model.trees.trees, model.trees.treeWeights)]
    at, value = np.array(model.isotonic.boundaries), np.array(model.isotonic.predictions)
    lex = model.lexicon
    for r in rows[::97]:
        f = plain_features(r.text or "", lex)
        x = Vectors.dense(f).toArray()
        margin = sum(w * walk(root, x) for root, w in trees)
        p = 1 / (1 + np.exp(-2 * margin))
        want = 0.99 * np.interp(p, at, value) + 0.01 * p
        assert abs(r.score - min(1, max(0, want))) < 1e-9, r.doc_id


def plain_features(text, lex):
    """The features read off a text one by one."""
    import re

    words = re.findall(r"[^\W_]+", text.lower())
    if not text:
        return [0.0] * len(toxicity.NAMES)

    def among(word, terms):
        return word in terms or any(len(word) > k and word[:k] + "*" in terms for k in (4, 5, 6, 7, 8))

    given = [w in lex.given for w in words]
    strong, weak = [among(w, lex.strong) for w in words], [among(w, lex.weak) for w in words]
    you = [i for i, w in enumerate(words) if w in lex.second]
    near = sum(min((abs(i - j) for j in you), default=99) <= 4 for i in range(len(words)) if given[i] or strong[i])
    n = max(1, len(words))
    raw = text.encode()

    def kind(b):
        c = chr(b)
        return "A" if "A" <= c <= "Z" else "a" if b >= 128 or "a" <= c <= "z" else "0" if c.isdigit() else "!" if c == "!" else "." if 33 < b < 127 else " "

    kinds = [kind(b) for b in raw]
    size = len(raw)
    letter = [k in "Aa" for k in kinds]
    inner = sum(kinds[i] not in "Aa " and letter[i - 1] and letter[i + 1] for i in range(1, size - 1))
    pairs = list(zip(kinds, kinds[1:]))
    disguised = 0
    if inner or "@" in text or "$" in text:
        for m in toxicity._DISGUISED.findall(text):
            read = m.lower().translate(toxicity._LEET).replace("*", "")
            bad = read in lex.given or among(read, lex.strong)
            disguised += bad and not (m.lower() in lex.given or among(m.lower(), lex.strong))
    g, s, w = sum(given), sum(strong), sum(weak)
    return [g / n, np.log1p(g), s / n, np.log1p(s), w / n, np.log1p(w), near / n, len(you) / n, kinds.count("A") / size, pairs.count(("A", "A")) / size,
            kinds.count("!") / size, kinds.count(".") / size, sum(a == b and a in "!." for a, b in pairs) / size, inner / n, disguised / n]
