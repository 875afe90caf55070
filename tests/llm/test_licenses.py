import re

from rivalry.llm import licenses, queries
from rivalry.llm.licenses import TEMPLATES, anchors, groups, least_similarity, shingles


def words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute(rows):
    """Every window against every template, without bands or anchors."""
    out = {}
    for m, names in groups(TEMPLATES).items():
        size, step = m + m // 2, m // 2
        for doc_id, text in rows:
            w = words(text)
            for at in range(0, max(len(w) - size + step - 1, 0) + 1, step):
                have = shingles(w[at: at + size])
                for n in names:
                    has = shingles(words(TEMPLATES[n]))
                    share = len(have & has) / len(has)
                    if share >= 0.8:
                        old = out.get((doc_id, n), (0, at))
                        out[(doc_id, n)] = (max(old[0], share), min(old[1], at))
    return out


def found(df):
    rows = df.collect()
    out = {(r.doc_id, r.license): (r.containment, r.first_word) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_against_all_windows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = found(queries.QUERIES["op5_license_scan"](spark, sf_dir))
    assert got == brute(rows) and got


def test_templates_at_every_place_and_with_changes(spark):
    rows, k = [], 0
    for name, text in TEMPLATES.items():
        for lead in (0, 1, 3, 7, 50):
            rows.append((k, "word " * lead + text + " tail" * (k % 13)))
            k += 1
        w = text.split()
        if len(w) > 30:
            w[len(w) // 2] = "changed"
            rows.append((k, "x " * 9 + " ".join(w).upper() + " end"))
            k += 1
        rows.append((k, " ".join(w[: len(w) // 2])))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "license"), (k + 3, "Released under the MIT"), (k + 4, "z " * 40_000 + TEMPLATES["BSD"]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS license")
    got = found(licenses.scan(df))
    assert got == brute(rows)
    for k, name in enumerate(TEMPLATES):
        assert any(n == name for _, n in got)
    assert licenses.scan(df.limit(0)).collect() == []


def test_no_match_is_without_anchors_and_bands_suffice():
    keys = set(anchors(TEMPLATES, 0.8))
    for t in TEMPLATES.values():
        has = shingles(words(t))
        assert sum(not keys & set(s.split()) for s in has) < 0.8 * len(has)
    for m, names in groups(TEMPLATES).items():
        for n in names:
            assert 1 - (1 - least_similarity(m, len(words(TEMPLATES[n])), 0.8)) ** 64 > 0.99999


def test_only_dataframe_functions(spark, sf_dir):
    plan = queries.QUERIES["op5_license_scan"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rows_without_an_id_are_kept_apart(spark):
    text = TEMPLATES["MIT"]
    df = spark.createDataFrame([(None, text), (None, "lead " + text), (None, None), (5, text), (5, text)], "doc_id long, text string").selectExpr("*", "1 AS row")
    got = sorted(((r.doc_id, r.first_word) for r in licenses.scan(df).filter("license = 'MIT'").collect()), key=str)
    assert len(got) == 3 and [i for i, _ in got] == [5, None, None]
