"""Stored rule suites: read, validated and written back; artifact listing."""

import json

import pytest

from rivalry.operators.quality import generate_rules, profile, validate
from rivalry.sources import files as SRC

SUITE = {
    "data_asset_type": "Dataset", "expectation_suite_name": "default",
    "expectations": [
        {"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_set": ["n", "s", "f"]}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "n", "type_": "int64"}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_null", "kwargs": {"column": "s", "mostly": 0.25}, "meta": {"why": ["late", 2]}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "s", "mostly": 0.6}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "n", "max_value": 8.8, "min_value": -0.8}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "n", "min_value": 2}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "s", "value_set": ["A", "B"]}, "meta": {}},
        {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "f", "value_set": [0, 1]}, "meta": {}},
    ],
    "ge_cloud_id": None, "meta": {"version": "0.18.3"},
}


def _text(spark, path):
    [row] = spark.read.text(path).collect()
    return row.value


def test_suite_is_read_validated_and_written_back(spark, tmp_path):
    stored = json.dumps(SUITE, sort_keys=True, separators=(",", ":"))
    (tmp_path / "suite.json").write_text(json.dumps(SUITE, sort_keys=True, indent=2))
    rules = SRC.read_suite(spark, str(tmp_path / "suite.json"))
    data = spark.createDataFrame([(1, "A", 0), (2, "B", 1), (9, None, 1), (None, "C", 0)], "n long, s string, f int")
    got = {r.rule_id: (r.success, r.unexpected_count) for r in validate(data, rules).collect()}
    # an open bound of a range bounds nothing
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 3), 4: (True, 1), 5: (False, 1), 6: (False, 1), 7: (False, 1), 8: (True, 0)}
    assert _text(spark, SRC.write_suite(rules, str(tmp_path / "again"))) == stored


def test_own_rules_as_suite(spark, tmp_path):
    data = spark.createDataFrame([(i, "AB"[i % 2], i % 2, None if i % 3 else 0.5) for i in range(12)], "n long, s string, f long, d double")
    rules = generate_rules(profile(data), missing_upper=True)
    path = SRC.write_suite(rules, str(tmp_path / "own"), name="own")
    assert json.loads(_text(spark, path))["expectation_suite_name"] == "own"
    want = [tuple(r)[1:] for r in rules.orderBy("rule_id").collect()]
    read = SRC.read_suite(spark, path)
    got = [tuple(r)[1:8] for r in read.orderBy("rule_id").collect()]
    assert [[pytest.approx(x) if isinstance(x, float) else x for x in w] for w in want] == [list(g) for g in got]
    assert validate(data, read).filter("not success").count() == validate(data, rules).filter("not success").count()
    none = SRC.write_suite(rules.limit(0), str(tmp_path / "none"))
    assert SRC.read_suite(spark, none).count() == 0


def test_other_text_and_other_types(spark, tmp_path):
    (tmp_path / "bad.json").write_text("not a suite")
    with pytest.raises(Exception):
        SRC.read_suite(spark, str(tmp_path / "bad.json")).collect()
    odd = dict(SUITE, expectations=[{"expectation_type": "expect_something", "kwargs": {"column": "n"}, "meta": {}}])
    (tmp_path / "odd.json").write_text(json.dumps(odd))
    rules = SRC.read_suite(spark, str(tmp_path / "odd.json"))
    with pytest.raises(ValueError, match="expect_something"):
        validate(spark.createDataFrame([(1,)], "n long"), rules)


def test_artifacts_in_storage(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "m_20240102").mkdir()
    for name in ("a/m_20240101.bin", "a/m_20240301.bin", "a/m_latest.bin", "m_20240102/part-0"):
        (tmp_path / name).write_text("xyz")
    files = SRC.list_artifacts(spark, str(tmp_path))
    assert {(r.path.split("/")[-1], r["size"]) for r in files.collect()} == {("m_20240101.bin", 3), ("m_20240301.bin", 3), ("m_latest.bin", 3), ("part-0", 3)}
    newest = {r.prefix.split("/")[-1]: r.latest_path for r in SRC.latest_versioned(files).collect() if r.latest_path}
    assert newest["m"].endswith("m_20240301.bin")
    folders = {r.path.split("/")[-1]: r["size"] for r in SRC.list_artifacts(spark, str(tmp_path), folders=True).collect()}
    assert folders == {"a": 9, "m_20240102": 3}
    assert "content" not in files._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
