"""The registry from a file: all faults at once, or a validated table."""

from __future__ import annotations

import json

import pytest

from cellwright.sources import collections as K

GOOD = {"registry_key": "A", "collection_id": "C1", "short_name": "A_L3", "primary_var": "no2", "units": "mol", "fill_value": -1e30, "valid_min": "-.inf", "valid_max": 5,
        "qa_good_values": [0], "aliases": ["a two"], "supports_variable_subsetting": True}


def _file(tmp_path, *lines) -> str:
    path = tmp_path / "registry.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_a_good_file_is_a_typed_table(spark, tmp_path):
    rows = K.load_collections(spark, _file(tmp_path, GOOD, GOOD | {"registry_key": "B", "collection_id": "C2", "aliases": [], "cadence": "hourly", "valid_max": "inf"})).orderBy("registry_key").collect()
    assert [(r["registry_key"], r["cadence"], r["valid_min"], r["valid_max"], r["qa_good_values"]) for r in rows] == [("A", "daily", float("-inf"), 5.0, [0]), ("B", "hourly", float("-inf"), float("inf"), [0])]
    names = {(r["name"], r["registry_key"]) for r in K.by_name(K.load_collections(spark, _file(tmp_path, GOOD))).collect()}
    assert names == {("A", "A"), ("A TWO", "A")}


def test_all_faults_are_named_together(spark, tmp_path):
    path = _file(
        tmp_path, GOOD, GOOD | {"registry_key": "B", "units": "", "valid_min": 9, "aliases": ["A TWO"]}, '{"registry_key": "torn', GOOD | {"registry_key": "D", "fill_value": "none", "cadence": "weekly", "aliases": None},
        GOOD | {"registry_key": "D", "aliases": ["x", "x"]}, {k: v for k, v in GOOD.items() if k not in ("registry_key", "aliases")})
    got = {(r["registry_key"], r["failures"]) for r in K.registry_problems(K.read_entries(spark, path)).collect()}
    assert got == {
        ("A", "name a two is claimed by 2 entries"), ("B", "name A TWO is claimed by 2 entries; units is required; valid_min must be <= valid_max"),
        (None, "the line is not a JSON object of the registry's form"), ("D", "cadence is unknown; fill_value is not a number; name D is claimed by 2 entries"),
        ("D", "name D is claimed by 2 entries"), (None, "registry_key is required")}
    with pytest.raises(ValueError) as error:
        K.load_collections(spark, path)
    assert all(x in str(error.value) for x in ("[B]", "cadence is unknown", "not a JSON object", "[D]", "registry_key is required"))


def test_an_empty_file_is_an_empty_registry(spark, tmp_path):
    path = tmp_path / "none.jsonl"
    path.write_text("")
    assert K.load_collections(spark, str(path)).count() == 0
