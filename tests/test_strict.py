"""Strict types of JSON lines and the whole contract of nested records."""

import copy
import json

from juryloom.config import ITEMS
from juryloom.operators import export, strict

SCHEMA = "name string, n int, x double, flag boolean, tags array<string>, inner struct<a:int,b:string>"


def test_types_by_path(spark):
    good = {"name": "a", "n": 1, "x": 0.5, "flag": True, "tags": ["t"], "inner": {"a": 1, "b": "b"}}
    cases = [
        (good, ""),
        ({**good, "x": 1, "tags": []}, ""),
        ({**good, "x": None}, ""),
        ({**good, "n": "1"}, "$.n is STRING, not int"),
        ({**good, "n": True}, "$.n is BOOLEAN, not int"),
        ({**good, "n": 1.5}, "$.n is DECIMAL, not int"),
        ({**good, "n": None}, "$.n is VOID, not int"),
        ({**good, "flag": 0}, "$.flag is BIGINT, not boolean"),
        ({**good, "flag": "false"}, "$.flag is STRING, not boolean"),
        ({**good, "x": False}, "$.x is BOOLEAN, not double"),
        ({**good, "x": "0.5"}, "$.x is STRING, not double"),
        ({**good, "name": 3}, "$.name is BIGINT, not string"),
        ({**good, "tags": [1]}, "$.tags is ARRAY<BIGINT>, not array<string>"),
        ({**good, "tags": "t"}, "$.tags is STRING, not array<string>"),
        ({**good, "inner": [1]}, "$.inner is ARRAY<BIGINT>, not object"),
        ({**good, "inner": {"a": "1", "c": 2}}, "$.inner.a is STRING, not int; $.inner.b is missing; unknown keys at $.inner: c"),
        ({k: v for k, v in good.items() if k != "n"} | {"z": 1, "more": 2}, "$.n is missing; unknown keys at $: more, z"),
        ([1], "not an object"),
    ]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, "{bad"), (91, None), (92, "")]
    want = {i: p for i, (_, p) in enumerate(cases)} | dict.fromkeys((90, 91, 92), "not an object")
    got = strict.with_type_problem(spark.createDataFrame(rows, "id int, value string"), "value", SCHEMA, ("x",)).collect()
    assert {r["id"]: r["problem"] for r in got} == want


def record():
    said = {"assertion": "present", "score": 2, "confidence": 0.9, "evidence": ["e"]}
    return {
        "dialogue_id": "d", "condition": "mdd", "split": "train", "items": {i: dict(said) for i in ITEMS},
        "totals": {"total_imputed": 16, "total_prorated": 16.0, "total_prorated_rounded": 16, "discussed_count": 8, "item_coverage": 1.0, "meets_min_coverage": True, "proration_valid": True},
        "scoring_metadata": {"prompt_version": "v", "juror_models": ["m"], "runs_per_model": 2, "arbitration_triggered": False, "judge_model": None},
    }


def changed(path, x):
    out = copy.deepcopy(record())
    *above, last = path.split(".")
    at = out
    for k in above:
        at = at[k]
    at[last] = x
    return out


def test_nested_records_hold_their_whole_contract(spark):
    none = {"assertion": "not_mentioned", "score": None, "confidence": None, "evidence": []}
    less = changed("items.sleep", none)
    less["totals"] |= {"total_imputed": 14, "discussed_count": 7, "item_coverage": 7 / 8, "total_prorated": 16.0}
    cases = [
        (record(), ""),
        (less, ""),
        (changed("items.sleep.evidence", []), "sleep: evidence missing"),
        (changed("items.sleep.confidence", None), "sleep: confidence missing or out of range"),
        (changed("items.sleep.assertion", "denied"), "sleep: denied needs score 0"),
        (changed("items.sleep.evidence", ["e"] * 4), "sleep: too many snippets"),
        (changed("items.sleep.score", True), "$.items.sleep.score is BOOLEAN, not int"),
        (changed("totals.total_imputed", 15), "total is not the sum"),
        (changed("totals.total_prorated_rounded", None), "prorated total missing"),
        (changed("totals.item_coverage", 0.9), "item_coverage"),
        (changed("totals.meets_min_coverage", False), "meets_min_coverage"),
        (changed("scoring_metadata.judge_model", "j"), "judge without arbitration"),
        (changed("scoring_metadata.juror_models", []), "no juror models"),
        (changed("scoring_metadata.runs_per_model", 0), "runs_per_model"),
        (changed("dialogue_id", ""), "dialogue_id empty"),
        (changed("items.mood", none), "unknown keys at $.items: mood"),
    ]
    rows = [("f", i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [("f", 98, " "), ("f", 99, "{")]
    found = export.nested_line_problems(spark.createDataFrame(rows, "file string, line long, value string")).collect()
    assert {r["line"]: r["problem"] for r in found} == {i: p for i, (_, p) in enumerate(cases) if p} | {99: "not an object"}
