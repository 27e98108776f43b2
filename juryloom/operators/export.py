"""Public exports of scored dialogues and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ASSERTIONS, BUCKETS, CONDITIONS, ITEMS, SPLITS, TOTAL
from .aggregate import best_jurors, once
from .jury import vote_problem
from .strict import with_type_problem

FLAT_CSV = ("dialogue_id", "condition", *(f"phq8_item_{i}" for i in range(1, 9)), "phq8_total", "severity_bucket", "client_qa_text", "run_id", "prompt_version")


def flat(scored: DataFrame, run_id: str, prompt_version: str) -> DataFrame:
    """One flat record for each dialogue; not mentioned becomes 0. Needs a client_qa scoring_text that is not blank."""
    names = F.array(*map(F.lit, ITEMS))
    votes = F.map_from_arrays(names, F.transform("items", lambda i: F.transform(i["votes"], lambda v: F.coalesce(v["score"], F.lit(0)))))
    every = F.array_contains("arbitration_items", F.lit(TOTAL))
    asked = F.map_from_arrays(names, F.transform(names, lambda i: every | F.array_contains("arbitration_items", i)))
    text = F.when(F.trim(F.coalesce("scoring_text", F.lit(""))) == "", F.raise_error(F.concat(F.lit("blank scoring_text: "), "file_id")).cast("string")).otherwise(F.col("scoring_text"))
    return scored.select(
        F.col("file_id").alias("dialogue_id"),
        "condition",
        *(F.get("final_item_scores", F.lit(i)).alias(f"phq8_item_{i + 1}") for i in range(len(ITEMS))),
        F.col("final_total").alias("phq8_total"),
        F.col("final_bucket").alias("severity_bucket"),
        text.alias("client_qa_text"),
        votes.alias("juror_votes"),
        asked.alias("arbitration_triggered"),
        F.lit(run_id).alias("run_id"),
        F.lit(prompt_version).alias("prompt_version"),
    )


def flat_problems(rows: DataFrame) -> DataFrame:
    """(dialogue_id, problem) of flat records that break their contract."""
    items = [F.col(f"phq8_item_{i}") for i in range(1, 9)]
    outside = lambda c, top: F.coalesce(~c.between(0, top), F.lit(True))
    total = sum(items[1:], items[0])
    checks = [
        F.when(F.coalesce("dialogue_id", F.lit("")) == "", "dialogue_id empty"),
        F.when(~F.coalesce(F.col("condition").isin(*CONDITIONS), F.lit(False)), "condition"),
        *(F.when(outside(c, 3), f"item {i}") for i, c in enumerate(items, 1)),
        F.when(outside(F.col("phq8_total"), 24), "total out of range"),
        F.when(~total.eqNullSafe(F.col("phq8_total")), "total is not the sum"),
        F.when(~F.coalesce(F.col("severity_bucket").isin(*BUCKETS), F.lit(False)), "bucket"),
        F.when(F.trim(F.coalesce("client_qa_text", F.lit(""))) == "", "text blank"),
    ]
    return rows.select("dialogue_id", F.concat_ws("; ", *checks).alias("problem")).filter("problem <> ''")


def validate_lines(lines: DataFrame, schema: str) -> DataFrame:
    """(line, error) for each line of a flat export that does not parse or breaks the contract; lines has value, line."""
    parsed = lines.filter("trim(value) <> ''").select("line", F.from_json("value", schema + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}).alias("r"))
    rows = parsed.select("line", "r.*")
    bad = rows.filter("bad is not null").select("line", F.lit("not a record").alias("error"))
    good = rows.filter("bad is null")
    found = flat_problems(good.withColumn("dialogue_id", F.concat_ws("\x00", F.col("line").cast("string"), "dialogue_id")))
    split = found.select(F.substring_index("dialogue_id", "\x00", 1).cast("long").alias("line"), F.col("problem").alias("error"))
    return bad.unionByName(split)


def nested(scored: DataFrame, prompt_version: str, judge_model: str | None = None) -> DataFrame:
    """One nested record for each dialogue that keeps not-mentioned apart from 0. A judge's answer wins over the jury.

    Of the jurors that agree with the consensus the most confident gives confidence and evidence.
    """
    own = scored.withColumn("__resolved", F.coalesce(F.map_keys("judge_resolution"), F.array().cast("array<string>"))) if "judge_resolution" in scored.columns else scored.withColumn("__resolved", F.array().cast("array<string>"))
    items = own.select("file_id", "__resolved", F.inline("items"))
    best = best_jurors(items.filter(~F.array_contains("__resolved", F.col("item"))))
    score = F.struct(F.col("consensus_assertion").alias("assertion"), F.col("consensus_score").alias("score"), F.col("confidence"), F.col("evidence"))
    said = best.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("item", score.alias("r")))).alias("said"))
    row = own.join(said, "file_id", "left")
    empty = F.struct(F.lit("not_mentioned").alias("assertion"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<string>").alias("evidence"))

    def item(name: str) -> Column:
        out = F.coalesce(F.try_element_at("said", F.lit(name)), empty)
        if "judge_resolution" in scored.columns:
            r = F.try_element_at("judge_resolution", F.lit(name))
            bad = r.isNotNull() & ~F.coalesce(r["assertion"].isin(*ASSERTIONS), F.lit(False))
            kind = F.when(bad, F.raise_error(F.lit(f"judge's assertion for {name}")).cast("string")).otherwise(r["assertion"])
            judged = F.struct(kind.alias("assertion"), r["final_score"].alias("score"), r["confidence"].alias("confidence"), F.coalesce(r["evidence"], F.array().cast("array<string>")).alias("evidence"))
            out = F.when(r.isNotNull(), judged).otherwise(out)
        return out.alias(name)

    models = F.array_sort(F.array_distinct(F.transform(F.get("items", F.lit(0))["votes"], lambda v: v["model_id"])))
    runs = F.array_max(F.transform(F.get("items", F.lit(0))["votes"], lambda v: v["run_number"]))
    asked = F.col("triggered_arbitration")
    return row.select(
        F.col("file_id").alias("dialogue_id"),
        "condition",
        F.col("computed_split").alias("split"),
        F.struct(*map(item, ITEMS)).alias("items"),
        F.struct("total_imputed", "total_prorated", "total_prorated_rounded", "discussed_count", "item_coverage", "meets_min_coverage", "proration_valid").alias("totals"),
        F.struct(F.lit(prompt_version).alias("prompt_version"), models.alias("juror_models"), runs.alias("runs_per_model"), asked.alias("arbitration_triggered"), F.when(asked, F.lit(judge_model)).alias("judge_model")).alias("scoring_metadata"),
    )


_RECORD = "struct<assertion:string,score:int,confidence:double,evidence:array<string>>"
#: Types of a nested record: every key is there and no other; those in NULLABLE may be null.
NESTED = (
    "dialogue_id string, condition string, split string, "
    f"items struct<{', '.join(f'{i}:{_RECORD}' for i in ITEMS)}>, "
    "totals struct<total_imputed:int,total_prorated:double,total_prorated_rounded:int,discussed_count:int,item_coverage:double,meets_min_coverage:boolean,proration_valid:boolean>, "
    "scoring_metadata struct<prompt_version:string,juror_models:array<string>,runs_per_model:int,arbitration_triggered:boolean,judge_model:string>"
)
NULLABLE = ("score", "confidence", "total_prorated", "total_prorated_rounded", "judge_model")


def nested_problems(rows: DataFrame) -> DataFrame:
    """(dialogue_id, problem) of nested records that break their contract: items' semantics with confidence and evidence,
    totals that follow from the items, a prorated total exactly where it is valid, a judge only after arbitration."""
    return once(rows, {"problem": _nested_problem()}).select("dialogue_id", "problem").filter("problem <> ''")


def _nested_problem() -> Column:
    t, m = F.col("totals"), F.col("scoring_metadata")
    unless = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), text)
    scores = F.array(*(F.col("items")[i]["score"] for i in ITEMS))
    known = F.filter(scores, lambda x: x.isNotNull())
    n, total = F.size(known), F.aggregate(known, F.lit(0), lambda s, x: s + x)
    set_ = t["total_prorated"].isNotNull() & t["total_prorated_rounded"].isNotNull()
    unset = t["total_prorated"].isNull() & t["total_prorated_rounded"].isNull()
    checks = [
        unless(F.col("dialogue_id") != "", "dialogue_id empty"),
        unless(F.col("condition").isin(*CONDITIONS), "condition"),
        unless(F.col("split").isin(*SPLITS), "split"),
        F.when(t["proration_valid"] & ~set_, "prorated total missing"),
        F.when(~t["proration_valid"] & ~unset, "prorated total without coverage"),
        F.when(~m["arbitration_triggered"] & m["judge_model"].isNotNull(), "judge without arbitration"),
        unless(t["discussed_count"] == n, "discussed_count"),
        unless(F.abs(t["item_coverage"] - t["discussed_count"] / F.lit(8.0)) <= 1e-9, "item_coverage"),
        unless(t["meets_min_coverage"] == (t["discussed_count"] >= 4), "meets_min_coverage"),
        unless(t["proration_valid"] == (t["discussed_count"] >= 7), "proration_valid"),
        F.when(set_ & ~F.coalesce(t["total_prorated_rounded"].between(0, 24), F.lit(False)), "prorated total out of range"),
        unless(m["prompt_version"] != "", "prompt_version empty"),
        unless(F.size(m["juror_models"]) > 0, "no juror models"),
        unless(m["runs_per_model"] >= 1, "runs_per_model"),
    ]
    for name in ITEMS:
        i = F.col("items")[name]
        problem = vote_problem(i["assertion"] != "not_mentioned", i["score"], i["assertion"], i["confidence"], i["evidence"])
        checks.append(F.when(problem.isNotNull(), F.concat(F.lit(f"{name}: "), problem)))
    checks.append(unless(total == t["total_imputed"], "total is not the sum"))
    return F.concat_ws("; ", *checks)


def nested_line_problems(lines: DataFrame) -> DataFrame:
    """(file, line, problem) of lines (file, line, value) of a nested export: text that is no object, fields of the wrong
    type, missing and unknown keys, and for records without such faults what nested_problems finds. Blank lines count as
    none."""
    some = lines.filter("trim(value) <> ''")
    marked = with_type_problem(some, "value", NESTED, NULLABLE).withColumn("wrong", F.col("problem") != "")
    parsed = once(marked, {"r": F.from_json(F.when(~F.col("wrong"), F.col("value")), NESTED)})
    rows = once(parsed.select("file", "line", "problem", "r"), {c: F.col("r")[c] for c in StructType.fromDDL(NESTED).names})
    told = F.when(F.col("problem") != "", F.col("problem")).otherwise(_nested_problem())
    return once(rows, {"told": told}).filter("told <> ''").select("file", "line", F.col("told").alias("problem"))


def inconsistent_runs(votes: DataFrame) -> DataFrame:
    """(file_id, model_id) of models whose runs are not 1 to the dialogue's greatest."""
    runs = votes.groupBy("file_id", "model_id").agg(F.collect_set("run_number").alias("runs"), F.max("run_number").alias("top"))
    top = runs.groupBy("file_id").agg(F.max("top").alias("most"))
    both = runs.join(top, "file_id")
    return both.filter((F.size(F.array_except(F.sequence(F.lit(1), "most"), "runs")) > 0) | (F.size("runs") != F.col("most"))).select("file_id", "model_id")
