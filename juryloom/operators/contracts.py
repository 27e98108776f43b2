"""Contracts of what jurors, judge and aggregation give, and what a judge is shown; each check gives (keys, problem)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ITEMS, MAX_EVIDENCE_CHARS, MAX_EVIDENCE_SNIPPETS, MAX_EVIDENCE_WORDS
from ..functions.numeric import bucket_of
from ..functions.text import strip, word_count
from .jury import REPORT, names_of, reports, vote_problem

#: Snippets of the jurors' evidence that a judge is shown.
JUDGE_SNIPPETS = 5
COUNTERS = (
    "client_utterance_count", "therapist_utterance_count", "short_answer_count", "truncated_utterance_count",
    "meta_text_removed_count", "unknown_speaker_count", "orphan_line_count",
)


def _found(rows: DataFrame, keys: tuple[str, ...], checks: list[Column]) -> DataFrame:
    return rows.select(*keys, F.concat_ws("; ", *checks).alias("problem")).filter("problem <> ''")


def _outside(c: Column, low: float, high: float) -> Column:
    """Whether a value lies outside; null does not."""
    return F.coalesce(~c.between(low, high), F.lit(False))


def judge_violations(resolutions: DataFrame, na_aware: bool = True) -> DataFrame:
    """(file_id, item, problem) of a judge's answers: item, discussed, final_score, assertion, confidence, evidence,
    rationale. Without na_aware a score from 0 to 3 and a confidence are all that is asked for beside the rationale."""
    checks = [
        F.when(~F.coalesce(F.col("item").isin(*ITEMS), F.lit(False)), "unknown item"),
        F.when(strip(F.coalesce("rationale", F.lit(""))) == "", "rationale missing"),
    ]
    if na_aware:
        checks.append(vote_problem(*(F.col(c) for c in ("discussed", "final_score", "assertion", "confidence", "evidence"))))
    else:
        checks.append(F.when(~F.coalesce(F.col("final_score").between(0, 3), F.lit(False)), "score missing or out of range"))
        checks.append(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence missing or out of range"))
    return _found(resolutions, ("file_id", "item"), checks)


def bad_dialogues(votes: DataFrame) -> DataFrame:
    """(file_id, error_code, error_message) of dialogues whose votes cannot be scored, one row each.

    Every vote must hold its contract and name a known item, every juror must answer each item once. Of several
    problems the first in text order is told, so that a message never grows with the number of votes.
    """
    who = F.concat_ws("/", "model_id", F.col("run_number").cast("string"), "item")
    unnamed = F.when(F.col("model_id").isNull() | F.col("run_number").isNull(), "juror without name or run")
    unknown = F.when(~F.coalesce(F.col("item").isin(*ITEMS), F.lit(False)), "unknown item")
    problem = F.concat_ws("; ", unnamed, unknown, vote_problem(*(F.col(c) for c in ("discussed", "score", "assertion", "confidence", "evidence"))))
    single = votes.select("file_id", F.concat(who, F.lit(": "), problem).alias("problem"), (problem != "").alias("bad")).filter("bad")
    counted = votes.filter(F.col("item").isin(*ITEMS)).groupBy("file_id", "model_id", "run_number").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))
    lacking = F.format_string("%s/%d: %d of %d items answered, %d votes", "model_id", "run_number", "items", F.lit(len(ITEMS)), "n")
    whole = counted.filter((F.col("n") != len(ITEMS)) | (F.col("items") != len(ITEMS))).select("file_id", lacking.alias("problem"))
    found = single.select("file_id", "problem").unionByName(whole)
    if set(names_of(REPORT)) & set(votes.columns):
        flags = self_harm_violations(reports(votes))
        found = found.unionByName(flags.select("file_id", F.concat_ws(": ", F.concat_ws("/", "model_id", F.col("run_number").cast("string")), "problem").alias("problem")))
    return found.groupBy("file_id").agg(F.lit("contract").alias("error_code"), F.min("problem").alias("error_message"))


def bad_judgements(asked: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(file_id, error_code, error_message) of dialogues of which the judge left out an item, answered one that it was not
    asked for, answered twice, or broke an answer's contract as far as its columns go. asked: file_id, item."""
    columns = resolutions.columns
    checks = [F.when(F.coalesce(~F.col("final_score").between(0, 3), F.lit(False)), "score out of range")]
    if "assertion" in columns:
        kind = F.col("assertion")
        checks.append(F.when(~F.coalesce(kind.isin("present", "denied", "possible", "not_mentioned"), F.lit(False)), "unknown assertion"))
        checks.append(F.when((kind == "not_mentioned") != F.col("final_score").isNull(), "score and assertion differ"))
        checks.append(F.when((kind == "denied") & (F.col("final_score") != 0), "denied needs score 0"))
        checks.append(F.when((kind == "possible") & (F.col("final_score") != 1), "possible needs score 1"))
        checks.append(F.when((kind == "present") & (F.col("final_score") == 0), "present needs score 1 to 3"))
    if "confidence" in columns:
        checks.append(F.when(F.coalesce(~F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range"))
    own = resolutions.groupBy("file_id", "item").agg(F.count("*").alias("n"), F.min(F.concat_ws("; ", *checks)).alias("least"), F.max(F.concat_ws("; ", *checks)).alias("problem"))
    both = asked.select("file_id", "item", F.lit(True).alias("asked")).join(own, ["file_id", "item"], "full_outer")
    text = (
        F.when(F.col("asked").isNull(), "not asked for").when(F.col("n").isNull(), "no answer").when(F.col("n") > 1, "several answers").when(F.col("problem") != "", F.col("problem"))
    )
    found = both.select("file_id", F.concat_ws(": ", F.coalesce("item", F.lit("no item")), text).alias("problem"), text.isNotNull().alias("bad")).filter("bad")
    return found.groupBy("file_id").agg(F.lit("judge_contract").alias("error_code"), F.min("problem").alias("error_message"))


def judge_inputs(contested: DataFrame) -> DataFrame:
    """What a judge is shown of each contested item: votes and assertions in juror order, the share of jurors that do
    not mention it, and the first snippets of their evidence. The votes are in the row: no shuffle."""
    na = F.size(F.filter("votes", lambda v: v["score"].isNull()))
    n = F.size("votes")
    return contested.filter("contested").select(
        "file_id",
        "item",
        F.transform("votes", lambda v: F.coalesce(v["score"].cast("string"), F.lit("not_mentioned"))).alias("juror_votes"),
        F.transform("votes", lambda v: v["assertion"]).alias("juror_assertions"),
        na.alias("na_count"),
        F.when(n > 0, F.bround(100 * na / n)).otherwise(0.0).cast("int").alias("na_percent"),
        F.slice(F.flatten(F.transform("votes", lambda v: v["evidence"])), 1, JUDGE_SNIPPETS).alias("juror_evidence"),
    )


def self_harm(reports: DataFrame) -> DataFrame:
    """(file_id, mentions_self_harm, self_harm_evidence) of jurors' reports: any juror's flag, null counting as no, and
    all snippets in juror order. reports: file_id, model_id, run_number, mentions_self_harm, self_harm_evidence."""
    said = F.array_sort(F.collect_list(F.struct("model_id", "run_number", F.coalesce("self_harm_evidence", F.array().cast("array<string>")).alias("e"))))
    found = reports.groupBy("file_id").agg(F.coalesce(F.bool_or("mentions_self_harm"), F.lit(False)).alias("mentions_self_harm"), said.alias("s"))
    return found.select("file_id", "mentions_self_harm", F.flatten(F.transform("s", lambda x: x["e"])).alias("self_harm_evidence"))


def self_harm_violations(reports: DataFrame) -> DataFrame:
    """(file_id, model_id, run_number, problem) of reports whose self-harm evidence breaks the snippets' bounds."""
    e = F.col("self_harm_evidence")
    bad = F.exists(e, lambda x: x.isNull() | (strip(x) == "") | (F.length(x) > MAX_EVIDENCE_CHARS) | (word_count(x) > MAX_EVIDENCE_WORDS))
    checks = [F.when(F.size(e) > MAX_EVIDENCE_SNIPPETS, "too many snippets"), F.when(bad, "snippet empty or too long")]
    return _found(reports, ("file_id", "model_id", "run_number"), checks)


def view_violations(views: DataFrame) -> DataFrame:
    """(file_id, problem) of text views with a negative or missing counter."""
    return _found(views, ("file_id",), [F.when(F.coalesce(F.col(c), F.lit(-1)) < 0, c) for c in COUNTERS])


def item_violations(items: DataFrame) -> DataFrame:
    """(file_id, item, problem) of item aggregates with a value out of its range; null statistics are in range."""
    top = {"mode": 3, "expected": 3, "vote_range": 3, "consensus_score": 3, "clinical_prob": 1, "p_not_mentioned": 1, "entropy": float("inf"), "na_count": float("inf")}
    checks = [F.when(_outside(F.col(c), 0, high), c) for c, high in top.items()]
    checks.append(F.when(F.exists("posterior", lambda p: _outside(p, 0, 1)), "posterior"))
    return _found(items, ("file_id", "item"), checks)


def aggregate_violations(scored: DataFrame) -> DataFrame:
    """(file_id, problem) of scored rows whose final total is not their items' sum and imputed total, or whose bucket
    is another one's."""
    total = F.aggregate("final_item_scores", F.lit(0), lambda s, x: s + x)
    checks = [
        F.when(~total.eqNullSafe(F.col("final_total")), "final total is not the sum"),
        F.when(~F.col("total_imputed").eqNullSafe(F.col("final_total")), "final total is not the imputed one"),
        F.when(~bucket_of(F.col("final_total")).eqNullSafe(F.col("final_bucket")), "bucket does not match"),
    ]
    return _found(scored, ("file_id",), checks)


def validation_report(lines: int, problems: DataFrame) -> dict:
    """Counts of a validated export; valid is what a caller's exit state hangs on. problems has a row for each line."""
    n = problems.count()
    return {"total": lines, "invalid": n, "valid_lines": lines - n, "valid": n == 0}
