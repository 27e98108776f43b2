"""Votes: deterministic offline jurors and judge as column expressions, and a hook for external ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ITEMS, MAX_ERROR_CHARS, MAX_EVIDENCE_CHARS, MAX_EVIDENCE_SNIPPETS, MAX_EVIDENCE_WORDS
from ..functions.hashing import hex_digit, sha256, sha_mod4
from ..functions.text import first_words, strip, word_count

VOTE = "file_id string, model_id string, run_number int, item string, discussed boolean, score int, assertion string, confidence double, evidence array<string>"

#: What a juror says of a whole dialogue, repeated in all of its votes: a self-harm flag with snippets, tokens of the call.
REPORT = "mentions_self_harm boolean, self_harm_evidence array<string>, input_tokens long, output_tokens long, reasoning_tokens long, total_tokens long"
TOKENS = ("input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")
_TYPES: dict[str, tuple[type, ...]] = {
    "model_id": (str,), "run_number": (int,), "item": (str,), "discussed": (bool,), "score": (int,), "assertion": (str,), "confidence": (float, int), "evidence": (list,),
    "mentions_self_harm": (bool,), "self_harm_evidence": (list,), **dict.fromkeys(TOKENS, (int,)),
}


#: Stands for the evidence of an answer that has no text to quote.
NO_SNIPPET = "Client: (no snippet)"


def names_of(ddl: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in ddl.split(", ")]


def ill_typed(vote: dict) -> str | None:
    """The first field of a vote that has another type than it should; null is allowed, a boolean is no number."""
    for name, kinds in _TYPES.items():
        x = vote.get(name)
        fits = x is None or (isinstance(x, kinds) and (bool in kinds or not isinstance(x, bool)))
        if not fits or (isinstance(x, list) and not all(isinstance(e, str) for e in x)):
            return f"{name} is {type(x).__name__}: {x!r}"
    return None


def fake_votes(texts: DataFrame, jurors: tuple[tuple[str, int], ...], na_digits: tuple[int, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of (file_id, scoring_text), juror and item: the score is the hash of all of them modulo 4.

    With na_digits, an item whose hash has one of these values in its second-last digit is not mentioned; the plain
    jurors mention all items. Null text counts as empty. Rows are made in place, without a shuffle.
    """
    who = F.array(*(F.struct(F.lit(m).alias("model_id"), F.lit(r).alias("run_number")) for m, r in jurors))
    rows = _asked(texts, keep).select("*", F.explode(who).alias("j"))
    rows = rows.withColumn("h", _hash(F.col("j.model_id"), F.col("j.run_number").cast("string")))
    return rows.select("file_id", *keep, "j.model_id", "j.run_number", "i.item", "i.item_idx", *_vote(F.col("h"), na_digits))


def fake_collected(texts: DataFrame, jurors: tuple[tuple[str, int], ...], na_digits: tuple[int, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """fake_votes as aggregate.collect_votes would gather them, for texts of distinct ids: each item's votes are made in
    one row, so nothing is shuffled."""
    order = sorted(jurors)
    rows = _asked(texts, keep).withColumn("h", F.array(*(_hash(F.lit(m), F.lit(str(r))) for m, r in order)))
    votes = (F.struct(F.lit(m).alias("model_id"), F.lit(r).alias("run_number"), *_vote(F.get("h", F.lit(k)), na_digits)) for k, (m, r) in enumerate(order))
    return rows.select("file_id", *keep, "i.item", "i.item_idx", F.array(*votes).alias("votes"))


def _asked(texts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """A row for each text and item i; the text's snippet is made once, before its row is repeated."""
    what = F.array(*(F.struct(F.lit(i).alias("item_idx"), F.lit(x).alias("item")) for i, x in enumerate(ITEMS)))
    seen = texts.select("file_id", *keep, F.coalesce("scoring_text", F.lit("")).alias("text"))
    seen = seen.withColumn("head", strip(first_words(F.col("text"), 20)))
    seen = seen.withColumn("snippet", F.when(F.col("head") == "", NO_SNIPPET).otherwise(F.col("head"))).drop("head")
    return seen.select("*", F.explode(what).alias("i"))


def _hash(model_id: Column, run_number: Column) -> Column:
    return sha256(F.concat_ws("|", model_id, run_number, F.col("i.item"), F.col("text")))


def _vote(h: Column, na_digits: tuple[int, ...]) -> list[Column]:
    """What a juror says of an item, from its hash and the column snippet."""
    skipped = hex_digit(h, -2).isin(*na_digits) if na_digits else F.lit(False)
    score = F.when(~skipped, sha_mod4(h).cast("int"))
    return [
        (~skipped).alias("discussed"),
        score.alias("score"),
        F.when(skipped, "not_mentioned").when(score == 0, "denied").otherwise("present").alias("assertion"),
        F.when(~skipped, F.lit(0.7)).alias("confidence"),
        F.when(skipped, F.array().cast("array<string>")).otherwise(F.array("snippet")).alias("evidence"),
    ]


def external_votes(texts: DataFrame, score: Callable[[str], list[dict]], partitions: int) -> DataFrame:
    """Votes of a pluggable juror: score(text) gives a dictionary of a vote's fields for each juror and item.

    Each document is asked for once in a task attempt; a failure becomes one row of null
    fields with its kind in error_code and its text in error_message. Repeated attempts repeat paid calls: keep
    speculation off and write the result before using it.
    """
    names = [*names_of(VOTE), *names_of(REPORT)][1:]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file_id, text in zip(batch["file_id"], batch["scoring_text"], strict=True):
                try:
                    votes = score(text or "")
                    wrong = next((w for w in map(ill_typed, votes) if w), None)
                    if wrong:
                        raise TypeError(wrong)
                    out += [(file_id, *(v.get(n) for n in names), None, None) for v in votes]
                except Exception as e:  # noqa: BLE001  one document's failure is a row, not the job's end
                    out.append((file_id, *(None for _ in names), type(e).__name__, str(e)[:MAX_ERROR_CHARS]))
            yield pd.DataFrame(out, columns=["file_id", *names, "error_code", "error_message"], dtype=object)

    return texts.select("file_id", "scoring_text").repartition(partitions).mapInPandas(ask, f"{VOTE}, {REPORT}, error_code string, error_message string")


def reports(votes: DataFrame) -> DataFrame:
    """(file_id, model_id, run_number and REPORT's columns), one row for each juror, from votes that repeat them; a
    column that the votes lack is null."""
    kinds = dict(c.strip().split(" ") for c in REPORT.split(", "))
    best = lambda n: F.bool_or(n) if n == "mentions_self_harm" else F.max(n)
    said = [(best(n) if n in votes.columns else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()]
    return votes.groupBy("file_id", "model_id", "run_number").agg(*said)


def dialogue_reports(said: DataFrame) -> DataFrame:
    """(file_id, mentions_self_harm, self_harm_evidence, token_usage) over all jurors: any flag, snippets in juror order,
    sums of tokens with null as 0."""
    evidence = F.array_sort(F.collect_list(F.struct("model_id", "run_number", F.coalesce("self_harm_evidence", F.array().cast("array<string>")).alias("e"))))
    sums = F.struct(*(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in TOKENS))
    found = said.groupBy("file_id").agg(F.coalesce(F.bool_or("mentions_self_harm"), F.lit(False)).alias("mentions_self_harm"), evidence.alias("s"), sums.alias("token_usage"))
    return found.select("file_id", "mentions_self_harm", F.flatten(F.transform("s", lambda x: x["e"])).alias("self_harm_evidence"), "token_usage")


def with_offline_reports(rows: DataFrame, jurors: int) -> DataFrame:
    """rows with what offline jurors report: no flag, fixed tokens of each call."""
    usage = F.struct(*(F.lit(jurors * a).cast("long").alias(n) for n, a in zip(TOKENS, JUROR_USAGE, strict=True)))
    return rows.withColumns({"mentions_self_harm": F.lit(False), "self_harm_evidence": F.array().cast("array<string>"), "token_usage": usage})


def with_judge_usage(rows: DataFrame) -> DataFrame:
    """rows whose token_usage also counts the judge's calls: those that judge_resolution reports in usage, null as 0, or
    the offline judge's for each resolved item where it has no such field."""
    answers = F.map_values("judge_resolution")
    fields = rows.schema["judge_resolution"].dataType.valueType.names
    own = lambda n: F.aggregate(F.transform(answers, lambda r: F.coalesce(r["usage"][n].cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)
    more = {n: F.coalesce(own(n) if "usage" in fields else (F.size(answers) * b).cast("long"), F.lit(0)) for n, b in zip(TOKENS, JUDGE_USAGE, strict=True)}
    return rows.withColumn("token_usage", F.struct(*((F.col(f"token_usage.{n}") + c).alias(n) for n, c in more.items())))


def vote_problem(discussed: Column, score: Column, assertion: Column, confidence: Column, evidence: Column) -> Column:
    """What breaks an item score's contract, or null."""
    none = F.coalesce(F.size(evidence), F.lit(0)) == 0
    known = F.when(~F.coalesce(assertion, F.lit("")).isin("present", "denied", "possible", "not_mentioned"), "unknown assertion")
    na = assertion == "not_mentioned"
    checks = [
        known,
        F.when(na & (F.coalesce(discussed, F.lit(True)) | score.isNotNull() | confidence.isNotNull() | ~none), "not_mentioned has values"),
        F.when(~na & ~F.coalesce(discussed, F.lit(False)), "mentioned but not discussed"),
        F.when((assertion == "denied") & ~score.eqNullSafe(0), "denied needs score 0"),
        F.when((assertion == "possible") & ~score.eqNullSafe(1), "possible needs score 1"),
        F.when((assertion == "present") & ~F.coalesce(score.isin(1, 2, 3), F.lit(False)), "present needs score 1 to 3"),
        F.when(~na & (confidence.isNull() | ~confidence.between(0, 1)), "confidence missing or out of range"),
        F.when(~na & none, "evidence missing"),
        F.when(F.size(evidence) > MAX_EVIDENCE_SNIPPETS, "too many snippets"),
        F.when(F.exists(evidence, lambda e: (strip(e) == "") | (F.length(e) > MAX_EVIDENCE_CHARS) | (word_count(e) > MAX_EVIDENCE_WORDS)), "snippet empty or too long"),
    ]
    text = F.concat_ws("; ", *checks)
    return F.when(text != "", text)


def vote_violations(votes: DataFrame) -> DataFrame:
    cols = ("discussed", "score", "assertion", "confidence", "evidence")
    problem = vote_problem(*(F.col(c) for c in cols))
    return votes.select("file_id", "model_id", "run_number", "item", problem.alias("problem")).filter("problem is not null")


def juror_evidence(votes: Column) -> Column:
    """The first snippets of an item's votes."""
    return F.slice(F.flatten(F.transform(votes, lambda v: v["evidence"])), 1, MAX_EVIDENCE_SNIPPETS)


def fake_resolution(votes: Column) -> dict[str, Column]:
    """A judge's answer from an item's votes: their mean, not-mentioned as 0, rounded half to even. Where no juror has
    evidence a fixed snippet stands for it, as an answer with a score needs some."""
    score = F.transform(votes, lambda v: F.coalesce(v["score"], F.lit(0)))
    mean = F.aggregate(score, F.lit(0.0), lambda s, v: s + v) / F.size(score)
    final = F.greatest(F.lit(0), F.least(F.lit(3), F.bround(mean).cast("int")))
    said = juror_evidence(votes)
    return {
        "final_score": final,
        "assertion": F.when(final == 0, "denied").otherwise("present"),
        "confidence": F.lit(0.7),
        "evidence": F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(NO_SNIPPET))),
        "rationale": F.lit("Mean of the jurors' votes."),
    }


def fake_resolutions(item_agg: DataFrame) -> DataFrame:
    """The offline judge's answers for contested items, one row each."""
    return item_agg.filter("contested").select("file_id", "item", *(c.alias(n) for n, c in fake_resolution(F.col("votes")).items()))


# Tokens that an offline juror and judge report for a call: input, output, reasoning, total.
JUROR_USAGE, JUDGE_USAGE = (100, 50, 10, 160), (50, 25, 5, 80)
