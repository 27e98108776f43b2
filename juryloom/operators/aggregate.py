"""Votes to item aggregates, and item aggregates to scored dialogues with a judge's overlay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUCKETS, ITEMS, TOTAL, ScoringConfig
from ..functions import numeric as N


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns that are computed once for each row: no filter and no other expression takes a copy of them.

    A generator of one row stands between; through plain projections the optimiser copies a column's whole expression
    into each filter that refers to it.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def collect_votes(votes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, item, item_idx, votes): a juror's votes in the order of model and run. Groups have a jury's size."""
    cols = ("model_id", "run_number", "discussed", "score", "assertion", "confidence", "evidence")
    one = votes.groupBy("file_id", "item", "item_idx", *keep).agg(F.array_sort(F.collect_list(F.struct("model_id", "run_number", F.struct(*cols).alias("v")))).alias("s"))
    return one.select("file_id", *keep, "item", "item_idx", F.transform("s", lambda x: x["v"]).alias("votes"))


def item_aggregates(collected: DataFrame, config: ScoringConfig) -> DataFrame:
    """Per dialogue and item: counts, smoothed posterior, consensus, and the reasons to ask a judge.

    Not-mentioned votes are left out of the posterior but counted. An item that nobody mentions has null statistics.
    """
    out = collected.withColumn("n", F.size("votes"))
    out = out.withColumn("numeric", F.filter(F.transform("votes", lambda v: v["score"]), lambda s: s.isNotNull()))
    out = out.withColumn("vote_counts", F.transform(F.array(*map(F.lit, range(4))), lambda k: F.size(F.filter("numeric", lambda s: s == k)).cast("long")))
    out = out.withColumn("posterior", N.posterior(F.col("vote_counts"), config.alpha))
    p = F.col("posterior")
    out = out.withColumns(
        {
            "mode": F.when(p.isNotNull(), N.argmax(p)),
            "expected": N.expected(p),
            "entropy": N.entropy(p),
            "clinical_prob": F.get(p, F.lit(2)) + F.get(p, F.lit(3)),
            "vote_range": F.array_max("numeric") - F.array_min("numeric"),
            "na_count": F.col("n") - F.size("numeric"),
            "max_prob": F.array_max(p),
        }
    ).withColumn("p_not_mentioned", F.col("na_count") / F.col("n"))
    na = (2 * F.col("na_count") > F.col("n")) | F.col("mode").isNull()
    possible = F.size(F.filter("votes", lambda v: v["score"].isNotNull() & (v["assertion"] == "possible")))
    said = F.when(na, "not_mentioned").when(F.col("mode") == 0, "denied").when((F.col("mode") == 1) & (2 * possible > F.size("numeric")), "possible").otherwise("present")
    out = out.withColumn("consensus_score", F.when(~na, F.col("mode"))).withColumn("consensus_assertion", said)
    number = lambda c: F.format_string("%.2f", c)
    some = F.size("numeric") > 0
    low, high = config.ambiguity_band
    reasons = [
        F.when(some & (F.col("na_count") >= config.na_count_threshold), F.concat(F.lit("high_na_count="), "na_count")) if config.na_count_threshold is not None else F.lit(None).cast("string"),
        F.when(some & (F.col("p_not_mentioned") > config.na_rate_threshold), F.concat(F.lit("high_na_rate="), number("p_not_mentioned"))) if config.na_rate_threshold is not None else F.lit(None).cast("string"),
        F.when(F.col("max_prob") < config.max_prob_threshold, F.concat(F.lit("low_max_prob="), number("max_prob"))),
        F.when(F.col("entropy") > config.entropy_threshold, F.concat(F.lit("high_entropy="), number("entropy"))),
        F.when(F.col("clinical_prob").between(low, high), F.concat(F.lit("clinical_ambiguity="), number("clinical_prob"))),
        F.when(F.col("vote_range") >= config.range_threshold, F.concat(F.lit("vote_range="), "vote_range")),
    ]
    out = out.withColumn("reason", F.concat_ws("; ", *reasons))
    out = out.withColumn("needs_arbitration", F.col("reason") != "").withColumn("arbitration_reason", F.when(F.col("reason") != "", F.col("reason")))
    return out.drop("numeric", "n", "reason")


def juror_totals(item_agg: DataFrame) -> DataFrame:
    """(file_id, model_id, run_number, total): sums over items, not-mentioned as 0."""
    rows = item_agg.select("file_id", F.explode("votes").alias("v"))
    return rows.groupBy("file_id", "v.model_id", "v.run_number").agg(F.sum(F.coalesce("v.score", F.lit(0))).alias("total"))


def totals(items: Column) -> dict[str, Column]:
    """Imputed and prorated totals of an array of structs with consensus_score: prorating needs 7 of 8 items."""
    score = F.transform(items, lambda i: i["consensus_score"])
    known = F.filter(score, lambda s: s.isNotNull())
    n = F.size(known)
    imputed = F.aggregate(known, F.lit(0), lambda s, x: s + x)
    return {
        "total_imputed": imputed,
        "discussed_count": n,
        "item_coverage": n / F.lit(8.0),
        "meets_min_coverage": n >= 4,
        "proration_valid": n >= 7,
        "total_prorated": F.when(n >= 7, imputed / n * 8),
        "total_prorated_rounded": F.when(n >= 7, F.round(imputed / n * 8).cast("int")),
    }


def scored(item_agg: DataFrame, config: ScoringConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each dialogue: total distribution, interval, buckets, totals and arbitration.

    One shuffle by file_id gathers the eight items. Floats are folded in the items' order.
    """
    item = F.struct("item_idx", "item", "posterior", "consensus_score", "consensus_assertion", "needs_arbitration", "arbitration_reason", "entropy", "vote_range", "mode", "na_count", "votes")
    row = item_agg.groupBy("file_id", *keep).agg(F.array_sort(F.collect_list(F.struct("item_idx", item.alias("i")))).alias("s"))
    row = row.select("file_id", *keep, F.transform("s", lambda x: x["i"]).alias("items"))
    zero = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)))
    ps = F.transform("items", lambda i: F.when(i["consensus_score"].isNull(), zero).otherwise(i["posterior"]))
    row = row.withColumn("total_posterior", N.convolve(ps)).withColumn("cdf", N.cdf(F.col("total_posterior")))
    d = F.col("total_posterior")
    row = row.withColumn("total_expected", N.expected(d)).withColumn("total_mode", N.argmax(d))
    mean = F.col("total_expected")
    std = F.sqrt(N.total(F.transform(d, lambda x, i: x * (i - mean) * (i - mean))))
    row = row.withColumn("total_std", std).withColumn("ci_low", N.quantile_index(F.col("cdf"), 0.05)).withColumn("ci_high", N.quantile_index(F.col("cdf"), 0.95))
    mass = F.array(*(N.total(F.slice(d, low + 1, high - low + 1)) for low, high in BUCKETS.values()))
    row = row.withColumn("bucket_probs", mass)
    row = row.withColumn("severity_bucket", F.get(F.array(*map(F.lit, BUCKETS)), N.argmax(F.col("bucket_probs"))))
    row = row.withColumns(totals(F.col("items")))
    row = row.withColumn("phq_like_bucket", N.bucket_of(F.col("total_prorated_rounded")))
    jury = F.get("items", F.lit(0))["votes"]
    sums = F.transform(F.sequence(F.lit(0), F.size(jury) - 1), lambda j: F.aggregate("items", F.lit(0), lambda s, i: s + F.coalesce(F.get(i["votes"], j)["score"], F.lit(0))))
    row = row.withColumn("juror_totals", sums)
    avg = F.aggregate("juror_totals", F.lit(0.0), lambda s, x: s + x) / F.size("juror_totals")
    row = row.withColumn("juror_mean", avg)
    spread = F.sqrt(F.aggregate("juror_totals", F.lit(0.0), lambda s, x: s + (x - F.col("juror_mean")) * (x - F.col("juror_mean"))) / F.size("juror_totals"))
    row = row.withColumn("juror_total_std", spread)
    wide = F.col("juror_total_std") >= config.total_std_threshold
    asked = F.transform(F.filter("items", lambda i: i["needs_arbitration"]), lambda i: i["item"])
    row = row.withColumn("arbitration_items", F.concat(asked, F.when(wide, F.array(F.lit(TOTAL))).otherwise(F.array().cast("array<string>"))))
    row = row.withColumn("triggered_arbitration", F.size("arbitration_items") > 0)
    row = row.withColumn("final_item_scores", F.transform("items", lambda i: F.coalesce(i["consensus_score"], F.lit(0))))
    row = row.withColumn("final_total", F.aggregate("final_item_scores", F.lit(0), lambda s, x: s + x))
    row = row.withColumn("final_bucket", N.bucket_of(F.col("final_total"))).withColumn("final_source", F.lit("jury_mode"))
    return row.drop("cdf", "juror_mean")


def contested(scored_rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, item, votes, mode, contested, ...): a dispersed total contests all items."""
    rows = scored_rows.select("file_id", *keep, "arbitration_items", F.explode("items").alias("i"))
    asked = F.array_contains("arbitration_items", F.lit(TOTAL)) | F.array_contains("arbitration_items", F.col("i.item"))
    return rows.select("file_id", *keep, "i.item_idx", "i.item", "i.votes", "i.mode", "i.consensus_score", "i.consensus_assertion", asked.alias("contested"))


def overlay(scored_rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Scored rows after the judge: a resolution replaces the consensus, also by null (not mentioned).

    Item-level consensus stays as the jury left it; totals, buckets and final scores are computed anew.
    """
    fields = [c for c in ("final_score", "assertion", "confidence", "evidence", "rationale", "usage") if c in resolutions.columns]
    one = resolutions.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct(*fields)))).alias("judge_resolution"))
    took = lambda i: F.map_contains_key("judge_resolution", i["item"])
    score = lambda i: F.when(F.col("judge_resolution").isNotNull() & took(i), F.element_at("judge_resolution", i["item"])["final_score"]).otherwise(i["consensus_score"])
    return _judged(scored_rows.join(one, "file_id", "left"), F.transform("items", lambda i: F.struct(score(i).alias("consensus_score"))))


def overlay_in_row(scored_rows: DataFrame, resolve: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """As overlay, by a judge that is an expression of an item's votes: without a join, as a row holds its votes."""
    whole = F.array_contains("arbitration_items", F.lit(TOTAL))
    answer = lambda i: F.struct(*(c.alias(n) for n, c in resolve(i["votes"]).items()))
    answers = F.transform("items", lambda i: F.when(whole | F.array_contains("arbitration_items", i["item"]), answer(i)))
    row = once(scored_rows, {"__answers": answers})
    pairs = F.filter(F.arrays_zip(F.transform("items", lambda i: i["item"]).alias("item"), F.col("__answers").alias("answer")), lambda p: p["answer"].isNotNull())
    row = row.withColumn("judge_resolution", F.when(F.size("arbitration_items") > 0, F.map_from_entries(pairs)))
    final = F.zip_with("items", "__answers", lambda i, a: F.struct(F.when(a.isNotNull(), a["final_score"]).otherwise(i["consensus_score"]).alias("consensus_score")))
    return _judged(row, final).drop("__answers")


def _judged(row: DataFrame, final: Column) -> DataFrame:
    """Totals, buckets and scores of rows with judge_resolution, from final: structs with consensus_score, by item."""
    row = once(row, {"__final": final})
    row = once(row, {"__scores": F.transform("__final", lambda i: F.coalesce(i["consensus_score"], F.lit(0)))})
    new = totals(F.col("__final"))
    judged = F.col("judge_resolution").isNotNull()
    row = row.withColumns({k: F.when(judged, v).otherwise(F.col(k)) for k, v in new.items()})
    row = row.withColumn("final_item_scores", F.col("__scores"))
    row = row.withColumn("final_total", F.aggregate("final_item_scores", F.lit(0), lambda s, x: s + x))
    row = row.withColumn("final_bucket", N.bucket_of(F.col("final_total"))).withColumn("phq_like_bucket", N.bucket_of(F.col("total_prorated_rounded")))
    return row.withColumn("final_source", F.when(judged, "judge_override").otherwise(F.col("final_source"))).drop("__final", "__scores")


def best_jurors(item_rows: DataFrame) -> DataFrame:
    """The juror that speaks for each item: of those equal to the consensus the most confident, then by name and run.

    Without any, on a mentioned item, an error.
    """
    same = F.filter("votes", lambda v: v["score"].eqNullSafe(F.col("consensus_score")) & v["assertion"].eqNullSafe(F.col("consensus_assertion")) & v["confidence"].isNotNull())
    keyed = F.array_sort(F.transform(same, lambda v: F.struct((-v["confidence"]).alias("c"), v["model_id"].alias("m"), v["run_number"].alias("r"), v["evidence"].alias("e"))))
    rows = item_rows.filter("consensus_assertion <> 'not_mentioned'").withColumn("best", F.get(keyed, F.lit(0)))
    fail = F.raise_error(F.concat(F.lit("no juror agrees with the consensus of "), "file_id", F.lit(" "), "item")).cast("string")
    return rows.select(
        "file_id", "item", F.when(F.col("best").isNull(), fail).otherwise(F.col("best.m")).alias("model_id"), F.col("best.r").alias("run_number"), (-F.col("best.c")).alias("confidence"), F.col("best.e").alias("evidence"), "consensus_score", "consensus_assertion"
    )


def item_rows(scored_rows: DataFrame) -> DataFrame:
    return scored_rows.select("file_id", F.inline("items"))


def domain_items(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ITEMS)), "item_idx int, item string")
