"""Run diagnostics: reliability, consistency, coverage, separation, arbitration and the gates over them.

Everything that depends on the corpus is aggregated by Spark to a fixed number of cells (items x scores, conditions,
items x assertions); only these come to the driver, for the closed formulas at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ASSERTIONS, GATES, ITEMS, TOTAL
from ..functions import numeric as N
from .aggregate import domain_items


def coincidences(item_agg: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., v, w, o): coincidence matrix over units (dialogue, item) with two values at least."""
    unit = item_agg.select(*by, "vote_counts", F.aggregate("vote_counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("m")).filter("m >= 2")
    score = F.array(*map(F.lit, range(4)))
    pairs = F.flatten(
        F.transform(
            score,
            lambda v: F.transform(score, lambda w: F.struct(v.alias("v"), w.alias("w"), (F.get("vote_counts", v) * (F.get("vote_counts", w) - F.when(v == w, 1).otherwise(0)) / (F.col("m") - 1)).alias("o"))),
        )
    )
    cells = unit.select(*by, F.explode(pairs).alias("p")).select(*by, "p.v", "p.w", "p.o")
    return cells.groupBy(*by, "v", "w").agg(F.sum("o").alias("o"))


def krippendorff(item_agg: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., alpha): ordinal alpha from the coincidence matrix; null where only one value occurs."""
    o = coincidences(item_agg, by)
    n = o.groupBy(*by, F.col("v").alias("g")).agg(F.sum("o").alias("n"))
    sums = n.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("n"), F.sum("n").alias("total"))
    cell = o.join(F.broadcast(sums), list(by)) if by else o.crossJoin(F.broadcast(sums))  # one row for each group of `by`
    count = lambda g: F.coalesce(F.try_element_at("n", g), F.lit(0.0))
    between = F.aggregate(F.sequence(F.least("v", "w"), F.greatest("v", "w")), F.lit(0.0), lambda s, g: s + count(g))
    delta = between - (count(F.col("v")) + count(F.col("w"))) / 2
    cell = cell.withColumn("d", delta * delta)
    got = cell.groupBy(*by).agg(F.sum(F.col("o") * F.col("d")).alias("seen"), F.sum(count(F.col("v")) * count(F.col("w")) * F.col("d")).alias("chance"), F.first("total").alias("total"))
    return got.select(*by, F.when(F.col("chance") > 0, 1 - (F.col("total") - 1) * F.col("seen") / F.col("chance")).alias("alpha"))


def icc_sums(item_agg: DataFrame) -> DataFrame:
    """One row of two-way sums over units x jurors (not-mentioned as 0): n, k, ss_rows, ss_cols, ss_total."""
    votes = item_agg.select(F.transform("votes", lambda v: F.coalesce(v["score"], F.lit(0)).cast("double")).alias("x"))
    rows = votes.select("x", F.size("x").alias("k"), N.total(F.col("x")).alias("row"), N.total(F.transform("x", lambda a: a * a)).alias("sq"))
    flat = rows.agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("k").alias("k_min"), F.sum("row").alias("s"), F.sum("sq").alias("sq"), F.sum(F.col("row") * F.col("row")).alias("rr"))
    cols = votes.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    one = flat.crossJoin(cols)  # one row each
    fix = F.col("s") * F.col("s") / (F.col("n") * F.col("k"))
    return one.select("n", "k", "k_min", (F.col("rr") / F.col("k") - fix).alias("ss_rows"), (F.col("cc") / F.col("n") - fix).alias("ss_cols"), (F.col("sq") - fix).alias("ss_total"))


def icc(item_agg: DataFrame, confidence: float = 0.95) -> dict[str, float | None]:
    """ICC(3,1) with its interval, and ICC(2,1)."""
    r = icc_sums(item_agg).first()
    n, k = r["n"], r["k"]
    if not n or n < 2 or k < 2:
        raise ValueError("ICC needs two units and two jurors at least")
    if r["k"] != r["k_min"]:
        raise ValueError("units with different numbers of jurors")
    msr, msc = r["ss_rows"] / (n - 1), r["ss_cols"] / (k - 1)
    mse = max(0.0, r["ss_total"] - r["ss_rows"] - r["ss_cols"]) / ((n - 1) * (k - 1))
    if mse < 1e-12:
        one = 1.0 if msr > 0 else 0.0
        return {"icc3": one, "icc3_low": one, "icc3_high": one, "icc2": msr / (msr + k * max(0.0, msc) / n) if msr > 0 else 0.0}
    f = msr / mse
    d1, d2 = n - 1, (n - 1) * (k - 1)
    low, high = f / N.f_quantile(0.5 + confidence / 2, d1, d2), f * N.f_quantile(0.5 + confidence / 2, d2, d1)
    return {
        "icc3": (msr - mse) / (msr + (k - 1) * mse),
        "icc3_low": (low - 1) / (low + k - 1),
        "icc3_high": (high - 1) / (high + k - 1),
        "icc2": (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n),
    }


def cronbach(scored: DataFrame) -> DataFrame:
    """(alpha): of the final item scores; 0 without variance of the total."""
    items = [F.var_samp(F.get("final_item_scores", F.lit(i))) for i in range(len(ITEMS))]
    var = sum(items[1:], items[0])
    k = len(ITEMS)
    whole = F.var_samp("final_total")
    return scored.agg(F.when(F.count("*") < 2, None).when(whole <= 0, 0.0).otherwise(F.lit(k / (k - 1)) * (1 - var / whole)).alias("alpha"))


def item_total_correlation(scored: DataFrame) -> DataFrame:
    """(item, r): correlation with the total, the item included; 0 if either is constant."""
    rows = scored.select("final_total", F.posexplode("final_item_scores").alias("item_idx", "x"))
    flat = (F.stddev_pop("x") == 0) | (F.stddev_pop("final_total") == 0)
    got = rows.groupBy("item_idx").agg(F.when(flat, 0.0).otherwise(F.corr("x", "final_total")).alias("r"))
    return got.select(F.get(F.array(*map(F.lit, ITEMS)), F.col("item_idx")).alias("item"), "r")


def coverage(scored: DataFrame) -> DataFrame:
    """One row: not-mentioned cells and rate, least and greatest item coverage, dialogue coverage."""
    na = lambda i: F.sum((F.get("items", F.lit(i))["consensus_assertion"] == "not_mentioned").cast("long"))
    sums = scored.agg(
        F.count("*").alias("n_dialogues"),
        *(na(i).alias(f"na_{i}") for i in range(len(ITEMS))),
        F.count_if("meets_min_coverage").alias("dialogues_with_min_coverage"),
        F.count_if("proration_valid").alias("dialogues_with_proration_valid"),
        F.avg("item_coverage").alias("dialogue_coverage_mean"),
        F.stddev_pop("item_coverage").alias("dialogue_coverage_std"),
    )
    n = F.col("n_dialogues")
    cells = sum((F.coalesce(f"na_{i}", F.lit(0)) for i in range(1, len(ITEMS))), F.coalesce("na_0", F.lit(0)))
    each = [F.when(n > 0, (n - F.coalesce(f"na_{i}", F.lit(0))) / n).otherwise(0.0) for i in range(len(ITEMS))]
    return sums.select(
        n,
        (n * len(ITEMS)).alias("total_cells"),
        cells.alias("na_cells"),
        F.when(n > 0, cells / (n * len(ITEMS))).otherwise(0.0).alias("corpus_na_rate"),
        F.least(*each).alias("min_item_coverage"),
        F.greatest(*each).alias("max_item_coverage"),
        "dialogues_with_min_coverage",
        "dialogues_with_proration_valid",
        F.coalesce("dialogue_coverage_mean", F.lit(0.0)).alias("dialogue_coverage_mean"),
        F.coalesce("dialogue_coverage_std", F.lit(0.0)).alias("dialogue_coverage_std"),
        F.array(*each).alias("item_coverage"),
    )


def coverage_histogram(scored: DataFrame) -> DataFrame:
    """(discussed_count, dialogues) for 0 to 8, zeros too."""
    domain = scored.sparkSession.range(len(ITEMS) + 1).select(F.col("id").cast("int").alias("discussed_count"))
    got = scored.groupBy("discussed_count").agg(F.count("*").alias("dialogues"))
    return domain.join(F.broadcast(got), "discussed_count", "left").select("discussed_count", F.coalesce("dialogues", F.lit(0)).alias("dialogues"))  # 9 rows


def assertion_distribution(item_agg: DataFrame) -> DataFrame:
    """(item, assertion, votes) for all items and for each ('all' for the total), zeros too."""
    votes = item_agg.select("item", F.explode(F.transform("votes", lambda v: v["assertion"])).alias("assertion"))
    got = votes.groupBy("item", "assertion").agg(F.count("*").alias("votes"))
    spark = item_agg.sparkSession
    kinds = spark.createDataFrame([(a,) for a in ASSERTIONS], "assertion string")
    domain = domain_items(spark).select("item").crossJoin(kinds)  # 8 x 4 rows
    full = domain.join(F.broadcast(got), ["item", "assertion"], "left").select("item", "assertion", F.coalesce("votes", F.lit(0)).alias("votes"))
    return full.unionByName(full.groupBy("assertion").agg(F.sum("votes").alias("votes")).withColumn("item", F.lit("all")))


def separation_sums(scored: DataFrame) -> DataFrame:
    """(basis, condition, n, mean, std) of imputed totals and, where valid, of prorated ones."""
    rows = scored.select("condition", F.explode(F.array(F.struct(F.lit("imputed").alias("basis"), F.col("total_imputed").cast("double").alias("x")), F.struct(F.lit("prorated").alias("basis"), F.col("total_prorated").alias("x")))).alias("e"))
    return rows.select("condition", "e.*").filter("x is not null").groupBy("basis", "condition").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def separation(scored: DataFrame) -> dict:
    """Cohen's d and Welch's test of the two conditions; prorated totals decide where both have two at least."""
    sums = {(r["basis"], r["condition"]): r for r in separation_sums(scored).collect()}  # 4 rows
    out: dict = {"gate_basis": "imputed"}
    for basis in ("imputed", "prorated"):
        a, b = sums.get((basis, "mdd")), sums.get((basis, "control"))
        if not a or not b or min(a["n"], b["n"]) < 2:
            if basis == "imputed":
                raise ValueError("separation needs two dialogues of each condition at least")
            continue
        va, vb = a["std"] ** 2 / a["n"], b["std"] ** 2 / b["n"]
        pooled = math.sqrt(((a["n"] - 1) * a["std"] ** 2 + (b["n"] - 1) * b["std"] ** 2) / (a["n"] + b["n"] - 2))
        d = (a["mean"] - b["mean"]) / pooled if pooled > 0 else 0.0
        t = p = float("nan")
        if va + vb > 0:
            t = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
            p = N.t_two_sided(t, (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1)))
        valid = a["mean"] > b["mean"] and p < GATES["p_value"] and d >= GATES["cohens_d"]
        out[basis] = {"mdd_mean": a["mean"], "control_mean": b["mean"], "mdd_std": a["std"], "control_std": b["std"], "cohens_d": d, "t_statistic": t, "p_value": p, "is_valid": valid}
        out["gate_basis"] = basis
    return out


def arbitration_rates(scored: DataFrame) -> DataFrame:
    """(item, contested, rate) for each item and 'overall'; a dispersed total contests all items. Zeros too."""
    n = scored.agg(F.count("*").alias("n"), F.count_if("triggered_arbitration").alias("contested"))
    every = F.array(*map(F.lit, ITEMS))
    asked = F.array_distinct(F.when(F.array_contains("arbitration_items", F.lit(TOTAL)), every).otherwise(F.col("arbitration_items")))
    got = scored.select(F.explode(asked).alias("item")).groupBy("item").agg(F.count("*").alias("contested"))
    rows = domain_items(scored.sparkSession).join(F.broadcast(got), "item", "left").select("item", F.coalesce("contested", F.lit(0)).alias("contested"))
    rows = rows.crossJoin(F.broadcast(n.select("n"))).unionByName(n.select(F.lit("overall").alias("item"), "contested", "n"))  # one row
    return rows.select("item", "contested", F.when(F.col("n") > 0, F.col("contested") / F.col("n")).otherwise(0.0).alias("rate"))


def trigger_reasons(item_agg: DataFrame) -> DataFrame:
    """(reason, n): how often each trigger fired."""
    part = F.explode(F.split("arbitration_reason", r";\s*"))
    return item_agg.select(part.alias("r")).groupBy(F.substring_index("r", "=", 1).alias("reason")).agg(F.count("*").alias("n"))


def judge_agreement(items: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row: resolutions comparable with the item's mode, how many agree, and their share (1 without any)."""
    both = items.select("file_id", "item", "mode").join(resolutions.select("file_id", "item", "final_score"), ["file_id", "item"])
    return agreement_of(both)


def agreement_of(answers: DataFrame) -> DataFrame:
    """judge_agreement of rows that hold an item's mode beside the judge's final_score."""
    both = answers.filter("mode is not null and final_score is not null")
    got = both.agg(F.count("*").alias("comparable"), F.count_if(F.col("mode") == F.col("final_score")).alias("agreeing"))
    return got.withColumn("agreement", F.when(F.col("comparable") > 0, F.col("agreeing") / F.col("comparable")).otherwise(1.0))
